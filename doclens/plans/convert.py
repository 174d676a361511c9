"""From files to documents, and from documents to verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.functions import text as T
from doclens.operators import layout, painted, render, slides, structure, verify
from doclens.operators.furniture import repeated_furniture
from doclens.options import ConvertOptions
from doclens.sources import files as S
from doclens.sources import packages, pdf


def _pdf_documents(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, raw_md) of pdf pages and their verify lines. A page goes by its structure tree if its document's
    coverage is high enough and the page has a tree; else by geometry."""
    items = pdf.glyph_items(pages)
    by_tree = structure.tree_blocks(pages.where("error IS NULL").select("doc_id", "page", "tree", "items"))
    counts = by_tree.groupBy("doc_id", "page").agg(F.max("claimed").alias("claimed"), F.max("chars").alias("chars"))
    chosen = counts.groupBy("doc_id").agg((F.sum("claimed") >= structure.MIN_COVERAGE * F.sum("chars")).alias("trusted"))
    tagged = pages.where("tree IS NOT NULL AND error IS NULL").select("doc_id", "page").join(chosen.where("trusted"), "doc_id").select("doc_id", "page")
    lines = layout.page_blocks  # geometry for the other pages
    rest = items.join(tagged, ["doc_id", "page"], "left_anti")
    from doclens.operators.geometry import group_lines, join_lines

    drawn = join_lines(group_lines(items))
    sizes = drawn.groupBy("doc_id", "page").agg(F.count("*").alias("size"))
    furniture = repeated_furniture(drawn.select("doc_id", "page", "text"), sizes)
    zone = F.when(F.col("zone") == "above", 0).when(F.col("zone") == "tree", 1).otherwise(2)
    tree_rows = by_tree.join(tagged, ["doc_id", "page"], "left_semi").where("md IS NOT NULL").join(furniture.withColumnRenamed("text", "md").withColumn("f", F.lit(True)), ["doc_id", "md"], "left")
    tree_rows = tree_rows.where("f IS NULL OR zone = 'tree'").select("doc_id", "page", (zone * 100_000 + F.col("block_ix")).alias("block_ix"), "md", (F.col("continues") & (F.col("zone") == "tree")).alias("continues"))
    joined = structure.rejoin_across_pages(tree_rows)
    flat = lines(rest, furniture).select("doc_id", "page", "block_ix", "md")
    docs = layout.documents(joined.unionByName(flat), furniture)
    return docs, drawn


def convert(spark: SparkSession, path: str, options: ConvertOptions | None = None, ocr_texts: DataFrame | None = None, extracted_at: str = "1970-01-01") -> dict[str, DataFrame]:
    """Tables of a folder of files: docs(doc_id, raw_md, status, refusal, warning, md, html), lines and pages of the second
    reading, and errors(doc_id, page, error). Each format is a branch of one plan; nothing is collected."""
    o = options or ConvertOptions()
    every = S.route(S.read_files(spark, path))
    text = S.read_text(every)
    office = packages.read_office(every.where("reader = 'office'"))
    pdf_pages = pdf.read_pdf(every.where("reader = 'pdf'"), o.pages)
    pdf_docs, pdf_lines = _pdf_documents(pdf_pages)
    parts = packages.read_parts(every.where("reader = 'slides'"), r"ppt/(slides|notesSlides|media)/.*|.*\.rels$")
    deck, rels = slides.slide_table(parts), slides.relationships(parts)
    said = slides.notes(deck, rels, parts) if o.notes else slides.notes(deck, rels, parts).limit(0)
    slide_docs = slides.documents(slides.sections(deck, said, ocr_texts))

    raw = text.unionByName(office.where("error IS NULL").select("doc_id", "raw_md")).unionByName(pdf_docs).unionByName(slide_docs)
    docs = verify.gates(raw, o.force)
    name = F.regexp_extract("doc_id", r"([^/]+)$", 1)
    title = F.regexp_replace(name, r"\.[^.]+$", "")
    ext = F.regexp_extract(name, r"\.([^.]+)$", 1)
    ingest = T.ingest_fields(ext, F.col("doc_id"), F.lit(extracted_at)) if o.ingest else None
    md = T.add_rtl_support(T.preserve_numbering(T.promote_headings(F.col("raw_md"))), title, name, ingest)
    docs = docs.withColumn("title", title).withColumn("md", F.when(F.col("status") == 0, md)).withColumn("html", render.render_html(F.col("md"), F.col("title")))

    single = S.fallback_lines(text.unionByName(office.where("error IS NULL").select("doc_id", "raw_md")))
    lines = pdf_lines.select("doc_id", "page", F.col("line_ix").cast("int").alias("line_ix"), "text")
    lines = lines.unionByName(slides.summaries(deck, said, ocr_texts).select("doc_id", "page", "line_ix", "text")).unionByName(single)
    images = painted.painted_images(pdf.draw_ops(pdf_pages), pdf_pages)
    drawn = images.groupBy("doc_id", "page").agg(F.count("*").cast("int").alias("images"))
    pdf_rows = pdf_pages.where("error IS NULL").select("doc_id", "page", painted.undecoded(F.col("glyphs")).alias("undecoded")).join(drawn, ["doc_id", "page"], "left")
    pages = pdf_rows.select("doc_id", "page", F.coalesce("images", F.lit(0)).alias("images"), "undecoded")
    pages = pages.unionByName(deck.select("doc_id", F.col("slide").alias("page"), F.col("has_picture").cast("int").alias("images"), F.lit(0).alias("undecoded")))
    pages = pages.unionByName(single.select("doc_id").distinct().select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("images"), F.lit(0).alias("undecoded")))
    errors = office.where("error IS NOT NULL").select("doc_id", F.lit(None).cast("int").alias("page"), "error")
    errors = errors.unionByName(pdf_pages.where("error IS NOT NULL").select("doc_id", "page", "error")).unionByName(parts.where("error IS NOT NULL").select("doc_id", F.lit(None).cast("int").alias("page"), "error"))
    errors = errors.unionByName(every.where("reader = 'unsupported'").select("doc_id", F.lit(None).cast("int").alias("page"), F.lit("unsupported format").alias("error")))
    if o.pages is not None:
        beyond = pdf_pages.where("page_count IS NOT NULL").groupBy("doc_id").agg(F.max("page_count").alias("n"))
        asked = F.array(*(F.struct(F.lit(b).alias("last"), F.lit(label).alias("part")) for _, b, label in o.pages.ranges))
        past = F.filter(asked, lambda r: r["last"] > F.col("n"))
        message = F.concat(F.lit("pages: "), F.array_join(F.transform(past, lambda r: r["part"]), ", "), F.lit(" past the last page, "), F.col("n").cast("string"))
        errors = errors.unionByName(beyond.where(F.size(past) > 0).select("doc_id", F.lit(None).cast("int").alias("page"), message.alias("error")))
    return {"docs": docs, "lines": lines, "pages": pages, "images": images, "errors": errors}


def verify_outputs(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """verdicts, details, findings, numbers, illustrations and alarms of what convert returned."""
    accepted = tables["docs"].where("status = 0")
    outputs = accepted.select("doc_id", T.rendered_text(render.number_lists(F.col("html"))).alias("rendered"))
    lines = tables["lines"].join(accepted.select("doc_id"), "doc_id", "left_semi")
    pages = tables["pages"].join(accepted.select("doc_id"), "doc_id", "left_semi")
    details = verify.page_detail(lines, pages)
    kept = verify.kept_lines(lines)
    return {
        "verdicts": verify.verdicts(lines, pages, outputs),
        "details": details,
        "findings": verify.classify_lines(lines, outputs),
        "numbers": verify.number_diff(kept, outputs),
        "illustrations": verify.illustrations(tables["images"], details),
        "alarms": verify.script_alarm(kept),
    }
