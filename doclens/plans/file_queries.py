"""Queries over files, page structure, slides and rendering, each with the DuckDB SQL it must equal.

Files, trees and pages are made from the driver's tables by rules that SQL can repeat; then the readers and operators
take them back.
"""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.functions import script, text as T
from doclens.operators import geometry, layout, painted, reconcile, render, slides, structure, verify
from doclens.plans import queries as base
from doclens.plans.queries import _BINDER, _GLYPHS, _PAGES, _REC, _SCRIPTED, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# -- geometry ----------------------------------------------------------------------------------------------------


def _numbered(spark, sf_dir) -> DataFrame:
    """lineitem with line, a number within its order."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").withColumn("line", F.row_number().over(order))


_LI = "li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS line FROM lineitem)"


def _items(rows: DataFrame, fields: list[tuple], eol_at: tuple[int, ...]) -> DataFrame:
    """Glyph items of a line: fields are (text, x, y); a line ends after the fields of eol_at."""
    made = F.array(*(F.struct(s.alias("str"), F.lit(float(x)).alias("x"), y.cast("double").alias("y")) for s, x, y in fields))
    items = rows.select((F.col("l_orderkey") % 8).cast("string").alias("doc_id"), F.col("l_orderkey").alias("page"), "line", F.posexplode(made).alias("k", "i"))
    return items.select(
        "doc_id", "page", (F.col("line") * len(fields) + F.col("k")).cast("int").alias("item_ix"), "i.str", "i.x", "i.y", (5.0 * F.length("i.str")).alias("width"), F.lit(11.0).alias("font_size"), F.col("k").isin(*eol_at).alias("has_eol")
    )


@query(f"WITH {_LI} SELECT (l_orderkey % 8)::VARCHAR AS doc_id, l_orderkey AS page, (line - 1)::INTEGER AS line_ix, 'שורה ABC ' || l_partkey || ' סוף' AS text FROM li")
def join_rtl_lines(spark, sf_dir):
    """Right-to-left lines with a left-to-right run of two items inside."""
    y = 720.0 - 14 * F.col("line")
    fields = [(F.lit("שורה"), 400, y), (F.col("l_partkey").cast("string"), 300, y), (F.lit("ABC"), 250, y), (F.lit("סוף"), 100, y)]
    return geometry.join_lines(geometry.group_lines(_items(_numbered(spark, sf_dir), fields, (3,))))


def _two_columns(spark, sf_dir) -> DataFrame:
    y = 720.0 - 14 * F.col("line")
    sides = [(F.rpad(F.concat(F.lit(s), F.col("line").cast("string"), F.lit(" "), F.col("l_partkey").cast("string")), 20, "."), x, y) for s, x in (("L", 50), ("R", 320))]
    return _items(_numbered(spark, sf_dir), sides, (0, 1))


@query(f"""WITH {_LI}, t AS (SELECT l_orderkey, line, rpad('L' || line || ' ' || l_partkey, 20, '.') AS l, rpad('R' || line || ' ' || l_partkey, 20, '.') AS r FROM li),
o AS (SELECT l_orderkey, count(*) AS n, string_agg(l, ' ' ORDER BY line) AS l, string_agg(r, ' ' ORDER BY line) AS r FROM t GROUP BY 1)
SELECT (l_orderkey % 8)::VARCHAR AS doc_id, l_orderkey::INTEGER AS page, 0 AS block_ix, 'paragraph' AS kind, CASE WHEN n > 1 THEN l ELSE l || ' ' || r END AS md FROM o
UNION ALL SELECT (l_orderkey % 8)::VARCHAR, l_orderkey::INTEGER, 1, 'paragraph', r FROM o WHERE n > 1""")
def reading_order(spark, sf_dir):
    """Two columns, drawn line by line across both."""
    return layout.page_blocks(_two_columns(spark, sf_dir))


@query(f"WITH {_LI} SELECT (l_orderkey % 8)::VARCHAR AS doc_id, l_orderkey AS page, 150.0::DOUBLE AS gutter FROM li GROUP BY l_orderkey HAVING count(*) > 1")
def gutter_search(spark, sf_dir):
    return geometry.gutters(geometry.line_metrics(geometry.group_lines(_two_columns(spark, sf_dir))))


@query("SELECT conv_id AS doc_id, trim(regexp_replace(string_agg(text, chr(10) || chr(10) ORDER BY turn), '\\n{3,}', chr(10) || chr(10), 'g'), ' ') || chr(10) AS raw_md FROM conversations GROUP BY 1")
def document_text(spark, sf_dir):
    """Blocks in order, under a header on each page that goes as furniture."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 2).cast("int").alias("page"), (F.col("turn") % 2).cast("int").alias("block_ix"), F.col("text").alias("md"))
    heads = c.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(-1).alias("block_ix"), F.lit("Page header").alias("md"))
    return layout.documents(c.unionByName(heads), heads.select("doc_id", F.col("md").alias("text")).distinct())


# -- structure trees ---------------------------------------------------------------------------------------------


@query(f"""WITH {_LI}, o AS (SELECT l_orderkey AS k, string_agg(line || '. part ' || l_partkey, chr(10) ORDER BY line) AS list, 6 + len(l_orderkey::VARCHAR) + sum(len(line || '.part ' || l_partkey)) AS claimed FROM li GROUP BY 1),
z AS (SELECT k, claimed, unnest(['above', 'tree', 'tree', 'below']) AS zone, unnest([0, 0, 1, 0]) AS block_ix, unnest(['Head', '# Order ' || k, list, 'Page ' || k]) AS md FROM o)
SELECT (k % 8)::VARCHAR AS doc_id, k::INTEGER AS page, zone, block_ix::INTEGER AS block_ix, md, false AS continues, claimed::BIGINT AS claimed, (claimed + 9 + len(k::VARCHAR))::BIGINT AS chars FROM z""")
def tagged_pages(spark, sf_dir):
    """A heading and a numbered list by the tree, and lines above and below that it leaves out."""
    rows = _numbered(spark, sf_dir).select("l_orderkey", "line", "l_partkey", F.col("line").cast("string").alias("n"))
    y = lambda v: v.cast("double").alias("y")
    item = lambda id_, ix, s, x, yy: F.struct(id_.alias("mc_id"), ix.cast("int").alias("item_ix"), s.alias("str"), F.lit(float(x)).alias("x"), y(yy), (5.0 * F.length(s)).alias("width"), F.lit(11.0).alias("font_size"))
    none, k = F.lit(None).cast("string"), F.col("l_orderkey").cast("string")
    li = F.concat(F.lit('{"role":"LI","children":[{"role":"Lbl","children":[{"id":"l'), F.col("n"), F.lit('"}]},{"role":"LBody","children":[{"id":"b'), F.col("n"), F.lit('"}]}]}'))
    at = 740 - 14 * F.col("line")
    own = F.array(item(F.concat(F.lit("l"), "n"), F.col("line") * 2, F.concat("n", F.lit(".")), 72, at), item(F.concat(F.lit("b"), "n"), F.col("line") * 2 + 1, F.concat(F.lit("part "), F.col("l_partkey").cast("string")), 100, at))
    pages = rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", li.alias("li")))), lambda x: x["li"]), ",").alias("lis"), F.flatten(F.collect_list(own)).alias("own"))
    tree = F.concat(F.lit('{"role":"Document","children":[{"role":"H1","children":[{"id":"h"}]},{"role":"L","children":['), "lis", F.lit("]}]}"))
    rest = F.array(item(F.lit("h"), F.lit(0), F.concat(F.lit("Order "), k), 72, F.lit(760)), item(none, F.lit(1000), F.lit("Head"), 72, F.lit(790)), item(none, F.lit(1001), F.concat(F.lit("Page "), k), 72, F.lit(20)))
    return structure.tree_blocks(pages.select((F.col("l_orderkey") % 8).cast("string").alias("doc_id"), F.col("l_orderkey").alias("page"), tree.alias("tree"), F.concat("own", rest).alias("items")))


# -- slides ------------------------------------------------------------------------------------------------------

_DECK = """deck AS (SELECT conv_id::VARCHAR AS doc_id, turn::INTEGER AS slide, conv_id % 5 = 0 AS he, CASE WHEN turn % 4 = 2 THEN NULL WHEN conv_id % 5 = 0 THEN 'שלום עולם ' || turn ELSE 'Turn ' || turn || ' & more' END AS said,
  CASE WHEN conv_id % 2 = 0 THEN 'seen ' || turn END AS ocr, CASE WHEN turn % 3 = 0 THEN 'Note ' || turn END AS note, sum((turn % 4 <> 2)::INTEGER) OVER (PARTITION BY conv_id) > 0 AS any_text FROM conversations)"""


def _deck(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """zip_parts of a deck for each conversation, and recognised texts of slides without any of their own."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("slide"), F.col("turn").cast("string").alias("n"))
    para = lambda s: F.concat(F.lit("<a:p><a:r><a:t>"), s, F.lit("</a:t></a:r></a:p>"))
    said = F.when(F.col("slide") % 4 == 2, "").otherwise(para(F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("שלום עולם "), "n")).otherwise(F.concat(F.lit("Turn "), "n", F.lit(" &amp; more")))))
    number = F.lit('<p:sp><p:ph type="sldNum"/><a:p><a:r><a:t>99</a:t></a:r></a:p></p:sp>')
    part = lambda a, z: F.concat(F.lit(a), "n", F.lit(z)).alias("part")
    bytes_ = lambda s: F.encode(s, "UTF-8").alias("content")
    own = c.select("doc_id", part("ppt/slides/slide", ".xml"), bytes_(F.concat(said, number, F.lit('<p:pic><a:blip r:embed="r9"/></p:pic>'))))
    note = F.when(F.col("slide") % 3 == 0, F.concat(F.lit('<Relationship Id="r1" Type="x/notesSlide" Target="../notesSlides/notesSlide'), "n", F.lit('.xml"/>'))).otherwise("")
    rels = c.select("doc_id", part("ppt/slides/_rels/slide", ".xml.rels"), bytes_(F.concat(F.lit("<Relationships>"), note, F.lit('<Relationship Id="r9" Type="x/image" Target="/ppt/media/image'), "n", F.lit('.png"/></Relationships>'))))
    notes = c.where("slide % 3 = 0").select("doc_id", part("ppt/notesSlides/notesSlide", ".xml"), bytes_(para(F.concat(F.lit("Note "), "n"))))
    media = c.select("doc_id", part("ppt/media/image", ".png"), bytes_(F.concat(F.lit("image "), "n")))
    seen = c.where("slide % 4 = 2 AND conv_id % 2 = 0").select("doc_id", F.col("slide").alias("page"), F.concat(F.lit("seen "), "n").alias("text"))
    return own.unionByName(rels).unionByName(notes).unionByName(media), seen


@query(f"""WITH {_DECK} SELECT doc_id, slide, CASE WHEN he AND any_text THEN '## שקופית ' ELSE '## Slide ' END || slide || chr(10) || chr(10) ||
  CASE WHEN said IS NOT NULL THEN said WHEN ocr IS NOT NULL THEN '<!-- Slide ' || slide || ' OCR -->' || chr(10) || '**' || CASE WHEN he AND any_text THEN 'טקסט שזוהה בתמונה' ELSE 'Text recognised in the picture' END || ':**' || chr(10) || chr(10) || ocr
  WHEN he AND any_text THEN '*(אין טקסט בשקופית זו)*' ELSE '*(no text on this slide)*' END ||
  CASE WHEN note IS NULL THEN '' ELSE chr(10) || chr(10) || '<!-- Slide ' || slide || ' notes -->' || chr(10) || '> **' || CASE WHEN he AND any_text THEN 'הערות דובר' ELSE 'Speaker notes' END || ':** ' || note END AS md FROM deck""")
def slide_sections(spark, sf_dir):
    parts, seen = _deck(spark, sf_dir)
    own = slides.slide_table(parts)
    return slides.sections(own, slides.notes(own, slides.relationships(parts), parts), seen)


@query(f"""WITH {_DECK}, l AS (SELECT doc_id, slide AS page, list_filter([CASE WHEN he AND any_text THEN 'שקופית ' ELSE 'Slide ' END || slide, CASE WHEN said IS NOT NULL THEN said ELSE ocr END, note], lambda x: x IS NOT NULL) AS l FROM deck)
SELECT doc_id, page, unnest(range(len(l)))::INTEGER AS line_ix, unnest(l) AS text FROM l""")
def slide_lines(spark, sf_dir):
    """The second reading of decks that verification compares with."""
    parts, seen = _deck(spark, sf_dir)
    own = slides.slide_table(parts)
    return slides.summaries(own, slides.notes(own, slides.relationships(parts), parts), seen)


@query("SELECT conv_id::VARCHAR AS doc_id, turn::INTEGER AS slide, 'ppt/media/image' || turn || '.png' AS part, 0 AS pic_ix, 'image ' || turn AS content FROM conversations")
def slide_pictures(spark, sf_dir):
    parts, _ = _deck(spark, sf_dir)
    found = slides.pictures(parts, slides.relationships(parts))
    return found.select("doc_id", "slide", "part", F.col("pic_ix").cast("int").alias("pic_ix"), F.decode("content", "UTF-8").alias("content"))


# -- files -------------------------------------------------------------------------------------------------------


@query("SELECT 'p' || page_id || '.md' AS name, sha256(coalesce(html, '')) AS text_sha256 FROM pages")
def text_files(spark, sf_dir):
    """Pages written as files, each at once, and read back by format."""
    from doclens.sources.files import read_files, read_text
    from doclens.sources.sinks import DocumentFiles, output_files, scratch_folder

    spark.dataSource.register(DocumentFiles)
    docs = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("title"), F.coalesce("html", F.lit("")).alias("md"), F.lit("").alias("html"))
    folder = scratch_folder(spark, "text-files")
    output_files(docs, "md").select("name", "content").write.format("document_files").mode("append").option("path", folder).save()
    return read_text(read_files(spark, folder, "*.md")).select(F.regexp_extract("doc_id", "([^/]+)$", 1).alias("name"), F.sha2("raw_md", 256).alias("text_sha256"))


def _package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def office_file(kind: int, name: str, brand: str) -> tuple[str, bytes]:
    """A file of one of five formats with two texts."""
    if kind == 0:
        return "csv", f'name,brand\r\n"{name}",{brand}\r\n'.encode()
    if kind == 1:
        runs = lambda t, style="": f"<w:p><w:pPr>{style}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>"
        heading = '<w:pStyle w:val="Heading1"/>'
        return "docx", _package({"word/document.xml": f'<w:document xmlns:w="w"><w:body>{runs(name, heading)}{runs(brand)}</w:body></w:document>'})
    if kind == 2:
        return "odt", _package({"content.xml": f'<o xmlns:t="t"><t:h t:outline-level="2">{name}</t:h><t:p>{brand}</t:p></o>'})
    if kind == 3:
        cell = lambda at, t: f'<c r="{at}" t="inlineStr"><is><t>{t}</t></is></c>'
        return "xlsx", _package({"xl/worksheets/sheet1.xml": f"<w><row>{cell('A1', 'name')}{cell('B1', 'brand')}</row><row>{cell('A2', name)}{cell('B2', brand)}</row></w>"})
    return "rtf", f"{{\\rtf1{{\\fonttbl x;}} {name}\\par {brand}}}".encode()


@query("""SELECT p_partkey::VARCHAR AS doc_id, CASE p_partkey % 5 WHEN 1 THEN '# ' || p_name || chr(10) || chr(10) || p_brand WHEN 2 THEN '## ' || p_name || chr(10) || chr(10) || p_brand WHEN 4 THEN p_name || chr(10) || chr(10) || p_brand
  ELSE '| name | brand |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_name || ' | ' || p_brand || ' |' END || chr(10) AS raw_md FROM part""")
def office_files(spark, sf_dir):
    """csv, docx, odt, xlsx and rtf files, read by their own readers."""
    from doclens.sources.packages import read_office

    def made(batches):
        import pandas as pd

        for pdf in batches:
            files = [office_file(k % 5, n, b) for k, n, b in zip(pdf["p_partkey"], pdf["p_name"], pdf["p_brand"])]
            yield pd.DataFrame({"doc_id": pdf["p_partkey"].astype(str), "ext": [e for e, _ in files], "content": [c for _, c in files]})

    files = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand").mapInPandas(made, "doc_id string, ext string, content binary")
    return read_office(files).where("error IS NULL").select("doc_id", "raw_md")


def pdf_file(pages: list[list[str]]) -> bytes:
    """A PDF of pages of lines, with an image of 40 by 20 pixels drawn 100 by 50 on each."""
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{5 + 2 * k} 0 R' for k in range(len(pages)))}] >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    objects.append("<< /Type /XObject /Subtype /Image /Width 40 /Height 20 /Length 1 >>\nstream\n0\nendstream")
    for k, lines in enumerate(pages):
        shown = " 0 -14 Td ".join("(" + t.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") + ") Tj" for t in lines)
        drawn = f"BT /F1 11 Tf 72 700 Td {shown} ET q 100 0 0 50 72 300 cm /I1 Do Q"
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> /XObject << /I1 4 0 R >> >> /Contents {6 + 2 * k} 0 R >>")
        objects.append(f"<< /Length {len(drawn)} >>\nstream\n{drawn}\nendstream")
    body = "".join(f"{k} 0 obj\n{o}\nendobj\n" for k, o in enumerate(objects, 1))
    return f"%PDF-1.4\n{body}trailer << /Root 1 0 R >>\n%%EOF".encode("latin-1")


def _pdf_pages(spark, sf_dir) -> DataFrame:
    """A PDF for each conversation, a page for each turn, read back."""
    from doclens.sources.pdf import read_pdf

    texts = F.array(F.concat(F.lit("Turn "), F.col("turn").cast("string")), F.md5("text"))
    docs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", texts.alias("t")))), lambda x: x["t"]).alias("pages"))

    def made(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["conv_id"].astype(str), "content": [pdf_file([list(p) for p in pages]) for pages in pdf["pages"]]})

    return read_pdf(docs.mapInPandas(made, "doc_id string, content binary"))


_TURNS = "t AS (SELECT conv_id::VARCHAR AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS page, turn, text FROM conversations)"


@query(f"WITH {_TURNS} SELECT doc_id, page, unnest([0, 1])::INTEGER AS line_ix, unnest(['Turn ' || turn, md5(text)]) AS text FROM t")
def pdf_lines(spark, sf_dir):
    from doclens.sources.pdf import glyph_items

    return geometry.join_lines(geometry.group_lines(glyph_items(_pdf_pages(spark, sf_dir))))


@query(f"WITH {_TURNS} SELECT doc_id, page, 0 AS image_ix, 100.0::DOUBLE AS width, 50.0::DOUBLE AS height, 72.0::DOUBLE AS x, 300.0::DOUBLE AS y, 5000.0::DOUBLE / 484704.0 AS share, 40 AS px_w, 20 AS px_h FROM t")
def pdf_images(spark, sf_dir):
    from doclens.sources.pdf import draw_ops

    pages = _pdf_pages(spark, sf_dir)
    return painted.painted_images(draw_ops(pages), pages.select("doc_id", "page", "width", "height"))


@query("""SELECT p_brand || '-' || p_partkey AS doc_id, 1 AS page, 0 AS image_ix, p_size * 4.0::DOUBLE AS width, p_size * 2.0::DOUBLE AS height, (p_partkey % 50 + 10)::DOUBLE AS x, 20.0::DOUBLE AS y, p_size * 4.0::DOUBLE * (p_size * 2.0) / 10000.0 AS share, p_size::INTEGER AS px_w, NULL::INTEGER AS px_h FROM part""")
def painted_images(spark, sf_dir):
    """An image under a transformation inside a form, after one that a restore takes back."""
    size = F.col("p_size").cast("double")
    zero = F.lit(0.0)
    op = lambda k, name, m=None, px=None: F.struct(F.lit(k).alias("op_ix"), F.lit(name).alias("op"), (F.array(*m) if m else F.lit(None).cast("array<double>")).alias("matrix"), (F.col("p_size").cast("int") if px else F.lit(None).cast("int")).alias("px_w"), F.lit(None).cast("int").alias("px_h"))
    shift = [F.lit(1.0), zero, zero, F.lit(1.0), (F.col("p_partkey") % 50).cast("double"), zero]
    ops = F.array(op(0, "save"), op(1, "transform", [F.lit(9.0), zero, zero, F.lit(9.0), zero, zero]), op(2, "restore"), op(3, "form_begin", shift), op(4, "transform", [size * 4, zero, zero, size * 2, F.lit(10.0), F.lit(20.0)]), op(5, "image", None, True), op(6, "form_end"))
    rows = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("-"), F.col("p_partkey").cast("string")).alias("doc_id"), F.lit(1).alias("page"), F.explode(ops).alias("o"))
    pages = rows.select("doc_id", "page", F.lit(100.0).alias("width"), F.lit(100.0).alias("height")).distinct()
    return painted.painted_images(rows.select("doc_id", "page", "o.*"), pages)


# -- rendering ---------------------------------------------------------------------------------------------------

_BODY = """'<h1>' || p_name || '</h1>' || chr(10) || '<p>Size <strong>' || p_size || '</strong> of <code>' || p_type || '</code></p>' || chr(10) || '<ol start="3">' || chr(10) || '<li>{0}one</li>' || chr(10) || '<li>{1}' || p_type || '</li>' || chr(10) || '</ol>' || chr(10) ||
'<div class="table-scroll"><table>' || chr(10) || '<thead><tr><th>a</th><th>b</th></tr></thead>' || chr(10) || '<tbody>' || chr(10) || '<tr><td>' || p_brand || '</td><td>x &amp; y</td></tr>' || chr(10) || '</tbody></table></div>' || chr(10) || '<blockquote>' || chr(10) || '<p>' || p_brand || '</p>' || chr(10) || '</blockquote>' || chr(10) || '<aside data-slide="7" dir="ltr">' || chr(10) || '<p>note</p>' || chr(10) || '</aside>'"""


def _markdown(spark, sf_dir) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    md = F.concat(F.lit("# "), "p_name", F.lit("\n\nSize **"), s("p_size"), F.lit("** of `"), "p_type", F.lit("`\n\n3. one\n4. "), "p_type", F.lit("\n\n| a | b |\n| --- | --- |\n| "), "p_brand", F.lit(" | x & y |\n\n> "), "p_brand", F.lit("\n\n<!-- Slide 7 notes -->\n> note\n"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit('---\ntitle: "T"\nsource: "s"\ndir: ltr\nlang: fr\n---\n\n'), md).alias("md"))


@query(f"""SELECT p_partkey, sha256('<!doctype html>' || chr(10) || '<html dir="ltr" lang="fr">' || chr(10) || '<head>' || chr(10) || '<meta charset="utf-8">' || chr(10) || '<meta name="source" content="s">' || chr(10) || '<title>T</title>' || chr(10) || '<style>{render.document_css("ltr")}</style>' || chr(10)
  || '</head>' || chr(10) || '<body>' || chr(10) || '<main>' || {_BODY.format('', '')} || '</main>' || chr(10) || '</body>' || chr(10) || '</html>' || chr(10)) AS html_sha256 FROM part""")
def rendered_pages(spark, sf_dir):
    """Markdown with front matter as a page: headings, lists, tables, quotes, notes, shell and style."""
    return _markdown(spark, sf_dir).select("p_partkey", F.sha2(render.render_html(F.col("md")), 256).alias("html_sha256"))


@query(f"""SELECT p_partkey, sha256(replace(regexp_replace({_BODY.format('3. ', '4. ')}, '<[^>]+>', ' ', 'g'), '&amp;', '&')) AS text_sha256 FROM part""")
def numbered_text(spark, sf_dir):
    """What a reader sees, list numbers included."""
    body = T.parse_front_matter(F.col("md"))["body"]
    html = render.number_lists(render.slide_notes_to_asides(render._render(body), F.lit("ltr")))
    return _markdown(spark, sf_dir).select("p_partkey", F.sha2(T.rendered_text(html), 256).alias("text_sha256"))


@query("""SELECT p_partkey, '<p><a href="https://x.org/' || p_partkey || '" title="t">' || p_name || '</a> <img src="a.png" alt="' || p_brand || '"> <del>' || p_type || '</del> <a href="https://y.org/a_b">https://y.org/a_b</a>. bad</p>' || chr(10) || '<ul>' || chr(10) || '<li><input disabled="" type="checkbox"> ' || p_name || '</li>' || chr(10) ||
  '<li><input checked="" disabled="" type="checkbox"> done</li>' || chr(10) || '</ul>' || chr(10) || '<div class="table-scroll"><table>' || chr(10) || '<thead><tr><th align="left">a</th><th align="center">b</th><th align="right">c</th></tr></thead>' || chr(10) || '<tbody>' || chr(10) ||
  '<tr><td align="left">' || p_size || '</td><td align="center">x</td><td align="right">y</td></tr>' || chr(10) || '</tbody></table></div>' AS html FROM part""")
def rendered_links(spark, sf_dir):
    """Links, images, strikethrough, addresses, boxes and column alignment."""
    s = lambda c: F.col(c).cast("string")
    first = F.concat(F.lit("[",), "p_name", F.lit("](https://x.org/"), s("p_partkey"), F.lit(' "t") !['), "p_brand", F.lit("](a.png) ~~"), "p_type", F.lit("~~ https://y.org/a_b. [bad](javascript:x)\n\n- [ ] "), "p_name", F.lit("\n- [x] done\n\n| a | b | c |\n| :-- | :-: | --: |\n| "), s("p_size"), F.lit(" | x | y |"))
    return table(spark, sf_dir, "part").select("p_partkey", render._render(first).alias("html"))


@query("""SELECT doc_id, sha256('---' || chr(10) || 'title: "T"' || chr(10) || 'source: "s"' || chr(10) || 'source_type: ' || lang || chr(10) || 'source_location: "a/' || source || '"' || chr(10) || 'extracted_at: 2024-01-01' || chr(10) || 'content_mode: verbatim' || chr(10) || 'dir: ltr' || chr(10) || '---' || chr(10) || chr(10) || text) AS md_sha256,
  source AS unwrapped FROM documents""")
def ingest_front_matter(spark, sf_dir):
    fields = T.ingest_fields(F.col("lang"), F.concat(F.lit("a/"), "source"), F.lit("2024-01-01"))
    made = T.add_rtl_support(F.col("text"), F.lit("T"), F.lit("s"), fields)
    unwrapped = T.unwrap_rtl_div(F.concat(F.lit('<div dir="rtl" lang="he">\n\n'), "source", F.lit("\n\n</div>")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(made, 256).alias("md_sha256"), unwrapped.alias("unwrapped"))


# -- reports and recognition -------------------------------------------------------------------------------------


@query(f"""WITH {_SCRIPTED}, w AS (SELECT b AS doc_id, regexp_replace(unnest(string_split_regex(text, '{base._SPACES}')), '[^{base.C.HEBREW}]', '', 'g') AS w FROM (SELECT *, {_BINDER} AS b FROM s)),
o AS (SELECT doc_id, count(*) AS words, count(*) FILTER (regexp_matches(w, '^.+[{base.C.FINALS}].+$')) AS mid_word FROM w WHERE len(w) >= 2 GROUP BY 1), d AS (SELECT DISTINCT {_BINDER} AS b FROM documents)
SELECT d.b AS doc_id, CASE WHEN words >= 3 AND mid_word / words > 0.03 THEN mid_word END::BIGINT AS mid_word, CASE WHEN words >= 3 AND mid_word / words > 0.03 THEN words END::BIGINT AS words FROM d LEFT JOIN o ON o.doc_id = d.b""")
def script_alarm(spark, sf_dir):
    """The alarm over whole documents, whose lines are counted one by one."""
    lines = base.scripted(spark, sf_dir).select(base.binder().alias("doc_id"), F.explode(F.split("text", "\n")).alias("text"))
    return verify.script_alarm(lines).select("doc_id", F.col("scrambled.mid_word").cast("bigint").alias("mid_word"), F.col("scrambled.words").cast("bigint").alias("words"))


@query("SELECT doc_id, 'doclens' AS tool, passed, pages, lines, undecoded, pages AS page_rows FROM (" + base.ORACLE_SQL["verdicts"] + ")")
def report_files(spark, sf_dir):
    """JSON reports as files, read again."""
    from doclens.sources.files import read_reports

    reports = base.reports(spark, sf_dir)
    read = read_reports(reports.select("doc_id", F.encode("report", "UTF-8").alias("content"))).where("error IS NULL")
    return read.select("doc_id", "report.tool", "report.passed", "report.totals.*", F.size("report.pages").cast("bigint").alias("page_rows"))


@query("SELECT conv_id::VARCHAR AS doc_id, turn::INTEGER AS page, text FROM conversations")
def ocr_transcripts(spark, sf_dir):
    """Transcript files of page number to text."""
    from doclens.sources.files import read_transcripts

    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("doc_id"))
    files = c.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("string"), "text")))).alias("j"))
    return read_transcripts(files.select("doc_id", F.encode("j", "UTF-8").alias("content")))


@query("SELECT conv_id AS doc_id, (turn // 2)::INTEGER AS page, string_agg(upper(md5(text)), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY ALL")
def ocr_images(spark, sf_dir):
    """Images of a page by an engine that is passed in, their texts joined."""
    c = table(spark, sf_dir, "conversations")
    images = c.select(F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 2).cast("int").alias("page"), F.col("turn").cast("int").alias("image_ix"), F.encode(F.concat(F.md5("text"), F.lit(" \n")), "UTF-8").alias("content"))
    read = reconcile.recognise(images.withColumn("doc_id", F.col("doc_id").cast("string")), lambda data, lang: data.decode().upper().strip())
    return read.withColumn("doc_id", F.col("doc_id").cast(c.schema["conv_id"].dataType))


@query(f"""WITH {_REC}, ok AS (SELECT doc_id FROM rec GROUP BY 1 HAVING count(*) FILTER (reason = 'the page is missing') = count(*) FILTER (reason = 'the page was not there before') AND count(*) FILTER (status = 'unexpected') = 0)
SELECT DISTINCT source AS doc_id FROM documents WHERE source IN (SELECT doc_id FROM ok)""")
def published(spark, sf_dir):
    """Documents that may leave staging: those whose pages all reconcile."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id")).distinct()
    return reconcile.publishable(docs, reconcile.reconcile_docs(*base._before_after(spark, sf_dir)))


@query("SELECT 'n' || doc_id % 70 AS name, count(DISTINCT source)::BIGINT AS sources FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def colliding_targets(spark, sf_dir):
    from doclens.sources.sinks import colliding_targets as check

    return check(table(spark, sf_dir, "documents").select(F.concat(F.lit("n"), (F.col("doc_id") % 70).cast("string")).alias("name"), "source"))
