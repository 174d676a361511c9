"""Before and after recognition, page by page; and the selection and splicing around it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHOWN = 8
MISSING, ADDED, CHANGED = "the page is missing", "the page was not there before", "the text changed"


def reconcile_pages(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, page, status, reason. Pages without text before may change: recovered or still_unreadable. Others must
    keep their digest: original. Any other difference is unexpected, with its reason. before and after: doc_id, page,
    digest, picture, has_text."""
    b = before.select("doc_id", "page", F.col("digest").alias("b_digest"), F.col("picture").alias("b_picture"))
    a = after.select("doc_id", "page", F.col("digest").alias("a_digest"), F.col("has_text").alias("a_text"))
    both = b.withColumn("in_b", F.lit(True)).join(a.withColumn("in_a", F.lit(True)), ["doc_id", "page"], "full_outer")
    reason = (
        F.when(F.col("in_a").isNull(), MISSING)
        .when(F.col("in_b").isNull(), ADDED)
        .when(~F.col("b_picture") & (F.col("b_digest") != F.col("a_digest")), CHANGED)
    )
    status = F.when(reason.isNotNull(), "unexpected").when(~F.col("b_picture"), "original").when(F.col("a_text"), "recovered").otherwise("still_unreadable")
    return both.select("doc_id", "page", status.alias("status"), reason.alias("reason"))


def reconcile_docs(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, before_pages, after_pages, unexpected, recovered, still_unreadable, ok, provenance map<page, kind>.
    A page that changed without leave is still original by provenance; one that came or went has none."""
    pages = reconcile_pages(before, after)
    kind = F.when((F.col("status") == "original") | (F.col("reason") == CHANGED), "original").when(F.col("status") == "recovered", "ocr").when(F.col("status") == "still_unreadable", "unreadable")
    return (
        pages.groupBy("doc_id")
        .agg(
            F.count_if(F.coalesce(F.col("reason") != ADDED, F.lit(True))).alias("before_pages"),
            F.count_if(F.coalesce(F.col("reason") != MISSING, F.lit(True))).alias("after_pages"),
            *(F.count_if(F.col("status") == s).alias(s) for s in ("unexpected", "recovered", "still_unreadable")),
            F.map_from_entries(F.array_sort(F.collect_list(F.when(kind.isNotNull(), F.struct("page", kind.alias("kind")))))).alias("provenance"),
        )
        .withColumn("ok", (F.col("before_pages") == F.col("after_pages")) & (F.col("unexpected") == 0))
    )


def prose(row: dict, unexpected: list[tuple[int, str]], recovered: list[int], unreadable: list[int]) -> str:
    """A person's reading of one document's reconciliation."""
    out = []
    if row["before_pages"] != row["after_pages"]:
        out.append(f"  PAGE COUNT: {row['before_pages']} before, {row['after_pages']} after.")
    if unexpected:
        out.append(f"  REFUSED: {len(unexpected)} page(s) changed that were not to change:")
        out += [f"    p{p}: {reason}" for p, reason in unexpected[:SHOWN]]
        if len(unexpected) > SHOWN:
            out.append(f"    ... and {len(unexpected) - SHOWN} more")
        return "\n".join(out)
    if recovered:
        out.append(f"  Recognised text for page(s) {', '.join(map(str, recovered))}; a guess, not a reading.")
    if unreadable:
        out.append(f"  STILL UNREADABLE: page(s) {', '.join(map(str, unreadable))}.")
    out.append("  Every other page's text is what it was.")
    return "\n".join(out)


def candidates(details: DataFrame) -> DataFrame:
    """doc_id, page of pages for recognition: pictures only."""
    return details.where("picture").select("doc_id", "page")


def recognise(images: DataFrame, engine: Callable[[bytes, str], str], lang: str = "heb+eng") -> DataFrame:
    """ocr_texts(doc_id, page, text) from images(doc_id, page, image_ix, content) by an engine that is passed in; the
    images of a page give one text, joined by blank lines in their order."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(text=[engine(c, lang) for c in pdf["content"]])[["doc_id", "page", "image_ix", "text"]]

    rows = images.select("doc_id", "page", "image_ix", "content").mapInPandas(run, "doc_id string, page int, image_ix int, text string")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("image_ix", "text"))), lambda x: F.trim(x["text"]))
    return rows.groupBy("doc_id", "page").agg(F.array_join(F.filter(ordered, lambda t: t != ""), "\n\n").alias("text"))


def splice(pages: DataFrame, ocr_texts: DataFrame) -> DataFrame:
    """pages(doc_id, page, text) with recognised text where a page has none of its own, and from_ocr."""
    o = ocr_texts.select("doc_id", "page", F.col("text").alias("ocr"))
    own = F.coalesce("text", F.lit("")) != ""
    return pages.join(o, ["doc_id", "page"], "left").select(
        "doc_id", "page", F.when(own, F.col("text")).otherwise(F.coalesce("ocr", F.lit(""))).alias("text"), (~own & F.coalesce(F.col("ocr") != "", F.lit(False))).alias("from_ocr")
    )


def publishable(docs: DataFrame, reconciled: DataFrame) -> DataFrame:
    """docs whose reconciliation is ok; the others stay in staging."""
    return docs.join(reconciled.where("ok").select("doc_id"), "doc_id", "left_semi")
