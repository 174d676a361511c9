"""Repetition that is page furniture, and repetition that isn't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PER_PAGE = 2
MAX_SHARE = 0.5


def repeated_furniture(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, text of each text that is on every page of its document and at most MAX_PER_PAGE times on any.

    candidates: doc_id, page, text; pages: doc_id, page, size, with a row also for pages without candidates. A
    one-page document has none. Nor has one whose furniture would be more than MAX_SHARE of all sizes: its pages are
    copies of one template. Each step is a hash aggregation on finer keys first, so no document meets in one task
    before it has shrunk to its different texts."""
    on_page = candidates.groupBy("doc_id", "page", "text").agg(F.count("*").alias("n"))
    texts = on_page.groupBy("doc_id", "text").agg(F.count("*").alias("on_pages"), F.max("n").alias("most"), F.sum("n").alias("total"))
    docs = pages.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"), F.sum("size").alias("size"))
    every = texts.join(docs, "doc_id").where((F.col("pages") >= 2) & (F.col("on_pages") == F.col("pages")) & (F.col("most") <= MAX_PER_PAGE))
    guard = every.groupBy("doc_id").agg(F.sum("total").alias("dropped"), F.max("size").alias("size"))
    fine = guard.where(F.col("dropped") <= MAX_SHARE * F.col("size")).select("doc_id")
    return every.join(fine, "doc_id", "left_semi").select("doc_id", "text")


def drop_furniture(rows: DataFrame, furniture: DataFrame) -> DataFrame:
    """rows without those whose doc_id and text are furniture."""
    return rows.join(furniture, ["doc_id", "text"], "left_anti").select(*rows.columns)


def untagged_furniture(blocks: DataFrame) -> DataFrame:
    """Furniture among lines outside of the structure tree; blocks: doc_id, page, zone, text. Page sizes count all."""
    return repeated_furniture(blocks.where("zone <> 'tree'").select("doc_id", "page", "text"), blocks.groupBy("doc_id", "page").agg(F.count("*").alias("size")))


def image_key():
    """Where and how large an image is drawn, to the unit, and its own pixels."""
    at = F.concat_ws(",", *(F.floor(F.col(c) + 0.5).cast("bigint") for c in ("width", "height", "x", "y")))
    return F.concat(at, F.lit(","), F.coalesce(F.concat(F.col("px_w").cast("string"), F.lit("x"), F.col("px_h").cast("string")), F.lit("?")))


def repeated_images(images: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, key of images drawn alike on more than half of the pages of a document that has several.
    images: doc_id, page, width, height, x, y, px_w, px_h; pages: doc_id, page."""
    drawn = images.select("doc_id", "page", image_key().alias("key")).distinct().groupBy("doc_id", "key").agg(F.count("*").alias("on_pages"))
    docs = pages.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    return drawn.join(docs, "doc_id").where("pages > 1 AND on_pages > pages / 2").select("doc_id", "key")
