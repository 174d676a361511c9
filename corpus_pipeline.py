"""The corpus pipeline over documents: reject, deduplicate, decontaminate, encode.

Each stage takes what its predecessor kept, as a table of the columns of documents, and returns such a table; the last
returns token ids. Every stage's operator is in doclens.llm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.bagminhash import near_duplicates
from doclens.llm.bpe_fst import encode_documents
from doclens.llm.decontaminate import find_contamination
from doclens.llm.line_dedup import dedup_lines
from doclens.llm.quality_gam import keep_good, train
from doclens.llm.store import materialise, small_batches

#: SQL cannot express the learned first stage; tests hold the stages against brute force instead.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model, trained on the labelled ones among docs, doesn't reject."""
    small_batches(spark)
    return keep_good(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns as one, so that no name of theirs meets one of an operator's."""
    others = (F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text"))
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *others).alias("rest"))


def _unpacked(left: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, of the packed rows that are left."""
    return left.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"rest.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; a document of which nothing is left goes."""
    left = dedup_lines(_packed(docs)).where((F.col("n_kept_lines") > 0) | (F.col("n_lines") == 0))
    left = _unpacked(left, docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id."""
    small_batches(spark)
    others = materialise(near_duplicates(docs).where("NOT kept").select("doc_id").distinct(), "others")
    return docs.join(F.broadcast(others) if others.count() <= 2_000_000 else others, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item: a single leaked item is a leak."""
    found = find_contamination(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=("text", "rest"))
    return _unpacked(found.where(F.size("item_ids") == 0), docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and text as decoded from the ids."""
    import public_tokenizers

    small_batches(spark)
    coded = encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("bpe", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
