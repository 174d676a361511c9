"""Text files as they arrive, converted in micro-batches. A file is a document, so no state crosses batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from doclens.functions import text as T
from doclens.operators import verify


def text_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """doc_id, raw_md of text files that appear below path."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch).load(path)
    return rows.select(F.col("path").alias("doc_id"), F.decode("content", "UTF-8").alias("raw_md"))


def converted_stream(docs: DataFrame) -> DataFrame:
    """docs with status, refusal, warning and md; stateless, so late or repeated files need no watermark."""
    name = F.regexp_extract("doc_id", r"([^/]+)$", 1)
    md = T.add_rtl_support(T.preserve_numbering(T.promote_headings(F.col("raw_md"))), F.regexp_replace(name, r"\.[^.]+$", ""), name)
    return verify.gates(docs).withColumn("md", F.when(F.col("status") == 0, md))


def write_stream(docs: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    return docs.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
