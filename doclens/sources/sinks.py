"""Outputs: a file for each document, and checks before any is written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


class _FilesWriter(DataSourceWriter):
    """Each row's content goes to a temporary file beside its target and is then renamed, so a reader sees the old file
    or the whole new one. A repeated task writes the same files again."""

    def __init__(self, options: dict):
        self.folder = options["path"].removeprefix("file://")

    def write(self, rows):
        import os

        n = 0
        os.makedirs(self.folder, exist_ok=True)
        for row in rows:
            target = os.path.join(self.folder, os.path.basename(row["name"]))
            temporary = f"{target}.{os.getpid()}.tmp"
            with open(temporary, "w", encoding="utf-8") as f:
                f.write(row["content"])
            os.replace(temporary, target)
            n += 1
        return WriterCommitMessage()


class DocumentFiles(DataSource):
    """df(name, content).write.format("document_files").mode("append").option("path", ...).save(); path is a mounted folder
    that all executors share."""

    @classmethod
    def name(cls):
        return "document_files"

    def schema(self):
        return "name string, content string"

    def writer(self, schema, overwrite):
        return _FilesWriter(self.options)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that the cluster names in spark.checkpoint.dir. Only a local master may do without."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='doclens-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/doclens-{name}-{uuid.uuid4().hex}"


def output_files(docs: DataFrame, format_: str = "both") -> DataFrame:
    """name, content, doc_id of docs(doc_id, title, md, html): <title>.md, <title>.html or both."""
    md = F.struct(F.concat("title", F.lit(".md")).alias("name"), F.col("md").alias("content"))
    html = F.struct(F.concat("title", F.lit(".html")).alias("name"), F.col("html").alias("content"))
    wanted = {"md": (md,), "html": (html,), "both": (md, html)}[format_]
    return docs.select("doc_id", F.explode(F.array(*wanted)).alias("f")).select("doc_id", "f.*")


def foreign_overwrites(new: DataFrame, existing: DataFrame) -> DataFrame:
    """name, source, recorded of new(name, source) whose target exists(name, source) with another source."""
    e = existing.select("name", F.col("source").alias("recorded"))
    return new.join(e, "name").where(F.col("recorded").isNotNull() & (F.col("recorded") != F.col("source"))).select("name", "source", "recorded")


def colliding_targets(new: DataFrame) -> DataFrame:
    """name, sources of targets that several sources of one batch share; also a source that is its own target."""
    many = new.groupBy("name").agg(F.count_distinct("source").alias("sources")).where("sources > 1")
    own = new.where(F.col("name") == F.col("source")).select("name", F.lit(1).cast("bigint").alias("sources"))
    return many.unionByName(own).distinct()


def write_reports(reports: DataFrame, path: str) -> None:
    """reports(doc_id, report) as JSON lines, by Spark's committer."""
    reports.select(F.col("report").alias("value")).write.mode("overwrite").text(path)
