"""Files and the formats they go by.

files: doc_id, path, ext, length, content. Bytes are read by executors and dropped as soon as a format has been read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT, PDF, SLIDES = ("md", "markdown", "txt"), ("pdf",), ("pptx",)
OFFICE = ("docx", "odt", "xlsx", "csv", "rtf", "epub")


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Every file below path; doc_id is its path. The extension is lower-cased."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return rows.select(F.col("path").alias("doc_id"), "path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"), "length", "content")


def route(files: DataFrame) -> DataFrame:
    """files with the reader each goes to: text, pdf, slides, office, or unsupported."""
    e = F.col("ext")
    return files.withColumn("reader", F.when(e.isin(*TEXT), "text").when(e.isin(*PDF), "pdf").when(e.isin(*SLIDES), "slides").when(e.isin(*OFFICE), "office").otherwise("unsupported"))


def read_text(files: DataFrame) -> DataFrame:
    """doc_id, raw_md of text files, as they are."""
    return route(files).where("reader = 'text'").select("doc_id", F.decode("content", "UTF-8").alias("raw_md"))


def fallback_lines(docs: DataFrame) -> DataFrame:
    """verify lines of a format without pages: the extraction's own lines without scaffolding; page 1."""
    from doclens.functions.text import OWN_MARKUP

    rows = docs.select("doc_id", F.posexplode(F.split("raw_md", "\n")).alias("line_ix", "text"))
    return rows.where(~F.col("text").rlike(OWN_MARKUP)).select("doc_id", F.lit(1).alias("page"), "line_ix", "text")


def read_reports(files: DataFrame) -> DataFrame:
    """doc_id, report struct and error of JSON report files; a file that isn't one has its text as error."""
    schema = "schema int, tool string, version string, source string, passed boolean, totals struct<pages:bigint,lines:bigint,undecoded:bigint>, pictureOnly array<int>, pages array<struct<page:int,digest:string,picture:boolean,hasText:boolean>>, _corrupt string"
    text = F.decode("content", "UTF-8")
    report = F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return files.select("doc_id", report.alias("report")).withColumn("error", F.col("report._corrupt"))


def read_transcripts(files: DataFrame) -> DataFrame:
    """ocr_texts(doc_id, page, text) of JSON files of slide number to text."""
    rows = files.select("doc_id", F.explode(F.from_json(F.decode("content", "UTF-8"), "map<string,string>")).alias("page", "text"))
    return rows.select("doc_id", F.col("page").try_cast("int").alias("page"), "text").where("page IS NOT NULL")
