"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from doclens.llm.bpe_fst import digest_documents

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digest_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query
def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclens.llm.arc_to_warc import pages_through_archives

    return pages_through_archives(table(spark, sf_dir, "pages"))


ORACLE_SQL["op5_arc_to_warc"] = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT payload_digest, max(page_id) AS newest FROM p WHERE payload_bytes >= 1000 GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN newest IS NULL OR page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclens.llm.secrets_entropy import secret_digests

    return secret_digests(table(spark, sf_dir, "documents"))


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclens.llm.decontaminate import contamination_digests

    return contamination_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _op8_sql() -> str:
    from doclens.llm.decontaminate import SQL

    return SQL


ORACLE_SQL["op8_decontaminate"] = _op8_sql()


@query
def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclens.llm.quality_gam import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_toxicity_kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclens.llm.toxicity_kn import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclens.llm.html_density import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


@query
def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclens.llm.bagminhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclens.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_kept_lines", "text")


@query
def op2_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclens.llm.embedding_covertree import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: By brute force; the cosine as the operator forms it, from unit vectors.
ORACLE_SQL["op2_cover_tree"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), r(vec_id, reached) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reached
), c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY 1
), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1
)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
