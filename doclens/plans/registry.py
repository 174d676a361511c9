"""Registry of queries and of the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from doclens.plans import file_queries, queries

QUERIES = queries.QUERIES | file_queries.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | file_queries.ORACLE_SQL

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["number_tally_diff"](spark, sf_dir)
