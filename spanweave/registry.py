"""The queries that the package offers by name, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanweave.suite import SUITE, io, linking, more, ranking, searching  # noqa: F401

QUERIES = SUITE.queries
ORACLE_SQL = SUITE.sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searching.flagship(spark, sf_dir)
