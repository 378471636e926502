"""The registered queries and their SQL, collected from the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import lifecycle_queries, report_queries, retrieval_queries, source_queries, temporal_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for module in (report_queries, lifecycle_queries, retrieval_queries, temporal_queries, source_queries):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily question timeline."""
    return QUERIES["report_timeline_day"](spark, sf_dir)
