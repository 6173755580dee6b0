"""All queries of the engine by name, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sedge.plans import clause_queries, contract_queries, gate_queries, graph_queries, insight_queries, segment_queries, source_queries, stream_queries  # noqa: F401  they register their queries
from sedge.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["corpus_facts"](spark, sf_dir)
