"""Every query of the fact store and the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import archives, events, fact_writes, facts, flows, governance, indexed, lifecycle, matching, recall, relational, retrieval, scoring, splitting, store  # noqa: F401  they register their queries
from tessera.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval: lexical and language channels, fused, scored and ranked for each benchmark item."""
    return QUERIES["k10_rerank_blend"](spark, sf_dir)
