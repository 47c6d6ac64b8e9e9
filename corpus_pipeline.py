"""The corpus pipeline: quality, line dedup, near-dedup, mixing and tokens, one operator after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import stages
from tessera.llm._shared import stored, table

#: Each stage takes (spark, docs, sf_dir); its rows are written and read again as the next one's docs.
STAGES = [
    ("quality", stages.quality),
    ("line_dedup", stages.line_dedup),
    ("near_dedup", stages.near_dedup),
    ("mix", stages.mix),
    ("tokens", stages.tokens),
]

#: A trained classifier is not SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
