"""Fusing ranked channels, scoring, and the policies after ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.temporal import clamp

# Weights of a candidate's features, and of the procedure channels.
WEIGHTS = {"semantic": 0.65, "recency": 0.08, "access": 0.07, "confidence": 0.075, "importance": 0.075, "utility": 0.05}
TYPE_WEIGHTS = {"policy": {"text": 0.40, "reliability": 0.35, "usefulness": 0.15, "recency": 0.10}, "episode": {"text": 0.35, "reward": 0.30, "recent_outcome": 0.20, "recency": 0.15}, "trace": {"action": 0.40, "parent_reward": 0.25, "value": 0.20, "recent_outcome": 0.15}}


def rrf(channels: DataFrame, constant: int = 60) -> DataFrame:
    """``query_id, doc_id, rrf, channels`` from rows ``query_id, channel, doc_id, rank, weight``."""
    return channels.groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") / (constant + F.col("rank"))).alias("rrf"), F.count_distinct("channel").alias("channels"))


def pre_score(features: dict[str, Column] | None = None) -> Column:
    features = features or {k: F.col(k) for k in WEIGHTS}
    total = F.lit(0.0)
    for k, w in WEIGHTS.items():
        total = total + w * clamp(features[k])
    return total


def blend(rerank: Column, prior: dict[str, Column]) -> Column:
    """Four fifths of the reranker's score, one of the mean of what is not semantic."""
    rest = {k: w for k, w in WEIGHTS.items() if k != "semantic"}
    total = F.lit(0.0)
    for k, w in rest.items():
        total = total + w * clamp(prior[k])
    return 0.80 * clamp(rerank) + 0.20 * total / sum(rest.values())


def relative_drop(scored: DataFrame, score: str = "score") -> DataFrame:
    """How much of the score before it each result loses."""
    before = F.lag(score).over(Window.partitionBy("query_id").orderBy("rank"))
    drop = F.greatest(F.lit(0.0), (before - F.col(score)) / F.greatest(F.abs(before), F.lit(1e-12)))
    return scored.withColumn("drop", F.coalesce(drop, F.lit(0.0)))


def prefix_cut(scored: DataFrame, fails: Column, keep_first: bool = True) -> DataFrame:
    """Rows before the first that fails; the first result may be exempt."""
    bad = F.when(fails & ((F.col("rank") > 1) if keep_first else F.lit(True)), 1).otherwise(0)
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return scored.withColumn("failed", F.max(bad).over(order)).where("failed = 0").drop("failed")


def pack(ranked: DataFrame, budget: int, cost: str = "tokens") -> DataFrame:
    """Greedy packing of each query's results into a token budget: an item that does not fit is passed over.

    A query's results are few (a top-k), so they are folded as one array.
    """
    items = F.sort_array(F.collect_list(F.struct("rank", F.col("doc_id"), F.col(cost).alias("cost"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("taken"))
    step = lambda s, x: F.when(s["used"] + x["cost"] <= budget, F.struct((s["used"] + x["cost"]).alias("used"), F.array_append(s["taken"], x["doc_id"]).alias("taken"))).otherwise(s)
    folded = ranked.groupBy("query_id").agg(items.alias("items")).withColumn("p", F.aggregate("items", start, step))
    return folded.select("query_id", F.col("p.used").alias("used"), F.col("p.taken").alias("taken"))


def answerability(lexical: Column, dense: Column, gap: Column, results: Column, rerank: Column | None = None) -> Column:
    sound = lexical | (dense > 0.3)
    apart = (results == 1) | (gap > 0.05)
    certain = (rerank > 0.4) if rerank is not None else F.lit(True)
    return F.when(results == 0, "no_evidence").when(sound & apart & certain, "supported").otherwise("low_confidence")


def relevance(lexical: Column, dense: Column, channels: Column, floor: float, band: float = 0.05) -> Column:
    good = ((channels >= 2) & (dense.isNull() | (dense >= floor))) | (lexical & (dense >= floor))
    return F.when(good, "relevant").when(dense >= floor - band, "borderline").otherwise("irrelevant")
