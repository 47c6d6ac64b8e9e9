"""Walks over an edge table: neighbours, bounded walks, best paths and chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge both ways: an either-end join becomes an equi-join."""
    return edges.unionByName(edges.withColumns({"from_id": F.col("to_id"), "to_id": F.col("from_id")}))


def walk(edges: DataFrame, seeds: DataFrame, depth: int, least: float = 0.0) -> DataFrame:
    """``seed, node, hops, weight``: simple paths of up to ``depth`` edges, each with the product of its weights.

    A path's nodes travel with it, so a cycle ends it; ``depth`` joins are written out.
    """
    both = symmetric(edges).where(F.col("weight") >= least).select("from_id", "to_id", "weight")
    step = seeds.select(F.col("node").alias("seed"), F.col("node"), F.lit(0).cast("long").alias("hops"), F.lit(1.0).alias("path_weight"), F.array("node").alias("path"))
    found = []
    for _ in range(depth):
        step = step.join(both, step["node"] == both["from_id"]).where(~F.array_contains("path", F.col("to_id")))
        step = step.select("seed", F.col("to_id").alias("node"), (F.col("hops") + 1).alias("hops"), (F.col("path_weight") * F.col("weight")).alias("path_weight"), F.array_append("path", F.col("to_id")).alias("path"))
        found.append(step)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("seed", "node", "hops", F.col("path_weight").alias("weight"))


def expand(edges: DataFrame, seeds: DataFrame, depth: int = 1, relation_weight: float = 0.35, beam: int = 50) -> DataFrame:
    """The best path to each node around a seed: its score fades by ``relation_weight`` / 2 a hop; a beam per seed."""
    scored = walk(edges, seeds.select("node"), depth).join(seeds.select(F.col("node").alias("seed"), "score"), "seed")
    scored = scored.withColumn("reached", F.col("score") * F.col("weight") * F.pow(F.lit(relation_weight / 2), F.col("hops")))
    best = scored.groupBy("seed", "node").agg(F.max("reached").alias("reached"), F.min("hops").alias("hops"))
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.col("reached").desc(), "node"))
    return best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= beam)


def tips(links: DataFrame, rounds: int = 5) -> DataFrame:
    """``node, tip``: the end of each node's chain of ``node`` to ``next``, by doubling the step each round.

    2 ** ``rounds`` links are followed; a node whose chain is longer, or runs in a circle, has a null tip.
    """
    jump = links.select("node", F.col("next").alias("tip"))
    for _ in range(rounds):
        further = jump.select(F.col("node").alias("tip"), F.col("tip").alias("beyond"))
        jump = jump.join(further, "tip", "left").select("node", F.coalesce("beyond", "tip").alias("tip"))
    inner = links.select(F.col("node").alias("tip")).distinct().withColumn("inner", F.lit(True))
    return jump.join(inner, "tip", "left").select("node", F.when(F.col("inner").isNull(), F.col("tip")).alias("tip"))
