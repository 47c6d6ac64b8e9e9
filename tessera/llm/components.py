"""Connected components of an edge table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: for every node of an edge the least node that it reaches.

    Each round hands every node to the least within two edges, in an order that is drawn anew, and goes on with the edges
    between those only, each once. So a component of any shape loses a part of its nodes in each round, stars
    go in one or two, and all rounds together join little more than the edges that were given. Edges and rounds are written to the
    shared folder before they are read again, so that edges which depend on the order of rows are one set. Null ends
    and loops are ignored; no edges, no rows. Only whether edges are left reaches the driver.
    """
    once = lambda df: df.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = stored(once(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))), "cc-edges")
    labels, steps = edges.select(F.col("a").alias("node"), F.col("b").alias("root")), []
    while not edges.isEmpty():
        place = lambda c: F.struct(F.xxhash64(F.lit(len(steps)), c).alias("at"), F.col(c).alias("top"))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min(place("b")).alias("near")).select("node", F.least("near", place("node")).alias("near"))
        near = stored(near, "cc-near")
        # Of a node's neighbours, one has at least as little beside it as the node itself.
        step = both.join(near.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        steps.append(stored(step.select("node", "near.top"), "cc-steps"))
        of = [steps[-1].select(F.col("node").alias(c), F.col("top").alias(f"top_{c}")) for c in ("a", "b")]
        edges = stored(once(edges.join(of[0], "a").join(of[1], "b").select(F.col("top_a").alias("a"), F.col("top_b").alias("b"))), "cc-edges")
    if not steps:
        return labels
    tops = steps.pop()
    while steps:
        further = tops.select(F.col("node").alias("top"), F.col("top").alias("further"))
        tops = steps.pop().join(further, "top", "left").select("node", F.coalesce("further", "top").alias("top"))
    tops = stored(tops, "cc-tops")
    return stored(tops.join(tops.groupBy("top").agg(F.min("node").alias("root")), "top").select("node", "root"), "cc-labels")
