"""Windows over message streams, as batch forms of what the streaming jobs do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micro_windows(messages: DataFrame, session: list[str], order: list[str], most: int = 5) -> DataFrame:
    """Number each session's messages into windows of ``most``: ``place``, ``window_no``."""
    place = F.row_number().over(Window.partitionBy(*session).orderBy(*order)).cast("long")
    return messages.withColumn("place", place).withColumn("window_no", F.floor((F.col("place") - 1) / most))


def sessions(events: DataFrame, user: str, at: str, tie: str, gap: str) -> DataFrame:
    """Split each user's events where the gap before one is longer than ``gap``: ``session_no``."""
    order = Window.partitionBy(user).orderBy(at, tie)
    fresh = F.when(F.col(at) - F.lag(at).over(order) <= F.expr(f"interval {gap}"), 0).otherwise(1)
    return events.withColumn("fresh", fresh).withColumn("session_no", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("fresh")


def first_of_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Idempotent append: the first row of each key stays."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("r = 1").drop("r")


def chunk(docs: DataFrame, text: str, target: int) -> DataFrame:
    """Fill chunks of about ``target`` characters with whole lines: ``chunk_no``, ``chunk_text``.

    A line longer than ``target`` is a chunk of its own. The fold is over one document's lines.
    """
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))
    longer = lambda s, x: F.length(s["open"]) + F.length(x) + 1 > target
    joined = lambda s, x: F.when(s["open"] == "", x).otherwise(F.concat(s["open"], F.lit("\n"), x))
    step = lambda s, x: F.when((s["open"] != "") & longer(s, x), F.struct(x.alias("open"), F.array_append(s["done"], s["open"]).alias("done"))).otherwise(F.struct(joined(s, x).alias("open"), s["done"].alias("done")))
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x != "")
    folded = F.aggregate(lines, start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"])))
    return docs.select("*", F.posexplode(folded).alias("chunk_no", "chunk_text"))
