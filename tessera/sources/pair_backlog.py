"""Pairs that wait for review: each once, up to a number, and drained as a counted set."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.retrieval import top
from tessera.sources.scratch import stored
from tessera.sources.version_log import Conflict, VersionLog

# The least likeness of a pair and how many may wait, and what a drained pair is marked with.
FLOOR, MOST = 0.88, 10_000
DISMISSED, REASON = "dismissed_below_floor", "v2_below_current_floor"
_PAIR = "left_id long, right_id long, similarity double, decision string, reason string"


class PairBacklog(VersionLog):
    """Pairs by their two ids, the lesser first; each change is a part of whole rows and a version, as in a fact store."""

    EMPTY = {"parts": []}

    def read(self, version: int | None = None) -> DataFrame:
        manifest, rows = self.manifest(version), None
        for k, part in enumerate(manifest["parts"]):
            own = self.spark.read.schema(_PAIR).parquet(f"{self.path}/parts/{part}").withColumn("part", F.lit(k))
            rows = own if rows is None else rows.unionByName(own)
        if rows is None:
            return self.spark.createDataFrame([], _PAIR)
        row = F.max_by(F.struct("similarity", "decision", "reason"), "part").alias("row")
        return rows.groupBy("left_id", "right_id").agg(row).select("left_id", "right_id", "row.*")

    def _write(self, rows: DataFrame, base: dict) -> None:
        part = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/parts/{part}")
        self.commit(base, parts=[*base["parts"], part])

    def add(self, pairs: DataFrame, floor: float = FLOOR, most: int = MOST, base: dict | None = None) -> int:
        """Let new pairs (``left_id, right_id, similarity``) of ``floor`` or more wait, the most alike first, while there is room; returns their number."""
        base = self.manifest() if base is None else base
        known = self.read(base["version"])
        room = most - known.where("decision is null").count()
        new = pairs.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "similarity").where((F.col("left_id") < F.col("right_id")) & (F.col("similarity") >= floor))
        new = new.groupBy("left_id", "right_id").agg(F.max("similarity").alias("similarity")).join(known.select("left_id", "right_id"), ["left_id", "right_id"], "left_anti")
        new = new.orderBy(F.col("similarity").desc(), "left_id", "right_id").limit(max(room, 0))
        none = F.lit(None).cast("string")
        new = stored(new.select("left_id", "right_id", "similarity", none.alias("decision"), none.alias("reason")), "pairs-new")
        self._write(new, base)
        return new.count()

    def inspect(self, threshold: float) -> dict:
        """How many pairs wait, and how many of them lie below ``threshold``, with their least and greatest likeness."""
        low = F.col("similarity") < threshold
        row = self.read().where("decision is null").agg(F.count("*"), F.count_if(low), F.min(F.when(low, F.col("similarity"))), F.max(F.when(low, F.col("similarity")))).first()
        return dict(zip(("pending", "candidates", "least", "greatest"), row, strict=True))

    def drain(self, threshold: float, expected: int, base: dict | None = None) -> int:
        """Dismiss all waiting pairs below ``threshold``, if they are as many as ``expected``; else raise Conflict and change nothing."""
        if expected < 0:
            raise ValueError("expected is a number of pairs")
        base = self.manifest() if base is None else base
        low = self.read(base["version"]).where((F.col("similarity") < threshold) & F.col("decision").isNull())
        rows = stored(low.withColumns({"decision": F.lit(DISMISSED), "reason": F.lit(REASON)}), "pairs-drained")
        found = rows.count()
        if found != expected:
            raise Conflict(f"{found} pairs are below {threshold}, not {expected}")
        self._write(rows, base)
        return found

    def next_in_turn(self, size: int, after: tuple[int, int] | None = None) -> DataFrame:
        """The next waiting pairs to look at, by ids after the last one looked at, and from the first again at the end; nothing is changed."""
        waiting = self.read().where("decision is null")
        later = F.lit(True) if after is None else (F.struct("left_id", "right_id") > F.struct(F.lit(after[0]).cast("long").alias("left_id"), F.lit(after[1]).cast("long").alias("right_id")))
        ranked = waiting.withColumn("turn", F.when(later, 0).otherwise(1)).withColumn("all", F.lit(1))
        return top(ranked, size, [F.col("turn"), F.col("left_id"), F.col("right_id")], ("all",)).select("left_id", "right_id", "similarity", "rank")
