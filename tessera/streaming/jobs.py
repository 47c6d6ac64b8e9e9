"""Structured Streaming forms: idempotent ingest, windows, micro-windows, late versions and feedback."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events(spark: SparkSession, path: str, schema: str, per_batch: int = 1) -> DataFrame:
    """A stream of the parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def idempotent(stream: DataFrame, key: list[str], at: str, delay: str) -> DataFrame:
    """Each key once, as long as its repeats come within the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def windowed(stream: DataFrame, at: str, keys: list[str], size: str, delay: str, slide: str | None = None) -> DataFrame:
    window = F.window(at, size, slide) if slide else F.window(at, size)
    counted = stream.withWatermark(at, delay).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), *keys, "n", "total")


def session_windows(stream: DataFrame, at: str, user: str, gap: str, delay: str) -> DataFrame:
    counted = stream.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), user).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), user, "n")


def micro_windows(stream: DataFrame, session: str, order: str, item: str, most: int = 5, wait_ms: int = 120_000) -> DataFrame:
    """``session, items, by``: a session's messages as soon as there are ``most``, or after ``wait_ms`` without one.

    The state of a session is the few messages that wait. Items are in their order within a trigger.
    """
    schema = f"{session} string, items string, by string"

    def fire(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({session: [str(key[0])], "items": [",".join(waiting)], "by": ["age"]})
            return
        new = pd.concat(list(frames)).sort_values(order)
        waiting += [str(x) for x in new[item]]
        out = []
        while len(waiting) >= most:
            out.append(",".join(waiting[:most]))
            waiting = waiting[most:]
        if waiting:
            state.update((waiting,))
            state.setTimeoutDuration(wait_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({session: [str(key[0])] * len(out), "items": out, "by": ["count"] * len(out)})

    return stream.groupBy(session).applyInPandasWithState(fire, schema, "waiting array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def feedback(exposures: DataFrame, votes: DataFrame, key: str, delay: str, within: str) -> DataFrame:
    """Votes join the exposure they are for, whichever comes first, within a time."""
    e = exposures.withWatermark("shown_at", delay).alias("e")
    v = votes.withWatermark("voted_at", delay).alias("v")
    on = (F.col(f"e.{key}") == F.col(f"v.{key}")) & (F.col("v.voted_at") >= F.col("e.shown_at")) & (F.col("v.voted_at") <= F.col("e.shown_at") + F.expr(f"interval {within}"))
    return e.join(v, on).select(F.col(f"e.{key}").alias(key), "shown_at", "voted_at", "helpful")


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Run what is there, batch by batch, and stop; the checkpoint makes a rerun go on where it ended."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def version_writer(path: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A batch writer that makes version N of a table from version N - 1 and the batch: late rows find their place.

    Versions are folders named by batch, so a batch that runs again writes the same one again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{path}/v={number - 1}") if number else None
        merge(before, batch).write.mode("overwrite").parquet(f"{path}/v={number}")

    return write
