"""Decay, expiry, usefulness and clean-up, as transforms of one table into the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.temporal import half_life

# Half-lives in days by scope, and where activation ends in the archive.
HALF_LIVES = {"temporal": 45.0, "permanent": 90.0, "identity": 365.0}
ARCHIVE_BELOW, GRACE_DAYS = 0.05, 7.0


def usefulness(helpful: Column, unhelpful: Column, success: Column, outcomes: Column) -> Column:
    """Share of helpful votes and of successes, each with a prior, 7 to 3."""
    return 0.7 * (helpful + 2) / (helpful + unhelpful + 4) + 0.3 * (success + 1) / (outcomes + 2)


def bonus_days(helpful: Column, success: Column) -> Column:
    return F.least(F.lit(180), F.floor((helpful + F.floor(success)) / 3) * 14)


def helpful_rate(helpful: Column, unhelpful: Column, score: Column, least: int) -> Column:
    return F.when(helpful + unhelpful >= least, score).otherwise((helpful + 2) / (helpful + unhelpful + 4))


def _by_scope(scope: Column) -> Column:
    return F.coalesce(*(F.when(scope == k, F.lit(v)) for k, v in HALF_LIVES.items()), F.lit(HALF_LIVES["temporal"]))


def decayed(base: Column, idle_days: Column, scope: Column) -> Column:
    """Activation after idle days; a null base counts as none."""
    return F.coalesce(base, F.lit(0.0)) * half_life(idle_days, _by_scope(scope))


def archives(base: Column, idle_days: Column, scope: Column) -> Column:
    """Whether activation fell below the bound more than the days of grace ago."""
    crossed = _by_scope(scope) * F.log2(F.greatest(F.coalesce(base, F.lit(0.0)), F.lit(1e-12)) / ARCHIVE_BELOW)
    return idle_days > F.greatest(crossed, F.lit(0.0)) + GRACE_DAYS


def linear_decay(confidence: Column, idle_days: Column, span_days: float, floor: float = 0.1) -> Column:
    return F.greatest(F.lit(floor), confidence * (1 - F.least(F.lit(1.0), idle_days / span_days)))


def delete_closure(targets: DataFrame, links: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What goes with the targets (``id``): their links, and the events that nothing else links to.

    ``links`` has ``derived_id`` and ``event_id``. Returns the links and the events to delete.
    """
    gone = links.join(targets.select(F.col("id").alias("derived_id")), "derived_id", "left_semi")
    still = links.join(targets.select(F.col("id").alias("derived_id")), "derived_id", "left_anti").select("event_id").distinct()
    orphans = events.join(gone.select("event_id").distinct(), "event_id", "left_semi").join(still, "event_id", "left_anti")
    return gone, orphans


def dangling(child: DataFrame, key: str, parent: DataFrame, parent_key: str, kind: str) -> DataFrame:
    """Rows of ``child`` whose key has no parent, as ``kind, key``."""
    parents = parent.select(F.col(parent_key).alias(key)).distinct()
    return child.where(F.col(key).isNotNull()).join(parents, key, "left_anti").select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("key"))


def missing_both_ways(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with the side: an index is complete if there are none."""
    return left.exceptAll(right).withColumn("side", F.lit("source")).unionByName(right.exceptAll(left).withColumn("side", F.lit("index")))
