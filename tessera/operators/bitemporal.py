"""Versions of facts in business and knowledge time, built and read without updates in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.temporal import within

# Fixed value: the changes of status that a claim may make.
TRANSITIONS = [(a, b) for a, bs in {
    "candidate": ("active", "disputed", "expired", "archived", "retracted"),
    "active": ("disputed", "expired", "archived", "superseded", "retracted"),
    "disputed": ("archived", "expired", "active", "superseded", "retracted"),
    "archived": ("active",),
}.items() for b in bs]


def versions(facts: DataFrame, key: list[str], at: str, tie: str) -> DataFrame:
    """Close every version at the start of the next one of its key: ``valid_from``, ``valid_to``, ``version``.

    The order is that of ``at``, whenever rows arrived, so a late row lands between its neighbours.
    """
    order = Window.partitionBy(*key).orderBy(at, tie)
    return facts.withColumns({"valid_from": F.col(at), "valid_to": F.lead(at).over(order), "version": F.row_number().over(order).cast("long"), "superseded_by": F.lead(tie).over(order)})


def as_of(history: DataFrame, key: list[str], at: Column, tie: str) -> DataFrame:
    """The latest version of each key that holds at ``at``."""
    latest = Window.partitionBy(*key).orderBy(F.col("valid_from").desc(), F.col(tie).desc())
    return history.where(within(F.col("valid_from"), F.col("valid_to"), at)).withColumn("r", F.row_number().over(latest)).where("r = 1").drop("r")


def status_at(known_at: Column) -> Column:
    """A version's status as it was known: active until its knowledge interval ended."""
    return F.when(F.col("recorded_from") > known_at, F.lit(None)).when(F.col("recorded_to").isNull() | (known_at < F.col("recorded_to")), "active").otherwise(F.col("status"))


def close_out(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Apply a batch of new versions: open rows of a changed key end where the change begins, and the new rows open.

    ``changes`` has the key, ``valid_from`` and the other columns; one row a key.
    """
    starts = changes.select(F.col(key).alias("c_key"), F.col("valid_from").alias("c_from"))
    kept = current.join(starts, F.col(key) == F.col("c_key"), "left")
    ends = F.col("valid_to").isNull() & F.col("c_from").isNotNull()
    kept = kept.withColumn("valid_to", F.when(ends, F.col("c_from")).otherwise(F.col("valid_to"))).drop("c_key", "c_from")
    return kept.unionByName(changes.withColumn("valid_to", F.lit(None).cast(current.schema["valid_to"].dataType)).select(current.columns))


def transition_problems(changes: DataFrame, was: str = "was", now: str = "now") -> DataFrame:
    """The rows whose change of status is not allowed."""
    allowed = changes.sparkSession.createDataFrame(TRANSITIONS, "a_was string, a_now string")
    return changes.join(F.broadcast(allowed), (F.col(was) == F.col("a_was")) & (F.col(now) == F.col("a_now")), "left_anti")


def link_outcome(same_value: Column, old_at: Column, new_at: Column, numeric_change: Column) -> Column:
    """What a newer claim of a series does to an older one."""
    return (
        F.when(same_value, "entails")
        .when(new_at < old_at, "snapshot_older")
        .when(new_at == old_at, "uncertain")
        .when(numeric_change, "snapshot_newer")
        .otherwise("state_change")
    )
