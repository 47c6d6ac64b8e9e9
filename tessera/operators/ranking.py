"""Places and running sums within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import stored


def placed(rows: DataFrame, by: list[str], order: list[str], total: str | None = None) -> DataFrame:
    """``rows`` with ``place`` (from 1, by ``order`` within ``by``), ``members`` of its group, and ``upto``, the running sum of ``total``.

    Rows are range-sorted, so that a group may lie in many parts; each part counts its own, and a row per part and group
    tells what is before it. No group is one task. ``order`` is total but for equal rows; null keys are a group.
    """
    value = F.col(total) if total else F.lit(0)
    ranged = rows.withColumn("_key", F.to_json(F.struct(*by))).repartitionByRange("_key", *order)
    ranged = stored(ranged.withColumn("_part", F.spark_partition_id()), "ranked-rows")
    sums = ranged.groupBy("_key", "_part").agg(F.count("*").alias("_n"), F.sum(value).alias("_sum"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_key", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_above"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_more"), F.sum("_n").over(Window.partitionBy("_key")).alias("members"))
    own = Window.partitionBy("_key", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = ranged.withColumns({"_place": F.row_number().over(Window.partitionBy("_key", "_part").orderBy(*order)), "_upto": F.sum(value).over(own)}).join(sums, ["_key", "_part"])
    found = found.withColumns({"place": F.col("_above") + F.col("_place"), "upto": F.col("_more") + F.col("_upto")})
    return found.select(*rows.columns, "place", "members", *(["upto"] if total else []))
