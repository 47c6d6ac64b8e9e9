"""The event log: append, export and import as JSON lines, snapshots with a manifest, and restore."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def content_hash(columns: list[str]):
    """A hash of a row's values under their names, nulls included."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def append(log: DataFrame, batch: DataFrame, key: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """The rows of ``batch`` to append, and those in conflict: a known key with another payload.

    A key that comes twice in a batch counts once; the same key and payload again is no change.
    """
    columns = [c for c in log.columns if c != key]
    hashed = batch.withColumn("payload_hash", content_hash(columns))
    first = hashed.groupBy(key).agg(F.min_by(F.struct(*columns, "payload_hash"), "payload_hash").alias("row")).select(key, "row.*")
    known = log.select(key, content_hash(columns).alias("known_hash"))
    new = first.join(known.select(key), key, "left_anti").select(log.columns)
    conflicts = first.join(known, key).where("payload_hash <> known_hash").select(key, "payload_hash", "known_hash")
    return new, conflicts


def export_jsonl(events: DataFrame, path: str) -> None:
    events.write.mode("error").option("ignoreNullFields", "false").json(path)


def import_jsonl(spark: SparkSession, path: str, schema: str = EVENT, key: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """Good rows, and lines that are not JSON of the schema or lack the key."""
    rows = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    kept = rows.select("*", F.col("_bad").isNull().alias("_whole"))
    good = kept.where(F.col("_whole") & F.col(key).isNotNull()).drop("_bad", "_whole")
    bad = kept.where(~F.col("_whole") | F.col(key).isNull()).select(F.coalesce("_bad", F.lit("no key")).alias("line"))
    return good, bad


def manifest(df: DataFrame) -> DataFrame:
    """One row that tells a table's content: rows, and a sum of row hashes that order does not change."""
    number = F.conv(F.substring(content_hash(df.columns), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(number).cast("string"), F.lit("0")).alias("digest"))


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """Write a table and its manifest beside it; returns the manifest as it was read back."""
    df.write.mode("error").parquet(f"{path}/data")
    spark = df.sparkSession
    manifest(spark.read.parquet(f"{path}/data")).write.mode("error").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def restore(spark: SparkSession, path: str, tombstones: DataFrame | None = None, key: str = "event_id") -> DataFrame:
    """A snapshot's rows if they match the manifest, without those deleted since."""
    data = spark.read.parquet(f"{path}/data")
    if manifest(data).exceptAll(spark.read.parquet(f"{path}/manifest")).count():
        raise ValueError(f"{path} does not match its manifest")
    return data if tombstones is None else data.join(tombstones.select(key), key, "left_anti")
