from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import bitemporal
from tessera.sources import event_log
from tessera.streaming import jobs

SCHEMA = "event_id long, at timestamp, user_id long, value double"
START = datetime(2024, 1, 1)


@pytest.fixture
def folder(spark, tmp_path):
    """Three files of events: repeats, two users, and one late row."""
    rows = [(i, START + timedelta(minutes=10 * i), i % 2, float(i)) for i in range(12)]
    for k, part in enumerate((rows[:5], [*rows[5:9], rows[4]], [*rows[9:], rows[6]])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), str(tmp_path / "check"), str(tmp_path / "out")


def run(spark, stream, folder, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", folder[1]).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_each_key_once(spark, folder):
    got = run(spark, jobs.idempotent(jobs.events(spark, folder[0], SCHEMA), ["event_id"], "at", "1 day"), folder, "once")
    assert sorted(r.event_id for r in got) == list(range(12))


def test_windows_are_those_of_the_batch(spark, folder):
    stream = jobs.windowed(jobs.events(spark, folder[0], SCHEMA), "at", ["user_id"], "1 hour", "1 day")
    got = {(r.start, r.user_id): r.n for r in run(spark, stream, folder, "hours", "complete")}
    batch = spark.read.parquet(folder[0]).groupBy(F.window("at", "1 hour").alias("w"), "user_id").count().select("w.start", "user_id", "count")
    assert got == {(r.start, r.user_id): r["count"] for r in batch.collect()}


def test_session_windows(spark, folder):
    got = run(spark, jobs.session_windows(jobs.events(spark, folder[0], SCHEMA), "at", "user_id", "30 minutes", "1 minute"), folder, "sessions")
    assert all(r.n >= 1 for r in got)


def test_micro_windows_fire_by_count(spark, folder):
    got = run(spark, jobs.micro_windows(jobs.events(spark, folder[0], SCHEMA), "user_id", "at", "event_id", most=3), folder, "micro")
    assert all(len(r["items"].split(",")) == 3 and r.by == "count" for r in got) and len(got) == 4


def test_late_versions_find_their_place(spark, folder):
    def merge(before, batch):
        rows = batch if before is None else before.select(batch.columns).unionByName(batch)
        return bitemporal.versions(rows.dropDuplicates(["event_id"]), ["user_id"], "at", "event_id")

    stream = jobs.events(spark, folder[0], SCHEMA)
    jobs.each_batch(stream, jobs.version_writer(folder[2], merge), folder[1]).awaitTermination(120)
    got = spark.read.parquet(f"{folder[2]}/v=2")
    want = bitemporal.versions(spark.read.parquet(folder[0]).dropDuplicates(["event_id"]), ["user_id"], "at", "event_id")
    assert got.count() == 12 and not got.exceptAll(want.select(got.columns)).count()


def test_feedback_joins_exposures(spark, tmp_path):
    spark.createDataFrame([(1, START), (2, START)], "id long, shown_at timestamp").write.parquet(str(tmp_path / "e"))
    spark.createDataFrame([(1, START + timedelta(minutes=5), True), (2, START + timedelta(days=9), True)], "id long, voted_at timestamp, helpful boolean").write.parquet(str(tmp_path / "v"))
    e = spark.readStream.schema("id long, shown_at timestamp").parquet(str(tmp_path / "e"))
    v = spark.readStream.schema("id long, voted_at timestamp, helpful boolean").parquet(str(tmp_path / "v"))
    got = run(spark, jobs.feedback(e, v, "id", "1 hour", "1 day"), ("", str(tmp_path / "c")), "feedback")
    assert [r.id for r in got] == [1]


def test_log_append_export_import_and_restore(spark, tmp_path):
    schema = "event_id long, value double, props string"
    log = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, None)], schema)
    new, conflicts = event_log.append(log, spark.createDataFrame([(1, 1.0, "a"), (2, 9.0, None), (3, 3.0, "c"), (3, 3.0, "c")], schema))
    assert [r.event_id for r in new.collect()] == [3] and [r.event_id for r in conflicts.collect()] == [2]
    event_log.export_jsonl(log, str(tmp_path / "log"))
    (tmp_path / "log" / "more.json").write_text('{"value": 1}\nnot json\n')
    good, bad = event_log.import_jsonl(spark, str(tmp_path / "log"), schema)
    assert sorted(r.event_id for r in good.collect()) == [1, 2] and bad.count() == 2
    event_log.snapshot(log, str(tmp_path / "snap"))
    assert [r.event_id for r in event_log.restore(spark, str(tmp_path / "snap"), spark.createDataFrame([(1,)], "event_id long")).collect()] == [2]
    spark.createDataFrame([(9, 9.0, "x")], schema).write.mode("append").parquet(str(tmp_path / "snap" / "data"))
    with pytest.raises(ValueError, match="manifest"):
        event_log.restore(spark, str(tmp_path / "snap"))
