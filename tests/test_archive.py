import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import archive

HEAD = json.dumps({"type": "metadata", "format_version": 1})
SCHEMA = "event_id string, value double, text string"


def line(event_id, value=1.0, text="t"):
    return json.dumps({"type": "event", "data": {"event_id": event_id, "value": value, "text": text}})


def test_round_trip_in_many_ranges(spark, tmp_path):
    rows = [(f"e{i:04}", float(i), "é日\n\"🙂" * (i % 40) if i % 9 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    archive.export_archive(df, f"{tmp_path}/a", F.expr("cast(substring(event_id, 2, 1) as int)"), ["event_id"])
    for size in (777, 64 << 20):
        read = archive.read_archive(spark, f"{tmp_path}/a", size).cache()
        got = read.where("record is not null").select(F.from_json("record", SCHEMA).alias("r"), "line").select("r.*", "line").collect()
        assert sorted(tuple(r)[:3] for r in got) == rows
        assert sorted(r.line for r in got) == sorted(list(range(2, 1002)) * 3)
        assert read.where("error is not null").count() == 0
    source = spark.read.format("event_archive").option("path", f"{tmp_path}/a").option("split_bytes", "20000").load()
    assert source.rdd.getNumPartitions() > 5


@pytest.mark.parametrize("size", [5, 40, 64 << 20])
def test_lines_that_are_no_records(spark, tmp_path, size):
    good = "\n".join([HEAD, line("a"), "", "[1]", '{"type": "note"}', HEAD, '{"type": "event", "data": 3}', "{"]) + "\n"
    (tmp_path / "good.jsonl").write_bytes(good.encode() + b"\xff\n" + line("z").encode())
    (tmp_path / "headless.jsonl").write_text(line("b") + "\n")
    (tmp_path / "version.jsonl").write_text(HEAD.replace("1", "2") + "\n" + line("b"))
    (tmp_path / "empty.jsonl").write_text("")
    rows = archive.read_archive(spark, str(tmp_path), size).collect()
    found = {(r.file.rsplit("/", 1)[1].split(".")[0], r.line): r.error for r in rows}
    wrong = ["not JSON", "not an object", "unsupported record", "header not at the start", "unsupported record", "not JSON", "not UTF-8"]
    want = {("good", k + 3): w for k, w in enumerate(wrong)} | {("good", 1): None, ("good", 2): None, ("good", 10): None}
    want |= {("headless", 1): "no header before events", ("version", 1): "unsupported version", ("version", 2): "no header before events"}
    assert found == want


def test_a_file_stops_at_the_batch_that_fails(spark, tmp_path):
    lines = [HEAD, *(line(f"e{i}") for i in range(250))]
    lines[130] = line("e5", 9.0)
    lines[180] = "broken"
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl").write_text("\n".join([HEAD, line("x"), line("x"), line("known"), line(None)]))
    (tmp_path / "c.jsonl").write_text("\n".join([HEAD, line("y"), line("y"), line("known")]))
    log = spark.createDataFrame([("known", 1.0, "t")], SCHEMA)
    imported = archive.import_archive(archive.read_archive(spark, str(tmp_path)), log)
    report = {r.file[-7]: tuple(r)[1:] for r in archive.import_report(imported).collect()}
    assert report == {"a": (100, 100, 0, 2, 181, "not JSON"), "b": (0, 0, 0, 1, 5, "no id"), "c": (3, 1, 2, None, None, None)}
    kinds = {r.outcome: r["count"] for r in imported.groupBy("outcome").count().collect()}
    assert kinds == {"created": 101, "skipped": 2, "failed": 2, "not_reached": 152}
