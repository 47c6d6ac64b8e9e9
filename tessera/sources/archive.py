"""Event archives: JSON lines after a header, written in files of bounded size and read in ranges of bytes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.sources.event_log import content_hash

#: The format's version, and the records that are taken or refused together.
VERSION, BATCH = 1, 100
#: How rows become JSON and back: nulls are written, and times have all their places.
FORMAT = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
LINE = "file string, split int, line long, record string, error string"


def export_archive(events: DataFrame, path: str, file: Column, order: list[str]) -> None:
    """Write rows as ``{"type": "event", "data": ...}`` lines in ``order``, a folder for each value of ``file``.

    Each file starts with a header line. Nulls are written, so that what is read back is the same.
    """
    row = F.to_json(F.struct(F.lit("event").alias("type"), F.struct(*events.columns).alias("data")), FORMAT)
    write_archive(events.select(file.alias("file"), F.struct(*order).alias("at"), row.alias("value")), path)


def write_archive(lines: DataFrame, path: str) -> None:
    """Write lines (``file, at, value``) of archives as they are, each file under its header."""
    header = json.dumps({"type": "metadata", "format_version": VERSION})
    heads = lines.select("file").distinct().select("file", F.lit(None).cast(lines.schema["at"].dataType).alias("at"), F.lit(header).alias("value"))
    rows = lines.select("file", "at", "value").unionByName(heads).repartition("file").sortWithinPartitions("file", "at")
    rows.select("file", "value").write.mode("error").partitionBy("file").text(path)


class _Range(InputPartition):
    def __init__(self, path: str, split: int, start: int, end: int):
        self.path, self.split, self.start, self.end = path, split, start, end


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def checked(raw: bytes, first: bool, headed: bool) -> tuple[str | None, str | None]:
    """The record of a line, or why it is none; a header in its place is neither."""
    try:
        record = json.loads(raw.decode())
    except UnicodeDecodeError:
        return None, "not UTF-8"
    except json.JSONDecodeError:
        return None, "not JSON"
    if not isinstance(record, dict):
        return None, "not an object"
    if record.get("type") == "metadata":
        if not first:
            return None, "header not at the start"
        return None, None if record.get("format_version") == VERSION else "unsupported version"
    if record.get("type") != "event" or not isinstance(record.get("data"), dict):
        return None, "unsupported record"
    if not headed:
        return None, "no header before events"
    return json.dumps(record["data"], ensure_ascii=False, separators=(",", ":")), None


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[InputPartition]:
        system, root = _filesystem(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
        return [_Range(p, k, at, min(at + self.size, n)) for p, n in files for k, at in enumerate(range(0, n, self.size))]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        """A range has the lines that start in it; the line that crosses its end is read whole."""
        system, _ = _filesystem(self.path)
        rows: list[tuple] = []
        with system.open_input_file(partition.path) as stream:
            size, headed = stream.size(), False
            lines = _lines(stream, 0, size)
            head = next(lines, (0, b""))[1]
            headed = checked(head, True, True) == (None, None)
            for n, (at, raw) in enumerate(_lines(stream, partition.start, size)):
                if at >= partition.end:
                    break
                record, error = checked(raw, at == 0, headed)
                if record or error:
                    rows.append((partition.path, partition.split, n + 1, record, error))
                else:
                    rows.append((partition.path, partition.split, n + 1, None, None))
                if len(rows) == 10_000:
                    yield _batch(rows)
                    rows = []
        yield _batch(rows)


def _lines(stream: pa.NativeFile, start: int, size: int, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Where each line that starts at ``start`` or later does, and its bytes."""
    at, rest = max(start - 1, 0), b""
    skip = start > 0
    while at + len(rest) < size:
        block = stream.read_at(min(chunk, size - at - len(rest)), at + len(rest))
        whole = (rest + block).split(b"\n")
        rest = whole.pop()
        for raw in whole:
            if not skip:
                yield at, raw
            skip = False
            at += len(raw) + 1
    if rest and not skip:
        yield at, rest


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["file", "split", "line", "record", "error"])


class EventArchive(DataSource):
    """``spark.read.format("event_archive").option("path", ...)``: a row for each line, with its record or its error.

    Option ``split_bytes`` (64 MB) bounds what one task reads; ``line`` counts from 1 in its split.
    """

    @classmethod
    def name(cls) -> str:
        return "event_archive"

    def schema(self) -> str:
        return LINE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("split_bytes", 64 << 20)))


def read_archive(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """``file, line, record, error``: all lines of all files under ``path``, numbered from 1 in their files."""
    spark.dataSource.register(EventArchive)
    rows = spark.read.format("event_archive").option("path", path).option("split_bytes", str(split_bytes)).load()
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("file", "split").agg(F.max("line").alias("n")).select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("above"))
    return rows.join(sizes, ["file", "split"]).select("file", (F.col("above") + F.col("line")).alias("line"), "record", "error")


def import_archive(rows: DataFrame, log: DataFrame, key: str = "event_id") -> DataFrame:
    """``file, line, batch, <columns of log>, outcome, error`` for each line of ``rows`` (``read_archive``) but headers.

    Records go in batches of 100, and a file stops at its first batch that fails: ``created`` and ``skipped`` (a known id
    with the same payload) are of batches before it, ``failed`` is the line that failed it, ``not_reached`` the rest. A
    batch fails by its first line that is no record, or else by the first record without an id or whose id is known, from
    the log or an earlier line of any file, with another payload.
    """
    columns = [c for c in log.columns if c != key]
    parsed = rows.where("record is not null or error is not null").withColumn("row", F.from_json("record", log.schema, FORMAT))
    parsed = parsed.select("file", "line", F.floor((F.col("line") - 2) / BATCH).alias("batch"), "row.*", "error").withColumn("payload", content_hash(columns))
    known = log.select(key, content_hash(columns).alias("logged"))
    firsts = parsed.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("file", "line", "payload")).alias("first"))
    parsed = parsed.join(known, key, "left").join(firsts, key, "left")
    clash = F.coalesce(F.col("logged"), F.col("first.payload")) != F.col("payload")
    new = F.col("logged").isNull() & (F.col("first.file") == F.col("file")) & (F.col("first.line") == F.col("line"))
    why = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col(key).isNull(), F.lit("no id")).when(clash, F.lit("conflict"))
    # Lines that are no records fail a batch before its records are tried.
    rank = F.when(F.col("error").isNotNull(), 0).otherwise(1)
    parsed = parsed.withColumn("why", why).withColumn("new", new)
    stops = parsed.where("why is not null").groupBy("file").agg(F.min(F.struct("batch", rank.alias("rank"), "line")).alias("stop"))
    parsed = parsed.join(stops, "file", "left")
    outcome = F.when(F.col("batch") < F.coalesce(F.col("stop.batch"), F.lit(2**62)), F.when(F.col("new"), "created").otherwise("skipped"))
    outcome = F.coalesce(outcome, F.when(F.col("stop.line") == F.col("line"), F.lit("failed")).otherwise("not_reached"))
    return parsed.select("file", "line", (F.col("batch") + 1).alias("batch"), *log.columns, outcome.alias("outcome"), F.when(outcome == "failed", F.col("why")).alias("error"))


def import_report(imported: DataFrame) -> DataFrame:
    """A row for each file: what was processed, created and skipped, and where and why it failed."""
    count = lambda *o: F.count_if(F.col("outcome").isin(*o))
    failed = lambda c: F.max(F.when(F.col("outcome") == "failed", F.col(c)))
    return imported.groupBy("file").agg(count("created", "skipped").alias("processed"), count("created").alias("events_created"), count("skipped").alias("events_skipped"), failed("batch").alias("failed_batch"), failed("line").alias("failed_line"), failed("error").alias("error"))
