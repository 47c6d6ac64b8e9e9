"""Event archives: out, in, and what an import reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.sources import archive
from tessera.sources.benchmarks import long_memory_cases
from tessera.sources.scratch import shared_dir, stored
from tessera.sources.tables import table

#: Events of one file of an archive.
FILE_EVENTS = 5000


def fresh(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("a07_export_import", "select event_id, ts, user_id, event_type, value, props, event_id // 5000 as file, row_number() over (partition by event_id // 5000 order by ts, event_id) + 1 as line from events")
def export_import(spark, d):
    """All events to archives and back: each with the file and line that it came from."""
    events, path = table(spark, d, "events"), fresh(spark, "archive")
    archive.export_archive(events, path, F.floor(F.col("event_id") / FILE_EVENTS), ["ts", "event_id"])
    rows = archive.read_archive(spark, path, 1 << 20).where("record is not null").withColumn("row", F.from_json("record", events.schema, archive.FORMAT))
    return rows.select("row.*", F.regexp_extract("file", "file=([0-9]+)", 1).cast("long").alias("file"), "line")


# What is wrong with some lines of the archive: broken, of no known kind, without an id, with another payload.
IMPORT = """with l as (select event_id, event_id // 5000 as file, row_number() over (partition by event_id // 5000 order by event_id) + 1 as line,
    case when event_id % 9001 = 4321 then 'not JSON' when event_id % 7001 = 6000 then 'unsupported record' when event_id % 6007 = 5000 then 'no id' when event_id % 5003 = 4000 then 'conflict' end as why,
    event_id % 10 < 3 or event_id % 5003 = 4000 as known from events),
b as (select *, (line - 2) // 100 as batch, case when why in ('not JSON', 'unsupported record') then 0 else 1 end as rank from l),
s as (select file, min({'batch': batch, 'rank': rank, 'line': line}) as stop from b where why is not null group by file)
select file, count(*) filter (batch < coalesce(stop.batch, 1e18)) as processed, count(*) filter (batch < coalesce(stop.batch, 1e18) and not known) as events_created,
    count(*) filter (batch < coalesce(stop.batch, 1e18) and known) as events_skipped, max(batch + 1) filter (line = stop.line) as failed_batch, max(line) filter (line = stop.line) as failed_line,
    max(why) filter (line = stop.line) as error
from b left join s using (file) group by file"""


@query("a08_import_report", IMPORT)
def import_report(spark, d):
    """Archives of all events, some lines of which are broken, into a log that has three events of ten already."""
    events, path = table(spark, d, "events"), fresh(spark, "archive")
    hits = lambda by, at: F.col("event_id") % by == at
    data = F.struct(F.when(~hits(6007, 5000), F.col("event_id")).alias("event_id"), *(c for c in events.columns if c != "event_id"))
    row = F.to_json(F.struct(F.when(hits(7001, 6000), "note").otherwise("event").alias("type"), data.alias("data")), archive.FORMAT)
    row = F.when(hits(9001, 4321), F.substring(row, 1, 30)).otherwise(row)
    archive.write_archive(events.select(F.floor(F.col("event_id") / FILE_EVENTS).alias("file"), F.col("event_id").alias("at"), row.alias("value")), path)
    log = events.where((F.col("event_id") % 10 < 3) | hits(5003, 4000)).withColumn("value", F.when(hits(5003, 4000), -1.0).otherwise(F.col("value")))
    rows = stored(archive.read_archive(spark, path, 1 << 20), "archive-lines")
    report = archive.import_report(archive.import_archive(rows, log))
    return report.withColumn("file", F.regexp_extract("file", "file=([0-9]+)", 1).cast("long"))


# Conversations as a benchmark's records: a list and an object for a session, times and roles under several names.
CASES = """with m as (select conv_id, turn, text, role, case when turn < 3 then '0' else 's' || conv_id end as session_id, row_number() over (partition by conv_id order by turn) - 1 as place from conversations where conv_id % 10 <> 0 and turn is not null)
select 'c' || conv_id as case_id, 'lme:c' || conv_id || ':' || session_id || ':' || case when turn < 3 then turn else place end as event_id, place,
    case when turn >= 3 and role = 'assistant' then 'assistant' when turn >= 3 then 'user' when role in ('user', 'assistant', 'system', 'tool') then role else 'user' end as actor_type, sha256(coalesce(text, '')) as sha,
    case when turn < 3 then '2024-05-0' || (turn + 1) else '2000-01-01T00:00:0' || place || '+00:00' end as occurred_at, turn = 1 and conv_id % 2 = 0 as gold
from m"""


@query("a09_benchmark_cases", CASES)
def benchmark_cases(spark, d):
    """Records of a conversation each, some without an id, as events; those that the answer names are marked."""
    early, rows = F.col("turn") < 3, table(spark, d, "conversations").where("turn is not null")
    message = F.when(early, F.to_json(F.struct(F.col("turn").cast("string").alias("message_id"), "role", F.col("text").alias("content"), F.concat(F.lit("2024-05-0"), F.col("turn") + 1).alias("date"))))
    message = message.otherwise(F.to_json(F.struct(F.when(F.col("role") == "assistant", "AI").otherwise("human").alias("speaker"), "text")))
    listed = lambda cond: F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("turn", message.alias("m"))))), lambda x: x.m), ","), F.lit("]"))
    records = rows.groupBy("conv_id").agg(listed(early).alias("a"), listed(~early).alias("b"))
    head = F.when(F.col("conv_id") % 10 != 0, F.concat(F.lit('"question_id": "c'), F.col("conv_id"), F.lit('", '))).otherwise(F.lit(""))
    gold = F.when(F.col("conv_id") % 2 == 0, F.lit('"answer_message_ids": ["0:1", "none"], ')).otherwise(F.lit(""))
    record = F.concat(F.lit("{"), head, gold, F.lit('"sessions": ['), F.col("a"), F.lit(', {"id": "s'), F.col("conv_id"), F.lit('", "messages": '), F.col("b"), F.lit("}]}"))
    events, cases, _ = long_memory_cases(records.select(record.alias("record")))
    named = cases.select(F.explode("gold").alias("event_id"), F.lit(True).alias("gold"))
    found = events.join(named, "event_id", "left")
    return found.select("case_id", "event_id", F.col("place").cast("long").alias("place"), "actor_type", F.sha2("text", 256).alias("sha"), "occurred_at", F.coalesce("gold", F.lit(False)).alias("gold"))
