"""Benchmark files of long conversations as events, cases and what was refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import stored

# Names of the fields in the files, the time that stands for none, and the kinds of actors.
CASE_IDS, SESSIONS, GOLD = ("question_id", "case_id", "id"), ("haystack_sessions", "sessions", "messages"), ("answer_message_ids", "gold_message_ids", "answer_session_ids")
TIMES, EPOCH = ("timestamp", "date", "occurred_at"), "2000-01-01T00:00:00"
ACTORS, ALIASES = ("user", "assistant", "system", "tool"), {"human": "user", "ai": "assistant"}
_MESSAGE = "struct<message_id: string, id: string, role: string, speaker: string, content: string, text: string, timestamp: string, date: string, occurred_at: string, valid_to: string>"


def _first(*values: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def _field(record: Column | str, names: tuple[str, ...]) -> Column:
    return _first(*(F.get_json_object(record, f"$.{n}") for n in names))


def long_memory_cases(records: DataFrame, subset: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events, cases and rejects of ``records`` (``record``, a JSON object each); ``subset`` (``case_id``) are those wanted.

    A case has sessions, as objects with ``messages`` or as lists of messages. Events are
    ``case_id, event_id, session_id, message_id, place, actor_type, text, occurred_at, recorded_at, valid_to``, numbered over the
    case; a message without a time happens ``place`` seconds after 2000. Cases are ``case_id, query, category, answer, gold``:
    the events that the record names by message id, or by session and message id where a message id is not unique.
    Records that are no objects or lack an id, and cases that come twice or have two messages of one id, are refused.
    """
    case_id = _field("record", CASE_IDS)
    rows = records.select("record", F.when(F.coalesce(F.trim("record").startswith("{") & F.get_json_object("record", "$").isNotNull(), F.lit(False)), case_id).alias("case_id"))
    rows = rows.withColumn("copies", F.count("*").over(Window.partitionBy("case_id")))
    why = F.when(F.col("case_id").isNull(), F.when(F.trim("record").startswith("{"), "no case id").otherwise("not an object")).when(F.col("copies") > 1, "duplicate case id")
    rows = stored(rows.withColumn("why", why), "benchmark-records")
    good = rows.where("why is null")
    if subset is not None:
        good = good.join(subset.select("case_id").distinct(), "case_id", "left_semi")

    listed = F.coalesce(*(F.when(F.size(F.from_json(F.get_json_object("record", f"$.{n}"), "array<string>")) > 0, F.get_json_object("record", f"$.{n}")) for n in SESSIONS))
    sessions = good.select("case_id", F.posexplode(F.from_json(listed, "array<string>")).alias("at", "session"))
    an_object = F.col("session").startswith("{")
    key = F.when(an_object, _first(_field("session", ("session_id", "id")), F.col("at").cast("string"))).otherwise(F.col("at").cast("string"))
    items = F.from_json(F.when(an_object, F.get_json_object("session", "$.messages")).otherwise(F.col("session")), f"array<{_MESSAGE}>")
    messages = sessions.select("case_id", "at", key.alias("session_id"), F.posexplode(items).alias("item", "m")).where("m is not null")
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("at", "item")) - 1
    messages = messages.withColumn("place", place)
    role = F.lower(_first(F.col("m.role"), F.col("m.speaker"), F.lit("user")))
    for name, actor in ALIASES.items():
        role = F.when(role == name, actor).otherwise(role)
    message_id = _first(F.col("m.message_id"), F.col("m.id"), F.col("place").cast("string"))
    recorded = F.date_format(F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("place").cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    events = messages.select(
        "case_id", F.concat_ws(":", F.lit("lme"), "case_id", "session_id", message_id).alias("event_id"), "session_id", message_id.alias("message_id"), "place",
        F.when(role.isin(*ACTORS), role).otherwise("user").alias("actor_type"), F.coalesce(_first(F.col("m.content"), F.col("m.text")), F.lit("")).alias("text"),
        F.coalesce(_first(*(F.col(f"m.{t}") for t in TIMES)), recorded).alias("occurred_at"), recorded.alias("recorded_at"), F.nullif("m.valid_to", F.lit("")).alias("valid_to"),
    )
    events = stored(events.withColumn("same", F.count("*").over(Window.partitionBy("event_id"))).withColumn("twins", F.count("*").over(Window.partitionBy("case_id", "message_id"))), "benchmark-events")
    doubled = events.where("same > 1").select("case_id").distinct()
    events, good = events.join(doubled, "case_id", "left_anti"), good.join(doubled, "case_id", "left_anti")

    wanted = F.coalesce(*(F.get_json_object("record", f"$.{n}") for n in GOLD))
    names = F.when(wanted.startswith("["), F.from_json(wanted, "array<string>")).otherwise(F.array(wanted))
    gold = good.where(wanted.isNotNull()).select("case_id", F.posexplode(names).alias("order", "name"))
    known = events.select("case_id", F.concat_ws(":", "session_id", "message_id").alias("name"), "event_id").unionByName(events.where("twins = 1").select("case_id", F.col("message_id").alias("name"), "event_id"))
    gold = gold.join(known, ["case_id", "name"]).groupBy("case_id", "event_id").agg(F.min("order").alias("order")).groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("order", "event_id"))), lambda g: g.event_id).alias("gold"))
    none = F.array().cast("array<string>")
    cases = good.join(gold, "case_id", "left").select("case_id", F.coalesce(_field("record", ("question", "query")), F.lit("")).alias("query"), F.coalesce(_field("record", ("category", "question_type")), F.lit("uncategorized")).alias("category"), _field("record", ("answer", "gold_answer")).alias("answer"), F.coalesce("gold", none).alias("gold"))
    rejects = rows.where("why is not null").select("record", "why").unionByName(rows.join(doubled, "case_id", "left_semi").where("why is null").select("record", F.lit("duplicate message id").alias("why")))
    return events.drop("same", "twins"), cases, rejects
