"""Messages and events: windows, filters, keys, duplicates, conflicts and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.vector import cosine
from tessera.operators import dedup as D
from tessera.operators import experience as E
from tessera.operators.ranking import placed
from tessera.plans.facts import H, history
from tessera.plans.registry import query
from tessera.plans.retrieval import COS
from tessera.sources.tables import table


@query("s02_micro_windows", "select conv_id, (place - 1) // 5 as window_no, count(*) as messages, min(turn) as first_turn, max(turn) as last_turn from (select *, row_number() over (partition by conv_id order by turn) as place from conversations) group by all")
def micro_windows(spark, d):
    w = E.micro_windows(table(spark, d, "conversations"), ["conv_id"], ["turn"])
    return w.groupBy("conv_id", "window_no").agg(F.count("*").alias("messages"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


SESSIONS = """with g as (select *, case when ts - lag(ts) over w <= interval 6 hour then 0 else 1 end as fresh from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as session_no from g)
"""


@query("s_session_windows", SESSIONS + "select user_id, session_no, count(*) as n, min(ts) as started, max(ts) as ended, round(sum(value), 4) as total from s group by all")
def session_windows(spark, d):
    s = E.sessions(table(spark, d, "events"), "user_id", "ts", "event_id", "6 hours")
    return s.groupBy("user_id", "session_no").agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"), F.round(F.sum("value"), 4).alias("total"))


@query("s_tumbling", "select date_trunc('day', ts) as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def tumbling(spark, d):
    w = table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("day"), "event_type", "n", "total")


@query("s_sliding", "select date_trunc('day', ts) - to_days(k) as start, count(*) as n, round(sum(value), 3) as total from events, (select unnest([0, 1]) as k) group by 1")
def sliding(spark, d):
    w = table(spark, d, "events").groupBy(F.window("ts", "2 days", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return w.select(F.col("w.start").alias("start"), "n", "total")


@query("s10_idempotent", "select user_id, event_type, k, min(event_id) as event_id from (select *, json_extract_string(props, '$.k')::int as k from events) group by all")
def idempotent(spark, d):
    rows = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return E.first_of_key(rows, ["user_id", "event_type", "k"], [F.col("event_id")]).select("user_id", "event_type", "k", "event_id")


@query("s11_late_snapshot", """select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as version, o_orderdate < coalesce(max(o_orderdate) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), o_orderdate) as late from orders""")
def late_snapshot(spark, d):
    """Orders arrive by key; one dated before something that arrived earlier is late, and is placed by its date."""
    arrived = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    late = F.col("o_orderdate") < F.coalesce(F.max("o_orderdate").over(arrived), F.col("o_orderdate"))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(order).cast("long").alias("version"), late.alias("late"))


@query("s15_daily_budget", "select event_id, day, round(used, 3) as used, used <= 3000 as allowed from (select event_id, strftime(ts, '%Y-%m-%d') as day, sum(value) over (partition by ts::date order by ts, event_id rows unbounded preceding) as used from events)")
def daily_budget(spark, d):
    rows = placed(table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "event_id", "value"), ["day"], ["ts", "event_id"], "value")
    return rows.select("event_id", "day", F.round("upto", 3).alias("used"), (F.col("upto") <= 3000).alias("allowed"))


@query("b09_json_path", "select event_id, json_extract_string(props, '$.k')::int as k from events where json_extract_string(props, '$.k')::int >= 50")
def json_path(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select("event_id", k.alias("k")).where("k >= 50")


@query("c07_json_join", "select e.event_id, l.quality from events e left join labels l on l.doc_id = json_extract_string(e.props, '$.k')::bigint where e.event_type = 'signup'")
def json_join(spark, d):
    e = table(spark, d, "events").where("event_type = 'signup'").withColumn("doc_id", F.get_json_object("props", "$.k").cast("long"))
    return e.join(table(spark, d, "labels"), "doc_id", "left").select("event_id", "quality")


BARE = "lower(trim(coalesce(text, ''), ' '))"


@query("b11_event_filter", f"""select conv_id, turn, case when length({BARE}) < 5 then 'too_short' when regexp_matches({BARE}, '^(ok|okay|yes|no|thanks|thank you|got it|done)[.!]*$') then 'acknowledgement' when regexp_matches({BARE}, '^[{{\\[].*[}}\\]]$') then 'raw_output'
  when length({BARE}) < 40 and regexp_matches({BARE}, '^(status|progress|state):') then 'status_report' else 'keep' end as verdict from conversations""")
def event_filter(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(X.event_filter_reason(F.col("text")), F.lit("keep")).alias("verdict"))


@query("b14_secret_scan", r"""select doc_id, case when regexp_matches(text, '(?i)(recovery|backup) code') then 'recovery_code' when regexp_matches(text, '(?i)(password|passwd|secret|api[_-]?key|token)[ ]*[:=]') then 'assignment'
  when regexp_matches(text, 'sk-[A-Za-z0-9]{16,}') then 'key_prefix' when regexp_matches(text, '\b(AKIA|ghp_|xox[bp]-)[A-Za-z0-9-]{8,}') then 'key_prefix' else 'none' end as reason from documents where text is not null""")
def secret_scan(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.coalesce(X.secret_reason(F.col("text")), F.lit("none")).alias("reason"))


LINE = "(select doc_id, unnest(string_split(text, chr(10))) as line from documents)"


@query("b15_low_value_lines", f"""select reason, count(*) as n from (select case when trim(line, ' ') = '' then 'empty' when regexp_matches(trim(line, ' '), '^[vV]?[0-9]+([.][0-9]+)*[.]?$') then 'number_or_version' when lower(trim(line, ' ')) in ('ok','healthy','running','up','down','done') then 'health_word'
  when length(trim(line, ' ')) < 5 then 'too_short' else 'keep' end as reason from {LINE}) group by 1""")
def low_value_lines(spark, d):
    lines = table(spark, d, "documents").where("text is not null").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(F.coalesce(X.low_value_reason(F.col("line")), F.lit("keep")).alias("reason")).agg(F.count("*").alias("n"))


@query("t01_structure", "select doc_id, case when text like '% | %' then 'table' when len(string_split(text, chr(10))) > 1 then 'lines' else 'text' end as structure from documents where text is not null")
def structure(spark, d):
    kind = F.when(F.col("text").contains(" | "), "table").when(F.size(F.split("text", "\n")) > 1, "lines").otherwise("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", kind.alias("structure"))


@query("t02_chunks")
def chunks(spark, d):
    c = E.chunk(table(spark, d, "documents").select("doc_id", "text"), "text", 1000)
    return c.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.length("chunk_text").cast("long").alias("n_chars"), F.sha2("chunk_text", 256).alias("sha"))


@query("t09_evidence_links", "select conv_id, string_agg(turn::varchar, ',' order by turn) filter (role = 'user') as user_turns, count(distinct role) as roles from conversations group by 1")
def evidence_links(spark, d):
    turns = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == "user", F.col("turn")))), lambda x: x.cast("string")), ",")
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("turns"), F.count_distinct("role").alias("roles"))
    return rows.select("conv_id", F.when(F.col("turns") != "", F.col("turns")).alias("user_turns"), "roles")


@query("y01_raw_sessions", "select conv_id, count(*) as turns, sum(length(text))::bigint as n_chars, sha256(string_agg(role || ': ' || text, chr(10) order by turn)) as sha from conversations group by 1")
def raw_sessions(spark, d):
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("t")))), lambda x: x["t"]), "\n")
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("n_chars"), F.sha2(joined, 256).alias("sha"))


@query("y03_turn_windows", "select a.conv_id, a.turn, count(*) as near, sum(length(b.text))::bigint as n_chars from conversations a join conversations b on a.conv_id = b.conv_id and b.turn between a.turn - 1 and a.turn + 1 group by all")
def turn_windows(spark, d):
    near = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(-1, 1)
    return table(spark, d, "conversations").select("conv_id", "turn", F.count("*").over(near).alias("near"), F.sum(F.length("text")).over(near).alias("n_chars"))


@query("k15_echo", "with l as (select conv_id, max(turn) as last from conversations group by 1) select conv_id, turn, turn >= last - 1 as suppressed from conversations join l using (conv_id) where role = 'assistant'")
def echo(spark, d):
    """What was said in a session's last two turns is not told back to it."""
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    rows = table(spark, d, "conversations").withColumn("suppressed", F.col("turn") >= last - 1)
    return rows.where("role = 'assistant'").select("conv_id", "turn", "suppressed")


@query("k21_session_context", """with r as (select *, sum((length(text) + 1) // 2) over (partition by conv_id order by turn desc rows unbounded preceding) as used from conversations)
  select conv_id, count(*) as turns, max(used)::bigint as used from r where used <= 600 group by 1""")
def session_context(spark, d):
    back = Window.partitionBy("conv_id").orderBy(F.col("turn").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = table(spark, d, "conversations").withColumn("used", F.sum(F.floor((F.length("text") + 1) / 2)).over(back))
    return rows.where("used <= 600").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("used").alias("used"))


@query("d02_span_stats", "select event_type, strftime(ts, '%Y-%m-%d') as day, count(*) as calls, round(sum(value), 4) as tokens, round(avg(value), 6) as mean_latency from events group by all")
def span_stats(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("tokens"), F.round(F.avg("value"), 6).alias("mean_latency"))


@query("d03_status_counts", "select o_orderstatus as status, count(*) as n from orders group by 1")
def status_counts(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("d04_having", "select o_custkey, o_orderstatus, count(*) as n from orders group by 1, 2 having count(*) > 3")
def having(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n")).where("n > 3")


@query("d05_collisions", "select source, count(*) as n, count(distinct sha256(coalesce(text, ''))) as texts from documents group by 1")
def collisions(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("texts"))


@query("d06_generations", H + "select o_custkey, max(version) as latest, max(version) filter (status = 'superseded') as latest_closed, max(o_orderkey) filter (status = 'active') as open_key from h group by 1")
def generations(spark, d):
    when = lambda s, c: F.max(F.when(F.col("status") == s, F.col(c)))
    return history(spark, d).groupBy("o_custkey").agg(F.max("version").alias("latest"), when("superseded", "version").alias("latest_closed"), when("active", "o_orderkey").alias("open_key"))


@query("d07_eligibility", "select o_orderpriority, count(*) as n, count(*) filter (o_orderdate < timestamp '1997-01-01') as old, count(*) filter (o_orderdate < timestamp '1997-01-01' and o_orderstatus = 'F') as eligible from orders group by 1")
def eligibility(spark, d):
    old = F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(old).alias("old"), F.count_if(old & (F.col("o_orderstatus") == "F")).alias("eligible"))


RANKED = "with r as (select event_type, value, row_number() over (partition by event_type order by value, event_id) as k, count(*) over (partition by event_type) as n from events)"


def ranked_values(spark, d):
    rows = placed(table(spark, d, "events").select("event_type", "value", "event_id"), ["event_type"], ["value", "event_id"])
    return rows.select("event_type", "value", F.col("place").alias("k"), F.col("members").alias("n"))


@query("d13_percentiles", RANKED + "select event_type, max(value) filter (k = ceil(0.5 * n)) as p50, max(value) filter (k = ceil(0.95 * n)) as p95, max(value) filter (k = ceil(0.99 * n)) as p99 from r group by 1")
def percentiles(spark, d):
    at = lambda p: F.max(F.when(F.col("k") == F.ceil(F.lit(p) * F.col("n")), F.col("value")))
    return ranked_values(spark, d).groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


@query("d14_daily_report", "with r as (select strftime(ts, '%Y-%m-%d') as day, event_type, value, row_number() over (partition by ts::date order by value, event_id) as k, count(*) over (partition by ts::date) as n from events) select day, count(*) as calls, round(count(*) filter (event_type <> 'error') / count(*)::double, 6) as success, max(value) filter (k = greatest(1, floor(0.95 * n))) as p95 from r group by 1")
def daily_report(spark, d):
    rows = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", "value", "event_id")
    rows = placed(rows, ["day"], ["value", "event_id"]).select("day", "event_type", "value", F.col("place").alias("k"), F.col("members").alias("n"))
    p95 = F.max(F.when(F.col("k") == F.greatest(F.lit(1), F.floor(F.lit(0.95) * F.col("n"))), F.col("value")))
    return rows.groupBy("day").agg(F.count("*").alias("calls"), F.round(F.count_if(F.col("event_type") != "error") / F.count("*"), 6).alias("success"), p95.alias("p95"))


@query("d16_group_collapse", "select o_custkey, o_orderstatus, min(o_orderkey) as representative, count(*) as support, min(o_orderdate) as first_seen, max(o_orderdate) as last_seen from orders group by 1, 2")
def group_collapse(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderkey").alias("representative"), F.count("*").alias("support"), F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("last_seen"))


@query("n01_exact_groups", "select sha256(coalesce(text, '')) as key, min(doc_id) as keep, count(*) as copies from documents group by 1 having count(*) > 1")
def exact_groups(spark, d):
    return D.exact_groups(table(spark, d, "documents"), F.sha2(F.coalesce("text", F.lit("")), 256), "doc_id")


@query("h10_pair_key", "select a.o_orderkey as left_key, b.o_orderkey as right_key, substr(sha256(concat_ws(chr(31), least(a.o_orderkey, b.o_orderkey), greatest(a.o_orderkey, b.o_orderkey))), 1, 16) as pair_key from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderdate = b.o_orderdate and a.o_orderkey <> b.o_orderkey")
def pair_key(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    pairs = o.select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("left_key")).join(o.withColumnRenamed("o_orderkey", "right_key"), ["o_custkey", "o_orderdate"]).where("left_key <> right_key")
    return pairs.select("left_key", "right_key", X.pair_key(F.col("left_key"), F.col("right_key")).alias("pair_key"))


@query("c15_label_band", f"select a.vec_id as left_id, b.vec_id as right_id, round({COS}, 6) as score from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id where round({COS}, 6) >= 0.35 and round({COS}, 6) < 1.1")
def label_band(spark, d):
    return D.similar_pairs(table(spark, d, "embeddings"), "label", 0.35, 1.1)


@query("n05_near_copies")
def near_copies(spark, d):
    """Links between classes of lines alike in wording, among the different lines of all documents."""
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''").distinct()
    return D.near_copy_links(lines.select("line", F.sha2("line", 256).alias("line_id")))


RES = """with p as (select o_custkey, o_orderkey, o_orderstatus, o_orderdate, o_orderpriority, lag(o_orderstatus) over w as was, lag(o_orderdate) over w as was_at from orders window w as (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey)),
r as (select *, case when o_orderstatus = was then 'entails' when o_orderpriority not in ('1-URGENT','2-HIGH') then 'compatible' when o_orderdate > was_at then 'state_change' when o_orderdate = was_at then 'contradicts' else 'uncertain' end as outcome from p where was is not null)
"""


def resolved(spark, d):
    order = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    p = table(spark, d, "orders").withColumns({"was": F.lag("o_orderstatus").over(order), "was_at": F.lag("o_orderdate").over(order)}).where("was is not null")
    outcome = D.resolve(F.col("o_orderstatus") == F.col("was"), F.col("o_orderdate") == F.col("was_at"), F.col("o_orderdate") > F.col("was_at"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return p.withColumn("outcome", outcome)


@query("o01_resolver", RES + "select o_orderkey, outcome from r")
def resolver(spark, d):
    return resolved(spark, d).select("o_orderkey", "outcome")


@query("o02_group_outcome", RES + "select o_custkey, o_orderpriority, case when count(distinct outcome) = 1 and count(*) filter (o_orderstatus = 'O') <= 1 then min(outcome) else 'uncertain' end as outcome from r group by 1, 2")
def group_outcome(spark, d):
    return resolved(spark, d).groupBy("o_custkey", "o_orderpriority").agg(D.group_outcome(F.col("outcome"), F.col("o_orderstatus") == "O").alias("outcome"))


@query("o10_auto_resolve", "select o_custkey, o_orderpriority, count(*) filter (o_orderstatus = 'O') as living, case count(*) filter (o_orderstatus = 'O') when 0 then 'obsolete' when 1 then 'resolved' else 'manual' end as decision, case when count(*) filter (o_orderstatus = 'O') = 1 then max(o_orderkey) filter (o_orderstatus = 'O') end as winner from orders group by 1, 2")
def auto_resolve(spark, d):
    living = F.count_if(F.col("o_orderstatus") == "O")
    rows = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(living.alias("living"), F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey"))).alias("key"))
    decision = F.when(F.col("living") == 0, "obsolete").when(F.col("living") == 1, "resolved").otherwise("manual")
    return rows.select("o_custkey", "o_orderpriority", "living", decision.alias("decision"), F.when(F.col("living") == 1, F.col("key")).alias("winner"))


@query("o13_invariants", "select o_custkey, o_orderpriority, count(*) as active from orders where o_orderstatus = 'O' and o_orderpriority in ('1-URGENT','2-HIGH') group by 1, 2 having count(*) > 1")
def invariants(spark, d):
    active = table(spark, d, "orders").where((F.col("o_orderstatus") == "O") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return active.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("active")).where("active > 1")


@query("o12_rivals", "select a.o_orderkey, count(b.o_orderkey) as rivals from orders a left join orders b on a.o_custkey = b.o_custkey and a.o_orderpriority = b.o_orderpriority and b.o_orderstatus = 'P' and b.o_orderkey <> a.o_orderkey where a.o_orderstatus = 'O' group by 1")
def rivals(spark, d):
    o = table(spark, d, "orders")
    disputed = o.where("o_orderstatus = 'P'").select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("rival"))
    return o.where("o_orderstatus = 'O'").select("o_custkey", "o_orderpriority", "o_orderkey").join(disputed, ["o_custkey", "o_orderpriority"], "left").groupBy("o_orderkey").agg(F.count("rival").alias("rivals"))


@query("y10_wilson", "with c as (select source, count(*) as n, count(*) filter (quality = 1) as k from labels join documents using (doc_id) group by 1) select source, round((k / n::double + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((k / n::double * (1 - k / n::double) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n), 6) as low, round((k / n::double + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt((k / n::double * (1 - k / n::double) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n), 6) as high from c")
def wilson(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    p, n, z = F.col("k") / F.col("n"), F.col("n"), 1.96
    spread = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    end = lambda s: F.round((p + z * z / (2 * n) + s) / (1 + z * z / n), 6)
    return rows.select("source", end(-spread).alias("low"), end(spread).alias("high"))


@query("v10_confusion", "with s as (select doc_id, case when regexp_matches(text, '[*#$%&]{3}|!!') then 0 else 1 end as guess from documents where text is not null) select count(*) filter (guess = 0 and quality = 0) as tp, count(*) filter (guess = 0 and quality = 1) as fp, count(*) filter (guess = 1 and quality = 0) as fn, count(*) filter (guess = 1 and quality = 1) as tn from s join labels using (doc_id)")
def confusion(spark, d):
    guess = F.when(F.col("text").rlike("[*#$%&]{3}|!!"), 0).otherwise(1)
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", guess.alias("guess")).join(table(spark, d, "labels"), "doc_id")
    cell = lambda g, q: F.count_if((F.col("guess") == g) & (F.col("quality") == q))
    return rows.agg(cell(0, 0).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tn"))
