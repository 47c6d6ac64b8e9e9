"""Keeping the store: lookups, conflict cases and their resolution, edges, derived rows, change feeds and clean-up."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.plans.facts import H, NOW, at, history
from tessera.plans.registry import query
from tessera.sources import archive
from tessera.sources.scratch import shared_dir
from tessera.sources.tables import table

DAY = "interval 1 day"
EXCLUSIVE = ("1-URGENT", "2-HIGH")
KEY = ("o_custkey", "o_orderpriority")
#: A conflict group: the orders of a customer in an exclusive slot; open orders are active, pending ones disputed.
G = """with m as (select * from orders where o_orderpriority in ('1-URGENT', '2-HIGH')),
g as (select o_custkey, o_orderpriority, count(*) as members, count(*) filter (o_orderstatus = 'O') as active, count(*) filter (o_orderstatus = 'P') as disputed from m group by 1, 2)
"""


def members(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderpriority").isin(*EXCLUSIVE))


def groups(spark, d):
    has = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return members(spark, d).groupBy(*KEY).agg(F.count("*").alias("members"), has("O").alias("active"), has("P").alias("disputed"))


# Lookups and scans.


@query("a03_point_lookup", "select event_id, user_id, event_type, round(value, 4) as value from events where event_id = 17")
def point_lookup(spark, d):
    """The filter is pushed to the scan."""
    return table(spark, d, "events").where("event_id = 17").select("event_id", "user_id", "event_type", F.round("value", 4).alias("value"))


@query("a05_ordered_scan", H + "select o_orderkey, o_custkey, status from h order by o_orderkey")
def ordered_scan(spark, d):
    return history(spark, d).select("o_orderkey", "o_custkey", "status").orderBy("o_orderkey")


@query("a18_replay_conflicts", "with a as (select event_id, sha256(concat_ws('|', user_id, event_type, round(value, 1))) as h from events) select e.event_id from events e join a using (event_id) where a.h <> sha256(concat_ws('|', e.user_id, e.event_type, round(e.value, 2)))")
def replay_conflicts(spark, d):
    """Archived rows, whose values were kept to one place, that are not what the log has under their id."""
    e, path = table(spark, d, "events"), f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    archive.export_archive(e.withColumn("value", F.round("value", 1)), path, F.floor(F.col("event_id") / 5000), ["event_id"])
    held = archive.read_archive(spark, path).where("record is not null").select(F.from_json("record", e.schema, archive.FORMAT).alias("row")).select("row.*")
    digest = lambda places: F.sha2(F.concat_ws("|", "user_id", "event_type", F.round("value", places)), 256)
    return e.select("event_id", digest(2).alias("now")).join(held.select("event_id", digest(1).alias("h")), "event_id").where("h <> now").select("event_id")


@query("b04_valid_time_filter", H + f"select o_orderkey, case when valid_from <= timestamp '{NOW}' and (valid_to is null or timestamp '{NOW}' < valid_to) then 'current' else 'historical' end as intent from h where valid_from <= timestamp '{NOW}'")
def valid_time_filter(spark, d):
    """What a current question may see, and what only a historical one may."""
    now = at()
    current = (F.col("valid_from") <= now) & (F.col("valid_to").isNull() | (now < F.col("valid_to")))
    return history(spark, d).where(F.col("valid_from") <= now).select("o_orderkey", F.when(current, "current").otherwise("historical").alias("intent"))


@query("b19_public_rows", "select o_orderkey, lower(o_orderpriority) as slot, o_totalprice as value, string_agg(l_linenumber::varchar, ',' order by l_linenumber) as evidence from orders join lineitem on l_orderkey = o_orderkey group by all")
def public_rows(spark, d):
    """Claims as callers see them, with the list of their evidence."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.sort_array(F.collect_list("l_linenumber")), ",").alias("evidence"))
    return table(spark, d, "orders").join(lines, "o_orderkey").select("o_orderkey", F.lower("o_orderpriority").alias("slot"), F.col("o_totalprice").alias("value"), "evidence")


@query("d11_latest_failure", "select user_id, max(ts) as failed_at, count(*) as failures from events where event_type = 'error' group by 1")
def latest_failure(spark, d):
    return table(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.max("ts").alias("failed_at"), F.count("*").alias("failures"))


@query("d17_page_totals", H + "select o_orderpriority, status, count(*) as total from h group by 1, 2")
def page_totals(spark, d):
    return history(spark, d).groupBy("o_orderpriority", "status").agg(F.count("*").alias("total"))


@query("e10_sliding_day", "select event_id, count(*) over w as day_events, count(*) filter (event_type = 'error') over w as day_errors from events window w as (partition by user_id order by ts range between interval 24 hour preceding and current row)")
def sliding_day(spark, d):
    """Each event with its user's last 24 hours."""
    e = table(spark, d, "events").withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("micros").rangeBetween(-86_400_000_000, 0)
    return e.select("event_id", F.count("*").over(w).alias("day_events"), F.count_if(F.col("event_type") == "error").over(w).alias("day_errors"))


@query("f01_pre_rank", H + "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by case status when 'active' then 1.0 when 'superseded' then 0.5 else 0.2 end desc, o_totalprice desc, recorded_from desc, o_orderkey) as rank from h")
def pre_rank(spark, d):
    """Score, then value, then recency, then id: a total order for each subject."""
    score = F.when(F.col("status") == "active", 1.0).when(F.col("status") == "superseded", 0.5).otherwise(0.2)
    order = Window.partitionBy("o_custkey").orderBy(score.desc(), F.col("o_totalprice").desc(), F.col("recorded_from").desc(), "o_orderkey")
    return history(spark, d).select("o_custkey", "o_orderkey", F.row_number().over(order).cast("long").alias("rank"))


# Joins.


@query("c03_derivation_evidence", G + "select g.o_custkey, g.o_orderpriority, m.o_orderkey from g join m on m.o_custkey = g.o_custkey and m.o_orderpriority = g.o_orderpriority where g.members >= 2")
def derivation_evidence(spark, d):
    """A derived row and its evidence meet on id and kind together."""
    return groups(spark, d).where("members >= 2").join(members(spark, d), list(KEY)).select(*KEY, "o_orderkey")


@query("c04_trace_episode", "with ep as (select user_id, count(*) as steps, max(ts) as ended from events group by 1) select event_id, user_id, steps, date_diff('second', ts, ended) as to_end from events join ep using (user_id)")
def trace_episode(spark, d):
    e = table(spark, d, "events")
    ep = e.groupBy("user_id").agg(F.count("*").alias("steps"), F.max("ts").alias("ended"))
    seconds = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000)
    return e.join(ep, "user_id").select("event_id", "user_id", "steps", (seconds("ended") - seconds("ts")).alias("to_end"))


@query("c06_policy_usefulness", "with p as (select distinct source from documents where source is not null), u as (select source, count(*) filter (quality = 1) as helpful, count(*) as votes from labels join documents using (doc_id) where toxic = 1 group by 1) select p.source, coalesce(helpful, 0) as helpful, coalesce(votes, 0) as votes from p left join u using (source)")
def policy_usefulness(spark, d):
    """Policies keep their place in the list when nothing is known of their use."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    use = table(spark, d, "labels").where("toxic = 1").join(docs, "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("helpful"), F.count("*").alias("votes"))
    return docs.select("source").where("source is not null").distinct().join(use, "source", "left").select("source", F.coalesce("helpful", F.lit(0)).alias("helpful"), F.coalesce("votes", F.lit(0)).alias("votes"))


@query("c14_left_is_null", H + "select h.o_orderkey, h.superseded_by from h left join (select o_orderkey as k from h where status = 'active') a on h.superseded_by = a.k where h.superseded_by is not null and a.k is null")
def left_is_null(spark, d):
    """Versions whose successor is no active one."""
    h = history(spark, d)
    active = h.where("status = 'active'").select(F.col("o_orderkey").alias("superseded_by"))
    return h.where("superseded_by is not null").select("o_orderkey", "superseded_by").join(active, "superseded_by", "left_anti").select("o_orderkey", "superseded_by")


@query("c21_reached_observations", G + "select m.o_orderkey, g.members as proofs, string_agg(e.o_orderkey::varchar, ',' order by e.o_orderkey) as evidence from m join g using (o_custkey, o_orderpriority) join m e using (o_custkey, o_orderpriority) where g.members >= 2 and m.o_orderstatus = 'O' group by 1, 2")
def reached_observations(spark, d):
    """The observations that active claims lead to, with their evidence gathered once a group."""
    m = members(spark, d)
    seen = m.groupBy(*KEY).agg(F.count("*").alias("proofs"), F.array_join(F.sort_array(F.collect_list("o_orderkey")), ",").alias("evidence")).where("proofs >= 2")
    return m.where("o_orderstatus = 'O'").join(seen, list(KEY)).select("o_orderkey", "proofs", "evidence")


@query("c23_coexisting", G + "select a.o_orderkey as left_id, b.o_orderkey as right_id from m a join m b on a.o_custkey = b.o_custkey and a.o_orderpriority = b.o_orderpriority and a.o_orderkey < b.o_orderkey where a.o_orderstatus = 'F' and b.o_orderstatus = 'F' and a.o_orderdate = b.o_orderdate")
def coexisting(spark, d):
    """Terminal claims of an exclusive slot that hold at the same instant."""
    m = members(spark, d).where("o_orderstatus = 'F'").select(*KEY, "o_orderdate", "o_orderkey")
    other = m.withColumnRenamed("o_orderkey", "right_id")
    return m.join(other, [*KEY, "o_orderdate"]).where("o_orderkey < right_id").select(F.col("o_orderkey").alias("left_id"), "right_id")


# Conflict cases.


@query("o03_candidates", G + "select o_orderkey, lag(o_orderkey) over (partition by o_custkey, o_orderpriority, o_orderstatus, o_orderdate order by o_orderkey) as exact, lag(o_orderkey) over (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey) as conflicting from m")
def candidates(spark, d):
    """An earlier fact that says the same of the same day, and the one that was in force."""
    exact = Window.partitionBy(*KEY, "o_orderstatus", "o_orderdate").orderBy("o_orderkey")
    conflict = Window.partitionBy(*KEY).orderBy("o_orderdate", "o_orderkey")
    return members(spark, d).select("o_orderkey", F.lag("o_orderkey").over(exact).alias("exact"), F.lag("o_orderkey").over(conflict).alias("conflicting"))


@query("o04_quarantine", G + "select o_orderkey, case when o_orderstatus = 'O' and active >= 2 then 'disputed' when o_orderstatus = 'O' then 'active' when o_orderstatus = 'P' then 'candidate' else 'archived' end as status, case when active >= 2 then o_custkey || '|' || o_orderpriority end as case_key from m join g using (o_custkey, o_orderpriority)")
def quarantine(spark, d):
    """Several active claims of one exclusive slot are disputed until their case is closed."""
    s = F.col("o_orderstatus")
    status = F.when((s == "O") & (F.col("active") >= 2), "disputed").when(s == "O", "active").when(s == "P", "candidate").otherwise("archived")
    case = F.when(F.col("active") >= 2, F.concat_ws("|", *KEY))
    return members(spark, d).join(groups(spark, d), list(KEY)).select("o_orderkey", status.alias("status"), case.alias("case_key"))


PAIRS = G + """, p as (select *, lag(o_orderkey) over w as was, lag(o_orderstatus) over w as was_status, lag(o_totalprice) over w as was_price from m window w as (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey)),
c as (select was as left_id, o_orderkey as right_id, case when was_status = 'F' or o_orderstatus = 'F' then 'closed' else 'pending' end as state,
  case when o_totalprice > was_price then 'keep_right' when o_totalprice < was_price then 'keep_left' else 'coexist' end as decision from p where was is not null)
"""


def pair_cases(spark, d):
    w = Window.partitionBy(*KEY).orderBy("o_orderdate", "o_orderkey")
    p = members(spark, d).withColumns({c: F.lag(x).over(w) for c, x in (("was", "o_orderkey"), ("was_status", "o_orderstatus"), ("was_price", "o_totalprice"))}).where("was is not null")
    state = F.when((F.col("was_status") == "F") | (F.col("o_orderstatus") == "F"), "closed").otherwise("pending")
    decision = F.when(F.col("o_totalprice") > F.col("was_price"), "keep_right").when(F.col("o_totalprice") < F.col("was_price"), "keep_left").otherwise("coexist")
    return p.select(F.col("was").alias("left_id"), F.col("o_orderkey").alias("right_id"), state.alias("state"), decision.alias("decision"))


@query("o06_pair_cases", PAIRS + "select left_id, right_id, state, case when state = 'closed' then null else decision end as proposed from c")
def pair_case_upsert(spark, d):
    """A case for each pair of neighbours; those that are closed keep their state and get no proposal."""
    return pair_cases(spark, d).select("left_id", "right_id", "state", F.when(F.col("state") != "closed", F.col("decision")).alias("proposed"))


@query("o07_manual_resolve", PAIRS + ", lost as (select left_id as id from c where state = 'pending' and decision = 'keep_right' union select right_id from c where state = 'pending' and decision = 'keep_left') select o_orderkey, case when id is not null then 'superseded' else 'kept' end as status from m left join lost on id = o_orderkey")
def manual_resolve(spark, d):
    """Who loses an open case is superseded, however many cases it is in."""
    open_ = pair_cases(spark, d).where("state = 'pending'")
    lost = open_.select(F.when(F.col("decision") == "keep_right", F.col("left_id")).when(F.col("decision") == "keep_left", F.col("right_id")).alias("o_orderkey")).where("o_orderkey is not null").distinct().withColumn("lost", F.lit(True))
    return members(spark, d).select("o_orderkey").join(lost, "o_orderkey", "left").select("o_orderkey", F.when(F.col("lost"), "superseded").otherwise("kept").alias("status"))


@query("o08_optimistic_group", "with m as (select * from orders where o_orderpriority in ('1-URGENT', '2-HIGH')) select o_custkey, o_orderpriority, count(*) as revision, count(*) filter (o_orderdate < timestamp '1998-01-01') as expected, case when count(*) = count(*) filter (o_orderdate < timestamp '1998-01-01') then max(o_orderkey) filter (o_orderstatus = 'O') end as winner from m group by 1, 2")
def optimistic_group(spark, d):
    """A decision made on the group as it was in January counts only where the group is the same now."""
    expected = F.count_if(F.col("o_orderdate") < at("1998-01-01"))
    rows = members(spark, d).groupBy(*KEY).agg(F.count("*").alias("revision"), expected.alias("expected"), F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey"))).alias("open"))
    return rows.select(*KEY, "revision", "expected", F.when(F.col("revision") == F.col("expected"), F.col("open")).alias("winner"))


@query("o09_review_snapshot", G + "select o_custkey, o_orderpriority, string_agg(o_orderkey || ':' || o_orderstatus, ',' order by o_orderdate, o_orderkey) as snapshot from m join g using (o_custkey, o_orderpriority) where active >= 2 group by 1, 2")
def review_snapshot(spark, d):
    row = F.struct("o_orderdate", "o_orderkey", "o_orderstatus")
    rows = members(spark, d).groupBy(*KEY).agg(F.count_if(F.col("o_orderstatus") == "O").alias("active"), F.sort_array(F.collect_list(row)).alias("rows")).where("active >= 2")
    return rows.select(*KEY, F.array_join(F.transform("rows", lambda r: F.concat(r["o_orderkey"].cast("string"), F.lit(":"), r["o_orderstatus"])), ",").alias("snapshot"))


WINNER = G + ", w as (select o_custkey, o_orderpriority, arg_max(o_orderkey, row(o_totalprice, o_orderkey)) as winner from m where o_orderstatus = 'O' group by 1, 2 having count(*) >= 2)"


def winners(spark, d):
    rows = members(spark, d).where("o_orderstatus = 'O'").groupBy(*KEY).agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("winner"), F.count("*").alias("n"))
    return rows.where("n >= 2").drop("n")


@query("o16_converge", WINNER + " select o_orderkey, winner, o_orderkey = winner as stays from m join w using (o_custkey, o_orderpriority) where o_orderstatus = 'O'")
def converge(spark, d):
    """All active members of a case give way to its winner, which closes every case of the group."""
    rows = members(spark, d).where("o_orderstatus = 'O'").join(winners(spark, d), list(KEY))
    return rows.select("o_orderkey", "winner", (F.col("o_orderkey") == F.col("winner")).alias("stays"))


@query("o18_uncontested", G + "select o_orderkey from m join g using (o_custkey, o_orderpriority) where o_orderstatus = 'P' and disputed = 1 and active = 0")
def uncontested(spark, d):
    """The one disputed claim that is left in its group becomes active."""
    return members(spark, d).where("o_orderstatus = 'P'").join(groups(spark, d).where("disputed = 1 and active = 0"), list(KEY), "left_semi").select("o_orderkey")


@query("o19_postconditions", WINNER + ", after as (select m.o_custkey, m.o_orderpriority, count(*) filter (o_orderstatus = 'O' and (winner is null or winner = o_orderkey)) as active from m left join w using (o_custkey, o_orderpriority) group by 1, 2) select count(*) as groups, count(*) filter (active > 1) as violations from after")
def postconditions(spark, d):
    """After all cases are closed no exclusive slot has two active claims."""
    kept = (F.col("o_orderstatus") == "O") & (F.col("winner").isNull() | (F.col("winner") == F.col("o_orderkey")))
    after = members(spark, d).join(winners(spark, d), list(KEY), "left").groupBy(*KEY).agg(F.count_if(kept).alias("active"))
    return after.agg(F.count("*").alias("groups"), F.count_if(F.col("active") > 1).alias("violations"))


@query("o20_inspect", G + "select case when active > 1 then 'several_active' when active = 0 and disputed > 0 then 'only_disputed' when members = 1 then 'single' else 'settled' end as category, count(*) as n, min(o_custkey) as sample from g group by 1")
def inspect_groups(spark, d):
    category = F.when(F.col("active") > 1, "several_active").when((F.col("active") == 0) & (F.col("disputed") > 0), "only_disputed").when(F.col("members") == 1, "single").otherwise("settled")
    return groups(spark, d).groupBy(category.alias("category")).agg(F.count("*").alias("n"), F.min("o_custkey").alias("sample"))


@query("o21_repair_plan", G + ", r as (select m.*, (select count(*) from lineitem where l_orderkey = m.o_orderkey) as refs from m where o_orderstatus = 'O'), k as (select *, row_number() over (partition by o_custkey, o_orderpriority order by refs desc, o_orderdate, o_orderkey) as place, count(*) over (partition by o_custkey, o_orderpriority) as n from r) select o_orderkey, refs, case when place = 1 then 'keep' else 'archive' end as action from k where n >= 2")
def repair_plan(spark, d):
    """Of several active claims the one with most references stays, then the earliest, then the least id."""
    refs = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("refs"))
    rows = members(spark, d).where("o_orderstatus = 'O'").join(refs, "o_orderkey", "left").withColumn("refs", F.coalesce("refs", F.lit(0)))
    every = Window.partitionBy(*KEY)
    rows = rows.withColumns({"place": F.row_number().over(every.orderBy(F.col("refs").desc(), "o_orderdate", "o_orderkey")), "n": F.count("*").over(every)})
    return rows.where("n >= 2").select("o_orderkey", "refs", F.when(F.col("place") == 1, "keep").otherwise("archive").alias("action"))


@query("r06_active_audit", G + "select o_orderpriority, count(*) as groups, count(*) filter (active > 1) as broken, sum(greatest(active - 1, 0))::bigint as surplus from g group by 1")
def active_audit(spark, d):
    return groups(spark, d).groupBy("o_orderpriority").agg(F.count("*").alias("groups"), F.count_if(F.col("active") > 1).alias("broken"), F.sum(F.greatest(F.col("active") - 1, F.lit(0))).alias("surplus"))


@query("r03_observations", "select o_custkey, o_orderpriority, string_agg(distinct o_orderstatus, ',' order by o_orderstatus) as body, count(*) as proofs, max(o_orderdate) as watermark from orders group by 1, 2 having count(*) >= 2")
def observations(spark, d):
    """Observations over all groups of at least two claims, with their proofs and watermark."""
    rows = table(spark, d, "orders").groupBy(*KEY).agg(F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ",").alias("body"), F.count("*").alias("proofs"), F.max("o_orderdate").alias("watermark"))
    return rows.where("proofs >= 2")


# Writes over the version history.


@query("m03_retract", H + "select o_orderkey, case when o_orderstatus = 'P' then 'retracted' else status end as status, o_orderstatus <> 'P' as keeps_vector from h")
def retract(spark, d):
    """Pending claims are retracted: they keep their row and lose their vector."""
    p = F.col("o_orderstatus") == "P"
    return history(spark, d).select("o_orderkey", F.when(p, "retracted").otherwise(F.col("status")).alias("status"), (~p).alias("keeps_vector"))


@query("m09_converge_superseded", H + "select o_orderkey, last_value(o_orderkey) over w as tip, lead(valid_from) over v as closed_at from h window w as (partition by o_custkey order by version rows between unbounded preceding and unbounded following), v as (partition by o_custkey order by version)")
def converge_superseded(spark, d):
    """Each member of a series points at its newest, and closes where the next begins, late ones too."""
    order = Window.partitionBy("o_custkey").orderBy("version")
    tip = F.last("o_orderkey").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return history(spark, d).select("o_orderkey", tip.alias("tip"), F.lead("valid_from").over(order).alias("closed_at"))


@query("m10_status_update", H + "select o_orderkey, case when o_orderpriority = '3-MEDIUM' then 'rejected' when status = 'superseded' then 'unchanged' else 'updated' end as outcome from h")
def status_update(spark, d):
    """A request for a status that is none (here: a medium priority) is rejected; superseded rows do not change."""
    outcome = F.when(~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "4-NOT SPECIFIED", "5-LOW"), "rejected").when(F.col("status") == "superseded", "unchanged").otherwise("updated")
    return history(spark, d).select("o_orderkey", outcome.alias("outcome"))


EDGES = H + ", e as (select o_orderkey as from_id, superseded_by as to_id, valid_to as since from h where superseded_by is not null)"


def edges(spark, d):
    return history(spark, d).where("superseded_by is not null").select(F.col("o_orderkey").alias("from_id"), F.col("superseded_by").alias("to_id"), F.col("valid_to").alias("since"))


@query("l01_edge_directions", EDGES + " select id, sum(o)::bigint as outgoing, sum(i)::bigint as incoming from (select from_id as id, 1 as o, 0 as i from e union all select to_id, 0, 1 from e) group by 1")
def edge_directions(spark, d):
    e = edges(spark, d)
    ends = e.select(F.col("from_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("to_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


@query("l09_close_edges", EDGES + ", t as (select o_orderkey, recorded_from from h where status in ('archived', 'expired')) select from_id, to_id, since, recorded_from as closed_at from e left join t on o_orderkey = to_id")
def close_edges(spark, d):
    """An edge ends when the claim it leads to does."""
    ends = history(spark, d).where("status in ('archived', 'expired')").select(F.col("o_orderkey").alias("to_id"), F.col("recorded_from").alias("closed_at"))
    return edges(spark, d).join(ends, "to_id", "left").select("from_id", "to_id", "since", "closed_at")


@query("v13_persisted_edges", EDGES + ", s as (select superseded_by as to_id, o_orderkey as from_id from h where superseded_by is not null and status = 'superseded') select from_id, to_id from e union select from_id, to_id from s")
def persisted_edges(spark, d):
    """Edges as either end tells them, once."""
    back = history(spark, d).where("status = 'superseded' and superseded_by is not null").select(F.col("o_orderkey").alias("from_id"), F.col("superseded_by").alias("to_id"))
    return edges(spark, d).select("from_id", "to_id").union(back).distinct()


@query("s12_change_feed", H + ", a as (select o_orderkey, case when recorded_to <= timestamp '1997-01-01' then 'closed' else 'open' end as state from h where recorded_from <= timestamp '1997-01-01'), b as (select o_orderkey, case when recorded_to <= timestamp '1998-01-01' then 'closed' else 'open' end as state from h where recorded_from <= timestamp '1998-01-01') select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, case when a.state is null then 'insert' when b.state is null then 'delete' else 'update' end as op from a full join b using (o_orderkey) where a.state is distinct from b.state")
def change_feed(spark, d):
    """What a year changed: the difference of what was known at its ends."""
    def known(day, name):
        closed = F.coalesce(F.col("recorded_to") <= at(day), F.lit(False))
        return history(spark, d).where(F.col("recorded_from") <= at(day)).select("o_orderkey", F.when(closed, "closed").otherwise("open").alias(name))

    both = known("1997-01-01", "was").join(known("1998-01-01", "now"), "o_orderkey", "full")
    op = F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "delete").otherwise("update")
    return both.where(~F.col("was").eqNullSafe(F.col("now"))).select("o_orderkey", op.alias("op"))


@query("p07_archived_cleanup", H + ", a as (select o_orderkey from h where status = 'archived' order by valid_from, o_orderkey limit 100) select o_orderkey, (select count(*) from lineitem where l_orderkey = o_orderkey) as evidence from a")
def archived_cleanup(spark, d):
    """The hundred oldest archived claims, which is one bounded clean-up, and the evidence that goes with each."""
    oldest = history(spark, d).where("status = 'archived'").orderBy("valid_from", "o_orderkey").limit(100).select("o_orderkey")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    counts = lines.join(F.broadcast(oldest), "o_orderkey").groupBy("o_orderkey").agg(F.count("*").alias("evidence"))
    return oldest.join(counts, "o_orderkey", "left").select("o_orderkey", F.coalesce("evidence", F.lit(0)).alias("evidence"))


@query("p12_forget", "with c as (select c_custkey from customer where c_acctbal < 0), o as (select o_orderkey, o_custkey from orders join c on o_custkey = c_custkey) select c_custkey, count(distinct o_orderkey) as claims, count(l_orderkey) as evidence from c left join o on o_custkey = c_custkey left join lineitem on l_orderkey = o_orderkey group by 1")
def forget(spark, d):
    """All that goes when a subject (here: customers in debt) is forgotten."""
    c = table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("k"))
    return c.join(o, "c_custkey", "left").join(lines, "o_orderkey", "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("claims"), F.coalesce(F.sum("k"), F.lit(0)).alias("evidence"))


@query("p13_backfill_expiry", H + "select o_orderkey, valid_from + case o_orderpriority when '1-URGENT' then interval 30 day when '2-HIGH' then interval 90 day else interval 365 day end as expires_at from h where expires_at is null and status = 'active'")
def backfill_expiry(spark, d):
    """Active claims without an expiry get that of their slot; others are not touched."""
    p = F.col("o_orderpriority")
    days = F.when(p == "1-URGENT", F.expr("interval 30 day")).when(p == "2-HIGH", F.expr("interval 90 day")).otherwise(F.expr("interval 365 day"))
    return history(spark, d).where("expires_at is null and status = 'active'").select("o_orderkey", (F.col("valid_from") + days).alias("expires_at"))


@query("v05_temporal_correctness", H + f"select status, round(avg(case when valid_from <= timestamp '{NOW}' and (valid_to is null or timestamp '{NOW}' < valid_to) then 1.0 else 0.0 end), 6) as valid, round(avg(case when recorded_from <= timestamp '{NOW}' then 1.0 else 0.0 end), 6) as recorded from h group by 1")
def temporal_correctness(spark, d):
    """How much of what has each status holds now, and was known."""
    now = at()
    valid = (F.col("valid_from") <= now) & (F.col("valid_to").isNull() | (now < F.col("valid_to")))
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return history(spark, d).groupBy("status").agg(share(valid).alias("valid"), share(F.col("recorded_from") <= now).alias("recorded"))


# Feedback and experience.


@query("q05_exposures", "with e as (select *, min(case when event_type = 'click' then ts end) over (partition by user_id order by ts, event_id rows between 1 following and unbounded following) as clicked from events) select event_id, coalesce(clicked <= ts + interval 10 minute, false) as injected from e where event_type = 'view'")
def exposures(spark, d):
    """A view counts as used if its user clicks within ten minutes."""
    later = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1, Window.unboundedFollowing)
    e = table(spark, d, "events").withColumn("clicked", F.min(F.when(F.col("event_type") == "click", F.col("ts"))).over(later))
    return e.where("event_type = 'view'").select("event_id", F.coalesce(F.col("clicked") <= F.col("ts") + F.expr("interval 10 minute"), F.lit(False)).alias("injected"))


@query("q08_trace_append", "select event_id, row_number() over (partition by user_id order by ts, event_id) as seq, coalesce(event_type <> lag(event_type) over (partition by user_id order by ts, event_id), true) as changed from events")
def trace_append(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    changed = F.coalesce(F.col("event_type") != F.lag("event_type").over(w), F.lit(True))
    return table(spark, d, "events").select("event_id", F.row_number().over(w).cast("long").alias("seq"), changed.alias("changed"))


@query("q11_support", "with s as (select user_id, event_type as first, lead(event_type) over (partition by user_id order by ts, event_id) as second from events) select first, second, count(distinct user_id) as support, count(distinct user_id) >= 3 as active from s where second is not null group by 1, 2")
def support(spark, d):
    """A policy, here one step after another, is active when three episodes support it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = table(spark, d, "events").select("user_id", F.col("event_type").alias("first"), F.lead("event_type").over(w).alias("second")).where("second is not null")
    return s.groupBy("first", "second").agg(F.countDistinct("user_id").alias("support")).withColumn("active", F.col("support") >= 3)
