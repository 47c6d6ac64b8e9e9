"""Bitemporal reads and writes over the customers' orders, a version history by customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import temporal as T
from tessera.functions.text import key16
from tessera.operators import bitemporal as B
from tessera.plans.registry import query
from tessera.sources.tables import table

NOW = "1998-06-01"


def at(day: str = NOW):
    return F.lit(day).cast("timestamp_ntz")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as versions of one fact, known a day after they hold; the last keeps its own status."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice", "o_orderpriority")
    v = B.versions(orders, ["o_custkey"], "o_orderdate", "o_orderkey")
    last = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "archived").otherwise("expired")
    day = F.expr("interval 1 day")
    return v.withColumns({"status": F.when(F.col("valid_to").isNotNull(), "superseded").otherwise(last), "recorded_from": F.col("valid_from") + day, "recorded_to": F.col("valid_to") + day, "expires_at": F.when(F.col("o_orderpriority") == "5-LOW", F.col("valid_from") + F.expr("interval 180 day"))})


H = """with v as (
  select o_custkey, o_orderkey, o_orderdate, o_orderstatus, o_totalprice, o_orderpriority, o_orderdate as valid_from,
    lead(o_orderdate) over w as valid_to, lead(o_orderkey) over w as superseded_by, row_number() over w as version
  from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
h as (
  select *, case when valid_to is not null then 'superseded' when o_orderstatus = 'O' then 'active'
      when o_orderstatus = 'F' then 'archived' else 'expired' end as status,
    valid_from + interval 1 day as recorded_from, valid_to + interval 1 day as recorded_to,
    case when o_orderpriority = '5-LOW' then valid_from + interval 180 day end as expires_at
  from v)
"""
IN_FORCE = f"valid_from <= timestamp '{NOW}' and (valid_to is null or timestamp '{NOW}' < valid_to)"
SEEN = f"{IN_FORCE} and status in ('active','superseded','expired') and (status = 'active' or valid_to is not null) and (expires_at is null or expires_at > timestamp '{NOW}')"
COLS = "o_custkey, o_orderkey, version, status"


@query("b01_visible_current", H + f"select {COLS} from h where {SEEN}")
def visible_current(spark, d):
    return history(spark, d).where(T.visible(at())).select("o_custkey", "o_orderkey", "version", "status")


@query("b01_visible_historical", H + f"select {COLS} from h where valid_from <= timestamp '{NOW}' and status in ('active','archived','superseded','expired')")
def visible_historical(spark, d):
    return history(spark, d).where(T.visible(at(), historical=True)).select("o_custkey", "o_orderkey", "version", "status")


@query("b01_known_as_of", H + f"select {COLS} from h where {SEEN} and recorded_from <= timestamp '1998-05-01' and (recorded_to is null or timestamp '1998-05-01' < recorded_to)")
def known_as_of(spark, d):
    return history(spark, d).where(T.visible(at(), at("1998-05-01"))).select("o_custkey", "o_orderkey", "version", "status")


@query("b02_valid_time", H + f"select {COLS} from h where {IN_FORCE}")
def valid_time(spark, d):
    return history(spark, d).where(T.within(F.col("valid_from"), F.col("valid_to"), at())).select("o_custkey", "o_orderkey", "version", "status")


@query("b03_status_filter", H + "select status, count(*) as n from h where status in ('active','superseded','expired') group by status")
def status_filter(spark, d):
    return history(spark, d).where(F.col("status").isin(*T.CURRENT)).groupBy("status").agg(F.count("*").alias("n"))


@query("b10_drop_reasons", H + f"""select case when valid_from > timestamp '{NOW}' then 'not_yet_valid' when valid_to <= timestamp '{NOW}' then 'no_longer_valid'
  when status not in ('active','superseded','expired') then 'status' when status <> 'active' and valid_to is null then 'open_but_inactive'
  when expires_at <= timestamp '{NOW}' then 'expired' else 'visible' end as reason, count(*) as n from h group by 1""")
def drop_reasons(spark, d):
    return history(spark, d).select(F.coalesce(T.drop_reason(at()), F.lit("visible")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("c19_as_of", H + f"""select o_custkey, o_orderkey, round(o_totalprice, 2) as o_totalprice from
  (select *, row_number() over (partition by o_custkey order by valid_from desc, o_orderkey desc) as r from h where {IN_FORCE}) where r = 1""")
def as_of(spark, d):
    return B.as_of(history(spark, d), ["o_custkey"], at(), "o_orderkey").select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("m01_scd2_versions", H + "select o_custkey, o_orderkey, version, valid_from, valid_to, superseded_by from h")
def scd2(spark, d):
    return history(spark, d).select("o_custkey", "o_orderkey", "version", "valid_from", "valid_to", "superseded_by")


@query("m02_close_out", """with base as (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as r, count(*) over (partition by o_custkey) as n from orders),
  cur as (select o_custkey, o_orderkey, o_orderdate as valid_from, lead(o_orderdate) over (partition by o_custkey order by r) as valid_to from base where r < n),
  chg as (select o_custkey, o_orderkey, o_orderdate as valid_from from base where r = n)
  select cur.o_custkey, cur.o_orderkey, cur.valid_from, coalesce(cur.valid_to, chg.valid_from) as valid_to from cur join chg using (o_custkey)
  union all select o_custkey, o_orderkey, valid_from, null from chg""")
def close_out(spark, d):
    orders = table(spark, d, "orders")
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    ranked = orders.withColumns({"r": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy("o_custkey"))})
    current = ranked.where("r < n").withColumnsRenamed({"o_orderdate": "valid_from"}).withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("o_custkey").orderBy("r")))
    changes = ranked.where("r = n").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("valid_from"))
    return B.close_out(current.select("o_custkey", "o_orderkey", "valid_from", "valid_to"), changes, "o_custkey")


PAIR = """, p as (select a.o_custkey, a.o_orderkey as old_key, b.o_orderkey as new_key, a.o_orderstatus as old_status, b.o_orderstatus as new_status,
    a.o_orderdate as old_at, b.o_orderdate as new_at, a.o_totalprice as old_price, b.o_totalprice as new_price
  from h a join h b on a.o_custkey = b.o_custkey and b.version = a.version + 1)"""


def pairs(spark, d):
    """Each version with the next one of its customer."""
    h = history(spark, d)
    order = Window.partitionBy("o_custkey").orderBy("version")
    cols = {"new_key": "o_orderkey", "new_status": "o_orderstatus", "new_at": "o_orderdate", "new_price": "o_totalprice"}
    h = h.withColumns({k: F.lead(v).over(order) for k, v in cols.items()}).where("new_key is not null")
    return h.select("o_custkey", F.col("o_orderkey").alias("old_key"), "new_key", F.col("o_orderstatus").alias("old_status"), "new_status", F.col("o_orderdate").alias("old_at"), "new_at", F.col("o_totalprice").alias("old_price"), "new_price")


@query("m06_temporal_link", H + PAIR + """select old_key, new_key, case when old_status = new_status and old_price = new_price then 'entails' when new_at < old_at then 'snapshot_older'
  when new_at = old_at then 'uncertain' when old_status = new_status then 'snapshot_newer' else 'state_change' end as outcome from p""")
def temporal_link(spark, d):
    same = F.col("old_status") == F.col("new_status")
    outcome = B.link_outcome(same & (F.col("old_price") == F.col("new_price")), F.col("old_at"), F.col("new_at"), same)
    return pairs(spark, d).select("old_key", "new_key", outcome.alias("outcome"))


@query("m07_series_candidates", """select o_custkey, o_orderkey, r from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as r from orders where o_orderstatus = 'O') where r <= 16""")
def series_candidates(spark, d):
    order = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), "o_orderkey")
    return table(spark, d, "orders").where("o_orderstatus = 'O'").withColumn("r", F.row_number().over(order).cast("long")).where("r <= 16").select("o_custkey", "o_orderkey", "r")


@query("m08_outcome_fold", H + PAIR + """, o as (select o_custkey, case when old_status = new_status and old_price = new_price then 'entails' when new_at = old_at then 'uncertain'
    when old_status = new_status then 'snapshot_newer' else 'state_change' end as outcome from p)
  select o_custkey, case when count(distinct outcome) = 1 then min(outcome) else 'uncertain' end as outcome from o group by 1""")
def outcome_fold(spark, d):
    same = F.col("old_status") == F.col("new_status")
    outcome = B.link_outcome(same & (F.col("old_price") == F.col("new_price")), F.col("old_at"), F.col("new_at"), same)
    one = F.collect_set("outcome")
    return pairs(spark, d).withColumn("outcome", outcome).groupBy("o_custkey").agg(F.when(F.size(one) == 1, one[0]).otherwise("uncertain").alias("outcome"))


@query("m12_transitions", H + PAIR + """, s as (select case old_status when 'O' then 'active' when 'F' then 'archived' else 'disputed' end as was, case new_status when 'O' then 'active' when 'F' then 'archived' else 'disputed' end as now from p)
  select was, now, count(*) as n from s where not ((was = 'active' and now in ('disputed','archived')) or (was = 'disputed' and now in ('archived','active')) or (was = 'archived' and now = 'active')) group by all""")
def transitions(spark, d):
    name = lambda c: F.when(F.col(c) == "O", "active").when(F.col(c) == "F", "archived").otherwise("disputed")
    changes = pairs(spark, d).select(name("old_status").alias("was"), name("new_status").alias("now"))
    return B.transition_problems(changes).groupBy("was", "now").agg(F.count("*").alias("n"))


@query("m13_status_at", H + "select o_orderkey, case when recorded_from > timestamp '1997-01-01' then null when recorded_to is null or timestamp '1997-01-01' < recorded_to then 'active' else status end as known from h")
def status_at(spark, d):
    return history(spark, d).select("o_orderkey", B.status_at(at("1997-01-01")).alias("known"))


@query("m14_coordinates", "select o_custkey, o_orderpriority, count(*) as n, max(o_orderdate) as latest from orders group by all")
def coordinates(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("latest"))


@query("h07_fact_hash", "select o_orderkey, substr(sha256(concat_ws(chr(31), o_custkey, o_orderstatus, o_orderpriority)), 1, 16) as fact_hash from orders")
def fact_hash(spark, d):
    return table(spark, d, "orders").select("o_orderkey", key16(F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("fact_hash"))


@query("h08_conflict_key", "select conflict_key, count(*) as n from (select substr(sha256(concat_ws(chr(31), 'v3', o_custkey, o_orderpriority)), 1, 16) as conflict_key from orders) group by 1")
def conflict_key(spark, d):
    return table(spark, d, "orders").groupBy(key16(F.lit("v3"), F.col("o_custkey"), F.col("o_orderpriority")).alias("conflict_key")).agg(F.count("*").alias("n"))


@query("h43_expiry", """with t as (select o_orderkey, o_orderdate, case when o_orderstatus = 'F' then 'permanent' else 'temporal' end as scope, o_totalprice / 500000 as importance, o_orderpriority = '1-URGENT' as short from orders)
  select o_orderkey, case when scope = 'permanent' then null else o_orderdate + case when short then interval 1 day when importance < 0.4 then interval 3 day when importance <= 0.7 then interval 7 day else interval 14 day end end as expires_at from t""")
def expiry(spark, d):
    scope = F.when(F.col("o_orderstatus") == "F", "permanent").otherwise("temporal")
    e = T.expiry(scope, F.col("o_totalprice") / 500000, F.col("o_orderdate"), F.lit(None).cast("timestamp_ntz"), F.col("o_orderpriority") == "1-URGENT")
    return table(spark, d, "orders").select("o_orderkey", e.alias("expires_at"))


@query("h14_recency", f"select o_orderkey, round(1.0 / (1.0 + greatest(epoch(timestamp '{NOW}' - o_orderdate) / 86400.0, 0) / 30.0), 6) as recency, round(power(0.5, greatest(epoch(timestamp '{NOW}' - o_orderdate) / 86400.0, 0) / 45.0), 6) as half_life from orders")
def recency(spark, d):
    age = T.days_between(at(), F.col("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", F.round(T.recency(age), 6).alias("recency"), F.round(T.half_life(age, 45.0), 6).alias("half_life"))


@query("h22_age_label", """select o_orderkey, case when h < 48 then h || 'h' when h < 8760 then (h // 24) || 'd' else strftime(o_orderdate, '%Y-%m-%d') end as label
  from (select *, floor(epoch(timestamp '2001-06-01' - o_orderdate) / 3600)::bigint as h from orders where o_orderdate <= timestamp '2001-06-01')""")
def age_label(spark, d):
    now = at("2001-06-01")
    return table(spark, d, "orders").where(F.col("o_orderdate") <= now).select("o_orderkey", T.age_label(F.col("o_orderdate"), now).alias("label"))


@query("c09_version_self_join", H + "select a.o_custkey, a.o_orderkey as old_key, b.o_orderkey as new_key from h a join h b on a.o_custkey = b.o_custkey and a.superseded_by = b.o_orderkey")
def version_self_join(spark, d):
    h = history(spark, d)
    new = h.select(F.col("o_custkey"), F.col("o_orderkey").alias("superseded_by"), F.col("o_orderkey").alias("new_key"))
    return h.join(new, ["o_custkey", "superseded_by"]).select("o_custkey", F.col("o_orderkey").alias("old_key"), "new_key")


@query("c17_interval_overlap", """with s as (select o_custkey, o_orderkey, o_orderdate as f, o_orderdate + interval 30 day as t from orders)
  select a.o_orderkey as left_key, b.o_orderkey as right_key from s a join s b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey and a.f < b.t and b.f < a.t""")
def interval_overlap(spark, d):
    s = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("f"), (F.col("o_orderdate") + F.expr("interval 30 day")).alias("t"))
    a, b = s.alias("a"), s.alias("b")
    on = (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.o_orderkey") < F.col("b.o_orderkey")) & T.overlap(F.col("a.f"), F.col("a.t"), F.col("b.f"), F.col("b.t"))
    return a.join(b, on).select(F.col("a.o_orderkey").alias("left_key"), F.col("b.o_orderkey").alias("right_key"))
