"""Feedback, decay, deletion, audits and the graph, over labels, orders and line items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import temporal as T
from tessera.operators import graph
from tessera.operators import lifecycle as L
from tessera.plans.facts import H, at, history
from tessera.plans.registry import query
from tessera.sources.scratch import stored
from tessera.sources.tables import table

# Feedback: a document's label is a vote, and each of its source's labels an outcome.
VOTES = """with f as (select d.source as memory_id, count(*) filter (quality = 1) as helpful, count(*) filter (quality = 0) as unhelpful, sum(1 - toxic)::double as success, count(toxic) as outcomes
  from labels l join documents d using (doc_id) group by 1)
"""
SCORE = "0.7 * (helpful + 2) / (helpful + unhelpful + 4) + 0.3 * (success + 1) / (outcomes + 2)"


def votes(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return rows.groupBy(F.col("source").alias("memory_id")).agg(F.count_if(F.col("quality") == 1).alias("helpful"), F.count_if(F.col("quality") == 0).alias("unhelpful"), F.sum(1 - F.col("toxic")).cast("double").alias("success"), F.count("toxic").alias("outcomes"))


@query("d01_usefulness_totals", VOTES + "select * from f")
def usefulness_totals(spark, d):
    return votes(spark, d)


@query("q01_usefulness", VOTES + f"select memory_id, round({SCORE}, 6) as score, least(180, (helpful + floor(success)::bigint) // 3 * 14)::bigint as bonus_days from f")
def usefulness(spark, d):
    cols = [F.col(c) for c in ("helpful", "unhelpful", "success", "outcomes")]
    return votes(spark, d).select("memory_id", F.round(L.usefulness(*cols), 6).alias("score"), L.bonus_days(cols[0], cols[2]).cast("long").alias("bonus_days"))


@query("q03_helpful_rate", VOTES + f"select memory_id, round(case when helpful + unhelpful >= 20 then {SCORE} else (helpful + 2) / (helpful + unhelpful + 4) end, 6) as rate from f")
def helpful_rate(spark, d):
    cols = [F.col(c) for c in ("helpful", "unhelpful", "success", "outcomes")]
    return votes(spark, d).select("memory_id", F.round(L.helpful_rate(cols[0], cols[1], L.usefulness(*cols), 20), 6).alias("rate"))


@query("q04_latest_feedback", "select user_id, event_type, event_id, round(value, 4) as value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1")
def latest_feedback(spark, d):
    latest = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("last")
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(latest).select("user_id", "event_type", "last.event_id", F.round("last.value", 4).alias("value"))


@query("c05_left_default", "select d.doc_id, coalesce(l.quality, -1)::int as quality, round(coalesce(0.7 * (l.quality + 2) / 5.0, 0.35), 6) as rate from documents d left join labels l using (doc_id)")
def left_default(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("quality", F.lit(-1)).cast("int").alias("quality"), F.round(F.coalesce(0.7 * (F.col("quality") + 2) / 5.0, F.lit(0.35)), 6).alias("rate"))


EPISODES = """with e as (select *, row_number() over (partition by user_id order by ts, event_id) as seq from events),
ep as (select user_id as episode, count(*) as steps, avg(value) as mean_value, max(ts) as ended, round(least(1, greatest(0, avg(value) / 100)), 6) as reward, string_agg(event_type, '>' order by seq) filter (seq <= 3) as actions from e group by 1)
"""


def steps(spark, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").withColumn("seq", F.row_number().over(order).cast("long"))


def episodes(spark, d):
    first = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("seq") <= 3, F.struct("seq", "event_type")))), lambda x: x["event_type"]), ">")
    reward = F.round(T.clamp(F.avg("value") / 100), 6)
    return steps(spark, d).groupBy(F.col("user_id").alias("episode")).agg(F.count("*").alias("steps"), F.max("ts").alias("ended"), reward.alias("reward"), first.alias("actions"))


@query("e06_sequence_numbers", "select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as seq from events")
def sequence_numbers(spark, d):
    return steps(spark, d).select("event_id", "user_id", "seq")


@query("e08_action_prefix", EPISODES + "select episode, steps, actions from ep")
def action_prefix(spark, d):
    return episodes(spark, d).select("episode", "steps", "actions")


@query("q09_reward_backprop", EPISODES + "select event_id, reward, round(least(1, greatest(0, 0.5 + case when reward >= 0.5 then 0.1 else -0.1 end)), 6) as priority from e join ep on e.user_id = ep.episode")
def reward_backprop(spark, d):
    priority = T.clamp(0.5 + F.when(F.col("reward") >= 0.5, 0.1).otherwise(-0.1))
    reward = episodes(spark, d).select(F.col("episode").alias("user_id"), "reward")
    return table(spark, d, "events").join(reward, "user_id").select("event_id", "reward", F.round(priority, 6).alias("priority"))


@query("q10_policy_induction", EPISODES + "select actions, count(*) as support, round(avg(reward), 6) as mean_reward from ep where reward >= 0.2 group by actions having count(*) >= 2")
def policy_induction(spark, d):
    return episodes(spark, d).where("reward >= 0.2").groupBy("actions").agg(F.count("*").alias("support"), F.round(F.avg("reward"), 6).alias("mean_reward")).where("support >= 2")


@query("q12_consecutive_failures", """with o as (select user_id, ts, event_id, event_type <> 'error' as ok, count(*) filter (event_type <> 'error') over (partition by user_id order by ts desc, event_id desc rows unbounded preceding) as since from events)
  select user_id, count(*) filter (ok) as successes, count(*) filter (since = 0) as failing, count(*) filter (since = 0) >= 3 as retired from o group by 1""")
def consecutive_failures(spark, d):
    """Failures after a user's last success: rows with no success at or after them."""
    back = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ok = F.col("event_type") != "error"
    rows = table(spark, d, "events").withColumn("since", F.count_if(ok).over(back))
    return rows.groupBy("user_id").agg(F.count_if(ok).alias("successes"), F.count_if(F.col("since") == 0).alias("failing")).withColumn("retired", F.col("failing") >= 3)


@query("d15_recent_outcomes", """with r as (select user_id, case when event_type = 'error' then 0.0 else 1.0 end as ok, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events)
  select user_id, round(sum(ok / k) / sum(1.0 / k), 6) as ratio from r where k <= 20 group by 1""")
def recent_outcomes(spark, d):
    order = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    rows = table(spark, d, "events").withColumn("k", F.row_number().over(order)).where("k <= 20")
    ok = F.when(F.col("event_type") == "error", 0.0).otherwise(1.0)
    return rows.groupBy("user_id").agg(F.round(F.sum(ok / F.col("k")) / F.sum(1.0 / F.col("k")), 6).alias("ratio"))


@query("k24_procedure_rank", EPISODES + """, s as (select episode, actions, round(0.35 * (len(regexp_extract_all(actions, 'purchase')) / 3.0) + 0.30 * reward + 0.20 * 0.5 + 0.15 * power(0.5, epoch(timestamp '2024-02-01' - ended) / 86400.0 / 30.0), 6) as score from ep)
  select episode, score, rank from (select *, row_number() over (order by score desc, episode) as rank from s) where rank <= 10""")
def procedure_rank(spark, d):
    """The ten best episodes for a goal, by text, reward, outcome and recency."""
    age = T.days_between(F.lit("2024-02-01").cast("timestamp_ntz"), F.col("ended"))
    text = F.regexp_count("actions", F.lit("purchase")) / 3.0
    score = F.round(0.35 * text + 0.30 * F.col("reward") + 0.20 * 0.5 + 0.15 * T.half_life(age, 30.0), 6)
    best = episodes(spark, d).select("episode", score.alias("score")).orderBy(F.col("score").desc(), "episode").limit(10)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "episode")).cast("long"))


IDLE = "epoch(timestamp '2001-08-01' - o_orderdate) / 86400.0"
SCOPE = "case o_orderstatus when 'F' then 'permanent' when 'O' then 'identity' else 'temporal' end"
LIFE = "case o_orderstatus when 'F' then 90.0 when 'O' then 365.0 else 45.0 end"


def idle():
    return T.days_between(at("2001-08-01"), F.col("o_orderdate"))


def scope():
    return F.when(F.col("o_orderstatus") == "F", "permanent").when(F.col("o_orderstatus") == "O", "identity").otherwise("temporal")


@query("p02_activation_decay", f"select o_orderkey, round(o_totalprice / 500000 * power(0.5, {IDLE} / {LIFE}), 6) as activation, {IDLE} > greatest(0, {LIFE} * log2(greatest(o_totalprice / 500000, 1e-12) / 0.05)) + 7 as archived from orders")
def activation_decay(spark, d):
    base = F.col("o_totalprice") / 500000
    return table(spark, d, "orders").select("o_orderkey", F.round(L.decayed(base, idle(), scope()), 6).alias("activation"), L.archives(base, idle(), scope()).alias("archived"))


@query("p03_linear_decay", f"select o_orderkey, round(greatest(0.1, o_totalprice / 500000 * (1 - least(1, {IDLE} / 720.0))), 6) as confidence from orders")
def linear_decay(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(L.linear_decay(F.col("o_totalprice") / 500000, idle(), 720.0), 6).alias("confidence"))


@query("p01_expire", H + "select case when least(expires_at, valid_to) <= timestamp '1998-06-01' then 'expired' else status end as status, count(*) as n from h group by 1")
def expire(spark, d):
    end = F.least("expires_at", "valid_to")
    return history(spark, d).groupBy(F.when(end <= at(), "expired").otherwise(F.col("status")).alias("status")).agg(F.count("*").alias("n"))


@query("p05_cleanup_eligible", """select o_orderkey from orders o where o_orderstatus = 'F' and o_orderdate < timestamp '1996-01-01' and not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_returnflag = 'R')""")
def cleanup_eligible(spark, d):
    old = table(spark, d, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < at("1996-01-01")))
    consumers = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return old.join(consumers, "o_orderkey", "left_anti").select("o_orderkey")


@query("p06_delete_closure", """with t as (select o_orderkey from orders where o_orderstatus = 'F'), g as (select * from lineitem where l_orderkey in (select o_orderkey from t)), k as (select distinct l_partkey from lineitem where l_orderkey not in (select o_orderkey from t))
  select 'links' as what, count(*) as n from g union all select 'orphans', count(*) from part where p_partkey in (select l_partkey from g) and p_partkey not in (select l_partkey from k)""")
def delete_closure(spark, d):
    targets = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("derived_id"), F.col("l_partkey").alias("event_id"))
    gone, orphans = L.delete_closure(targets, links, table(spark, d, "part").select(F.col("p_partkey").alias("event_id")))
    counted = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return counted(gone, "links").unionByName(counted(orphans, "orphans"))


@query("p09_purge_events", "select user_id, count(*) as purged from events where ts < timestamp '2024-01-10' and event_type <> 'purchase' group by 1")
def purge_events(spark, d):
    old = (F.col("ts") < at("2024-01-10")) & (F.col("event_type") != "purchase")
    return table(spark, d, "events").where(old).groupBy("user_id").agg(F.count("*").alias("purged"))


@query("p11_access_counts", "select user_id, count(*) as accesses, max(ts) as last_access from events where event_type = 'view' group by 1")
def access_counts(spark, d):
    return table(spark, d, "events").where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("accesses"), F.max("ts").alias("last_access"))


@query("r02_stale_derivations", "select o_custkey from orders group by 1 having max(o_orderdate) filter (o_orderstatus = 'P') > max(o_orderdate) filter (o_orderstatus = 'F')")
def stale_derivations(spark, d):
    newest = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.col("o_orderdate")))
    return table(spark, d, "orders").groupBy("o_custkey").agg(newest("P").alias("changed"), newest("F").alias("built")).where("changed > built").select("o_custkey")


@query("d12_observations", """select o_custkey, o_orderpriority, count(*) as proofs, round(avg(o_totalprice), 4) as mean_value, min(o_orderdate) as first_seen, max(o_orderdate) as last_seen, string_agg(distinct o_orderstatus, ',' order by o_orderstatus) as statuses from orders group by 1, 2 having count(*) >= 2""")
def observations(spark, d):
    statuses = F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ",")
    rows = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("proofs"), F.round(F.avg("o_totalprice"), 4).alias("mean_value"), F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("last_seen"), statuses.alias("statuses"))
    return rows.where("proofs >= 2")


@query("r04_dangling", """select 'order' as kind, l_orderkey as key from lineitem where l_orderkey not in (select o_orderkey from orders) union all select 'document', doc_id from labels where doc_id not in (select doc_id from documents)
  union all select 'customer', c_custkey from customer where c_custkey not in (select o_custkey from orders) union all select 'vector', doc_id from documents where doc_id not in (select vec_id from embeddings)""")
def dangling(spark, d):
    t = lambda n: table(spark, d, n)
    found = L.dangling(t("lineitem"), "l_orderkey", t("orders"), "o_orderkey", "order").unionByName(L.dangling(t("labels"), "doc_id", t("documents"), "doc_id", "document"))
    found = found.unionByName(L.dangling(t("customer"), "c_custkey", t("orders"), "o_custkey", "customer"))
    return found.unionByName(L.dangling(t("documents"), "doc_id", t("embeddings"), "vec_id", "vector"))


@query("g03_index_completeness", "with s as (select doc_id from documents), i as (select vec_id as doc_id from embeddings) (select doc_id, 'source' as side from s except all select doc_id, 'source' from i) union all (select doc_id, 'index' from i except all select doc_id, 'index' from s)")
def index_completeness(spark, d):
    return L.missing_both_ways(table(spark, d, "documents").select("doc_id"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")))


@query("r05_integrity", "select count(*) as documents, count(*) filter (text is null or text = '') as without_text, count(*) filter (n_chars <> length(text)) as wrong_length, count(distinct sha256(text)) as texts from documents")
def integrity(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("documents"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("without_text"), F.count_if(F.col("n_chars") != F.length("text")).alias("wrong_length"), F.count_distinct(F.sha2("text", 256)).alias("texts"))


EDGES = "e as (select p.p_brand as from_id, n.n_name as to_id, round(least(1, count(*) / 40.0), 6) as weight from lineitem l join part p on l.l_partkey = p.p_partkey join supplier s on l.l_suppkey = s.s_suppkey join nation n on s.s_nationkey = n.n_nationkey where l.l_discount >= 0.09 group by all), b as (select * from e union all select to_id, from_id, weight from e)"


def edges(spark, d):
    """Brands and the nations that supply them, weighted by the line items they share."""
    lines = table(spark, d, "lineitem").where("l_discount >= 0.09").select("l_partkey", "l_suppkey")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("from_id"))
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("to_id"))
    rows = lines.join(part, "l_partkey").join(supplier, "l_suppkey").join(nation, "s_nationkey")
    return stored(rows.groupBy("from_id", "to_id").agg(F.round(F.least(F.lit(1.0), F.count("*") / 40.0), 6).alias("weight")), "edges")


@query("c10_either_end", f"with {EDGES} select from_id as node, count(*) as degree, round(sum(weight), 4) as weight from b group by 1")
def either_end(spark, d):
    return graph.symmetric(edges(spark, d)).groupBy(F.col("from_id").alias("node")).agg(F.count("*").alias("degree"), F.round(F.sum("weight"), 4).alias("weight"))


SEEDS = "seeds as (select n_name as node from nation where n_regionkey = 0)"
WALK = f"""with {EDGES}, {SEEDS}, w1 as (select node as seed, to_id as node, 1 as hops, weight, [node, to_id] as path from seeds join b on from_id = node where weight >= 0.2),
w2 as (select seed, to_id as node, 2 as hops, w1.weight * b.weight as weight, list_append(path, to_id) as path from w1 join b on from_id = node where b.weight >= 0.2 and not list_contains(path, to_id)),
w as (select seed, node, hops, weight from w1 union all select seed, node, hops, weight from w2)
"""


@query("l03_walk", WALK + "select seed, node, hops::bigint as hops, count(*) as paths, round(sum(weight), 8) as weight from w group by all")
def walk(spark, d):
    seeds = table(spark, d, "nation").where("n_regionkey = 0").select(F.col("n_name").alias("node"))
    found = graph.walk(edges(spark, d), seeds, 2, 0.2)
    return found.groupBy("seed", "node", "hops").agg(F.count("*").alias("paths"), F.round(F.sum("weight"), 8).alias("weight"))


@query("l04_expand", WALK.replace("where weight >= 0.2)", ")").replace("b.weight >= 0.2 and ", "") + ", x as (select seed, node, max(weight * power(0.175, hops)) as reached, min(hops) as hops from w group by all), r as (select *, row_number() over (partition by seed order by round(reached, 9) desc, node) as rank from x) select seed, node, round(reached, 12) as reached, hops::bigint as hops from r where rank <= 50")
def expand(spark, d):
    seeds = table(spark, d, "nation").where("n_regionkey = 0").select(F.col("n_name").alias("node"), F.lit(1.0).alias("score"))
    return graph.expand(edges(spark, d), seeds, 2, beam=50).select("seed", "node", F.round("reached", 12).alias("reached"), "hops")


@query("l05_chain_tip", H + ", t as (select o_custkey, max(version) as last from h group by 1) select h.o_orderkey as node, case when t.last - h.version <= 32 then z.o_orderkey end as tip from h join t using (o_custkey) join h z on z.o_custkey = h.o_custkey and z.version = t.last where h.superseded_by is not null")
def chain_tip(spark, d):
    links = history(spark, d).where("superseded_by is not null").select(F.col("o_orderkey").alias("node"), F.col("superseded_by").alias("next"))
    return graph.tips(links)


@query("l02_neighbours", f"with {EDGES}, {SEEDS} select node as seed, to_id as node, weight from seeds join b on from_id = node")
def neighbours(spark, d):
    seeds = table(spark, d, "nation").where("n_regionkey = 0").select(F.col("n_name").alias("seed"))
    both = graph.symmetric(edges(spark, d))
    return seeds.join(both, seeds["seed"] == both["from_id"]).select("seed", F.col("to_id").alias("node"), "weight")
