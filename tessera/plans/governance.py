"""Ingest rules, keys, repairs, derived memory and audits over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import rules as R
from tessera.functions import temporal as T
from tessera.functions import text as X
from tessera.functions.times import occurrence
from tessera.operators import lifecycle as L
from tessera.operators.ranking import placed
from tessera.plans.facts import H, at, history
from tessera.plans.registry import ORACLE_SQL, query
from tessera.sources import event_log
from tessera.sources.tables import table


@query("a01_append_conflicts", "select event_id from events where event_id % 10 = 3 and value is not null")
def append_conflicts(spark, d):
    """Every tenth event comes again with another payload: a conflict; the rest comes again as it is."""
    log = table(spark, d, "events")
    again = log.withColumn("value", F.when(F.col("event_id") % 10 == 3, F.col("value") + 1).otherwise(F.col("value")))
    return event_log.append(log, again)[1].select("event_id")


@query("a02_batch_ingest", "select event_id, user_id, recorded_at from (select event_id, user_id, timestamp '2024-02-01' + to_microseconds(row_number() over (partition by user_id order by ts, event_id)) as recorded_at from events)")
def batch_ingest(spark, d):
    """Recorded a microsecond apart in the order of events, per user."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    recorded = F.timestamp_micros(F.lit(1_706_745_600_000_000) + k).cast("timestamp_ntz")
    return table(spark, d, "events").select("event_id", "user_id", recorded.alias("recorded_at"))


@query("a04_batched_lookup", "select o_orderkey, o_orderstatus from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity = 50)")
def batched_lookup(spark, d):
    ids = table(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(ids, "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus")


@query("a13_manifest", "select 'orders' as name, count(*) as rows, sum(o_orderkey)::bigint as key_sum from orders")
def manifest(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("key_sum")).select(F.lit("orders").alias("name"), "rows", "key_sum")


@query("a15_audit_retention", "select event_type, count(*) as kept, min(ts) as oldest from events where ts >= timestamp '2024-01-20' or event_type = 'error' group by 1")
def audit_retention(spark, d):
    kept = (F.col("ts") >= at("2024-01-20")) | (F.col("event_type") == "error")
    return table(spark, d, "events").where(kept).groupBy("event_type").agg(F.count("*").alias("kept"), F.min("ts").alias("oldest"))


@query("b05_partition_predicate", "select lang, count(*) as n from documents where lang = 'de' group by 1")
def partition_predicate(spark, d):
    return table(spark, d, "documents").where("lang = 'de'").groupBy("lang").agg(F.count("*").alias("n"))


@query("b06_null_safe_subject", "select doc_id from documents where source is not distinct from (select source from documents where doc_id = 2)")
def null_safe_subject(spark, d):
    docs = table(spark, d, "documents")
    one = docs.where("doc_id = 2").select(F.col("source").alias("wanted"))
    return docs.join(F.broadcast(one), docs["source"].eqNullSafe(F.col("wanted")), "left_semi").select("doc_id")


@query("b07_tagged_since", "select doc_id from documents where doc_id > 100 and (lang in ('de', 'fr') or source = 'src0')")
def tagged_since(spark, d):
    tags = F.array(*map(F.lit, ("de", "fr", "src0")))
    return table(spark, d, "documents").where((F.col("doc_id") > 100) & F.arrays_overlap(F.array("lang", "source"), tags)).select("doc_id")


@query("b08_literal_match", "select doc_id from documents where contains(lower(text), '100%_') or contains(lower(text), 'cc by-nc')")
def literal_match(spark, d):
    return table(spark, d, "documents").where(R.contains_literal(F.col("text"), "100%_") | R.contains_literal(F.col("text"), "CC BY-NC")).select("doc_id")


LOW = "lower(trim(coalesce(text, ''), ' '))"


@query("b12_pre_filter", rf"""select conv_id, turn, case when regexp_matches({LOW}, '^\[(system|runtime|notice)\]') then 'runtime_notice' when regexp_matches({LOW}, '^<(tool|function)[a-z_]*>') then 'control_frame' when regexp_matches({LOW}, '^(error|exception|traceback|exit code)\b') then 'transient_error'
  when regexp_matches({LOW}, '^(let me|i will now|now i)\b') then 'narration' when regexp_matches({LOW}, '^(is it|are we|status)\b.*[?]$') then 'status_question' else 'keep' end as verdict from conversations""")
def pre_filter(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(R.pre_filter(F.col("text")), F.lit("keep")).alias("verdict"))


@query("b13_admission", """with c as (select o_orderkey, case o_orderstatus when 'O' then 'fact' when 'F' then 'state' else 'other' end as kind, o_totalprice / 450000 as confidence, case when o_orderkey % 7 = 0 then 'v1.2' else o_orderpriority end as v from orders)
  select o_orderkey, case when kind = 'other' then 'kind' when confidence > 1 then 'confidence' when v = 'v1.2' then 'low_value:number_or_version' else 'admit' end as verdict from c""")
def admission(spark, d):
    kind = F.when(F.col("o_orderstatus") == "O", "fact").when(F.col("o_orderstatus") == "F", "state").otherwise("other")
    value = F.when(F.col("o_orderkey") % 7 == 0, "v1.2").otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", R.admission(kind, F.col("o_totalprice") / 450000, X.secret_reason(value), X.low_value_reason(value)).alias("verdict"))


@query("b20_invalid_subject", r"select name, case when regexp_matches(name, '^([A-Z][a-z0-9]+){2,}$') then 'type_name' when regexp_matches(name, '^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$') then 'environment_variable' else 'ok' end as verdict from (select n_name as name from nation union select p_brand from part union select p_type from part)")
def invalid_subject(spark, d):
    names = table(spark, d, "nation").select(F.col("n_name").alias("name")).union(table(spark, d, "part").select("p_brand")).union(table(spark, d, "part").select("p_type")).distinct()
    return names.select("name", F.coalesce(R.invalid_subject(F.col("name")), F.lit("ok")).alias("verdict"))


@query("b17_proposals", "select l_partkey, l_suppkey, case when l_partkey = l_suppkey then 'self' when l_discount > 0.09 then 'range' when s.s_nationkey is null then 'endpoint' when p.p_size > 40 then 'inactive' else 'ok' end as verdict, count(*) as n from lineitem left join supplier s on s_suppkey = l_suppkey left join part p on p_partkey = l_partkey group by all")
def proposals(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_discount").join(s, "l_suppkey", "left").join(p, "l_partkey", "left")
    verdict = F.when(F.col("l_partkey") == F.col("l_suppkey"), "self").when(F.col("l_discount") > 0.09, "range").when(F.col("s_nationkey").isNull(), "endpoint").when(F.col("p_size") > 40, "inactive").otherwise("ok")
    return rows.groupBy("l_partkey", "l_suppkey", verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("c02_typed_evidence", "select o_orderkey, l_linenumber, l_quantity from orders join lineitem on l_orderkey = o_orderkey and ((o_orderstatus = 'F' and l_returnflag = 'R') or (o_orderstatus = 'O' and l_returnflag = 'N'))")
def typed_evidence(spark, d):
    """The type is part of the key, so the join stays an equi-join."""
    kind = F.when(F.col("o_orderstatus") == "F", "R").when(F.col("o_orderstatus") == "O", "N")
    o = table(spark, d, "orders").select(F.col("o_orderkey"), kind.alias("l_returnflag"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_linenumber", "l_quantity")
    return o.join(li, ["o_orderkey", "l_returnflag"]).select("o_orderkey", "l_linenumber", "l_quantity")


@query("c11_tag_overlap", "with t as (select doc_id, unnest(string_split(lang || ',' || source, ',')) as tag from documents), u as (select item_id, unnest(['src' || item_id % 20, 'es']) as tag from benchmark) select item_id, tag, count(*) as n from u join t using (tag) group by all")
def tag_overlap(spark, d):
    return _tag_counts(spark, d, table(spark, d, "documents"))


def _tag_counts(spark, d, docs):
    """Documents are counted by tag before they meet the items."""
    t = docs.select(F.explode(F.array("lang", "source")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    u = table(spark, d, "benchmark").select("item_id", F.explode(F.array(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")), F.lit("es"))).alias("tag"))
    return u.join(t, "tag").groupBy("item_id", "tag").agg(F.sum("n").alias("n"))


@query("c20_evidence_lists", "select l_orderkey as o_orderkey, string_agg(l_linenumber::varchar, ',' order by l_linenumber, l_partkey) as evidence from lineitem group by 1")
def evidence_lists(spark, d):
    items = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_linenumber"].cast("string"))
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(items, ",").alias("evidence"))


@query("c22_shared_endpoints", "select l_partkey, count(distinct l_suppkey) as suppliers, count(distinct l_orderkey) as orders from lineitem where l_returnflag = 'R' group by 1 having count(distinct l_suppkey) > 1")
def shared_endpoints(spark, d):
    rows = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_orderkey").alias("orders"))
    return rows.where("suppliers > 1")


@query("d09_keep_first", "select l_orderkey, l_partkey, l_linenumber from (select *, row_number() over (partition by l_orderkey, l_partkey order by l_linenumber, l_suppkey) as r from lineitem) where r = 1")
def keep_first(spark, d):
    first = F.min(F.struct("l_linenumber", "l_suppkey"))
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(first.alias("f")).select("l_orderkey", "l_partkey", "f.l_linenumber")


@query("d10_latest_updated", "select o_custkey, max(o_orderdate) as updated from orders group by 1 order by updated desc, o_custkey limit 25")
def latest_updated(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("updated")).orderBy(F.col("updated").desc(), "o_custkey").limit(25)


@query("d19_variant_means", "select variant, round(avg(o_totalprice * w), 4) as mean from orders, (values ('base', 1.0), ('low', 0.9), ('high', 1.1)) v(variant, w) group by 1")
def variant_means(spark, d):
    """Means are linear: one pass makes sums, and variants weigh them."""
    variants = F.explode(F.array(*(F.struct(F.lit(k).alias("variant"), F.lit(w).alias("w")) for k, w in (("base", 1.0), ("low", 0.9), ("high", 1.1)))))
    return table(spark, d, "orders").agg(F.avg("o_totalprice").alias("m")).select(variants.alias("v"), "m").select("v.variant", F.round(F.col("m") * F.col("v.w"), 4).alias("mean"))


@query("d20_remaining_expired", "select 'events' as name, count(*) as n from events where ts < timestamp '2024-01-05' union all select 'orders', count(*) from orders where o_orderdate < timestamp '1995-06-01' union all select 'items', count(*) from lineitem where l_shipdate < timestamp '1995-06-01'")
def remaining_expired(spark, d):
    parts = [("events", "events", F.col("ts") < at("2024-01-05")), ("orders", "orders", F.col("o_orderdate") < at("1995-06-01")), ("items", "lineitem", F.col("l_shipdate") < at("1995-06-01"))]
    out = None
    for name, source, old in parts:
        n = table(spark, d, source).where(old).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("e05_quota_pack", """with r as (select lang, doc_id, n_chars, row_number() over (partition by lang order by n_chars, doc_id) as rank from documents), u as (select *, sum(n_chars) over (partition by lang order by rank rows unbounded preceding) as used from r)
  select lang, count(*) as taken, max(used)::bigint as used from u where used <= case lang when 'en' then 20000 else 5000 end group by 1""")
def quota_pack(spark, d):
    """Shortest first, each kind within its own quota."""
    quota = F.when(F.col("lang") == "en", 20000).otherwise(5000)
    rows = placed(table(spark, d, "documents").select("lang", "doc_id", "n_chars"), ["lang"], ["n_chars", "doc_id"], "n_chars").where(F.col("upto") <= quota)
    return rows.groupBy("lang").agg(F.count("*").alias("taken"), F.max("upto").alias("used"))


@query("e07_covered_versions", H + "select o_custkey, count(*) filter (version < last) as covered, max(o_orderkey) filter (version = last) as tip from (select *, max(version) over (partition by o_custkey) as last from h) group by 1")
def covered_versions(spark, d):
    rows = history(spark, d).withColumn("last", F.max("version").over(Window.partitionBy("o_custkey")))
    return rows.groupBy("o_custkey").agg(F.count_if(F.col("version") < F.col("last")).alias("covered"), F.max(F.when(F.col("version") == F.col("last"), F.col("o_orderkey"))).alias("tip"))


@query("f06_round_robin", "(select o_orderkey, 0 as pass from orders where o_orderkey > 5000 order by o_orderkey limit 30) union all (select o_orderkey, 1 from orders where o_orderkey <= 5000 order by o_orderkey limit 10)")
def round_robin(spark, d):
    """The next page after a cursor, then from the start."""
    o = table(spark, d, "orders").select("o_orderkey")
    after = o.where("o_orderkey > 5000").orderBy("o_orderkey").limit(30).withColumn("pass", F.lit(0))
    return after.unionByName(o.where("o_orderkey <= 5000").orderBy("o_orderkey").limit(10).withColumn("pass", F.lit(1)))


@query("f08_nulls_first", "select doc_id, quality from (select d.doc_id, l.quality, row_number() over (order by l.quality nulls first, d.doc_id) as r from documents d left join labels l using (doc_id)) where r <= 50")
def nulls_first(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.orderBy(F.col("quality").asc_nulls_first(), "doc_id").limit(50)


@query("f09_priority", "select c_custkey from customer order by (c_mktsegment = 'BUILDING') desc, (c_acctbal > 5000) desc, c_acctbal desc, c_custkey limit 40")
def priority(spark, d):
    order = [(F.col("c_mktsegment") == "BUILDING").desc(), (F.col("c_acctbal") > 5000).desc(), F.col("c_acctbal").desc(), F.col("c_custkey")]
    return table(spark, d, "customer").orderBy(*order).limit(40).select("c_custkey")


@query("f12_oldest_batch", "select event_id from events order by ts, event_id limit 100")
def oldest_batch(spark, d):
    return table(spark, d, "events").orderBy("ts", "event_id").limit(100).select("event_id")


@query("g07_edge_union", H + "select distinct a, b from (select o_orderkey as a, superseded_by as b from h where superseded_by is not null union all select o_orderkey, superseded_by from h where status = 'superseded')")
def edge_union(spark, d):
    h = history(spark, d).select(F.col("o_orderkey").alias("a"), F.col("superseded_by").alias("b"), "status")
    return h.where("b is not null").select("a", "b").union(h.where("status = 'superseded'").select("a", "b")).distinct()


@query("h01_entity_ids")
def entity_ids(spark, d):
    """Names are normalised once each, whatever the number of rows that have them."""
    names = table(spark, d, "documents").select("source").union(table(spark, d, "customer").select("c_name")).union(table(spark, d, "part").select("p_name")).distinct().withColumnRenamed("source", "name")
    return names.select("name", R.entity_id("name").alias("entity"))


@query("h05_attributes", r"select conv_id, turn, case when regexp_matches(lower(text), '\bport [0-9]+') then 'config.port' when regexp_matches(lower(text), '\b(dark|light) (mode|theme)') then 'preference.ui_theme' when regexp_matches(lower(text), '\b(healthy|unhealthy|down)\b') then 'state.service_health' when regexp_matches(lower(text), '\bmy name is\b') then 'identity.name' when regexp_matches(lower(text), '\b(use|switch to) model\b') then 'choice.model' else 'none' end as attribute from conversations")
def attributes(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(R.attribute(F.col("text")), F.lit("none")).alias("attribute"))


OCCURS = """with r as (select conv_id, turn, turn % 7 as k, date '2024-01-15' + (conv_id % 28)::int as d from conversations),
w as (select *, (isodow(d) - 1)::int as dow from r),
o as (select conv_id, turn, case k when 0 then d - 1 when 1 then d - 14 when 2 then d - (case when dow = 0 then 7 else dow end) when 3 then date '2024-01-02' when 5 then d + 3 when 6 then d - dow + 7 end as s,
  case k when 0 then 1 when 3 then 4 when 6 then 7 else 1 end as days from w)
select conv_id, turn, s::timestamp as start, (s + days::int)::timestamp as "end" from o"""


@query("h20_occurrences", OCCURS)
def occurrences(spark, d):
    """What time a message means, if it says so in words."""
    said = F.lit("2024-01-15").cast("timestamp_ntz") + F.make_dt_interval((F.col("conv_id") % 28).cast("int"))
    phrases = "yesterday", "two weeks ago", "last monday", "from 2024-01-02 to 2024-01-05", "soon", "in 3 days", "next week"
    phrase = F.element_at(F.array(*map(F.lit, phrases)), (F.col("turn") % 7 + 1).cast("int"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", occurrence(F.concat_ws(" ", phrase, "text"), said).alias("o"))
    return rows.select("conv_id", "turn", F.col("o.start").alias("start"), F.col("o.end").alias("end"))


@query("h36_language", "select doc_id, case when de >= 3 and de >= fr and de >= es then 'de' when fr >= 3 and fr >= es then 'fr' when es >= 3 then 'es' else 'other' end as guess from (select doc_id, len(regexp_extract_all(lower(text), '[äöüß]')) as de, len(regexp_extract_all(lower(text), '[èêç]')) as fr, len(regexp_extract_all(lower(text), '[ñíó]')) as es from documents where text is not null)")
def language(spark, d):
    n = lambda p: F.regexp_count(F.lower("text"), F.lit(p))
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", n("[äöüß]").alias("de"), n("[èêç]").alias("fr"), n("[ñíó]").alias("es"))
    guess = F.when((F.col("de") >= 3) & (F.col("de") >= F.col("fr")) & (F.col("de") >= F.col("es")), "de").when((F.col("fr") >= 3) & (F.col("fr") >= F.col("es")), "fr").when(F.col("es") >= 3, "es").otherwise("other")
    return rows.select("doc_id", guess.alias("guess"))


@query("h35_confidence_ceiling", r"select conv_id, turn, case when regexp_matches(lower(text), '\b(maybe|perhaps|might|probably|planning to|considering)\b') then least(0.9, 0.6) else 0.9 end::double as confidence from conversations")
def ceiling(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", R.confidence_ceiling(F.lit(0.9), F.col("text")).cast("double").alias("confidence"))


@query("h39_clamp", "select o_orderkey, round(least(1, greatest(0, o_totalprice / 300000 - 0.2)), 8) as x, round(1 / (1 + exp(-least(35, greatest(-35, o_totalprice / 100000 - 2)))), 3) as p from orders")
def clamp(spark, d):
    logit = F.least(F.lit(35.0), F.greatest(F.lit(-35.0), F.col("o_totalprice") / 100000 - 2))
    return table(spark, d, "orders").select("o_orderkey", F.round(T.clamp(F.col("o_totalprice") / 300000 - 0.2), 8).alias("x"), F.round(1 / (1 + F.exp(-logit)), 3).alias("p"))


@query("h46_retention_anchor", "select l_orderkey, l_linenumber, l_partkey, greatest(l_shipdate, o_orderdate + interval 30 day) as anchor from lineitem join orders on o_orderkey = l_orderkey where l_returnflag = 'R'")
def retention_anchor(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    rows = table(spark, d, "lineitem").where("l_returnflag = 'R'").join(o, "l_orderkey")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.greatest("l_shipdate", F.col("o_orderdate") + F.expr("interval 30 day")).alias("anchor"))


@query("k16_freshness", "select o_orderkey, case when age < 30 then 'fresh' when age < 365 then 'recent' else 'old' end as label from (select o_orderkey, epoch(timestamp '2001-08-01' - o_orderdate) / 86400.0 as age from orders where o_orderpriority in ('1-URGENT', '2-HIGH'))")
def freshness(spark, d):
    age = T.days_between(at("2001-08-01"), F.col("o_orderdate"))
    rows = table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return rows.select("o_orderkey", F.when(age < 30, "fresh").when(age < 365, "recent").otherwise("old").alias("label"))


@query("k22_resurrection", H + ", last as (select * from h where valid_to is null) select a.o_custkey, max_by(a.o_orderkey, (a.valid_from, a.o_orderkey)) as candidate from h a where a.o_orderstatus = 'F' and not exists (select 1 from last l where l.o_custkey = a.o_custkey and l.status = 'active') group by 1")
def resurrection(spark, d):
    """The newest archived fact of a subject without an active rival."""
    h = history(spark, d)
    rivals = h.where("valid_to is null and status = 'active'").select("o_custkey")
    rows = h.where("o_orderstatus = 'F'").join(rivals, "o_custkey", "left_anti")
    return rows.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("valid_from", "o_orderkey")).alias("candidate"))


@query("k23_policy_match", "select item_id, event_type from benchmark, (select distinct event_type from events) where contains(lower(text), substr(event_type, 1, 3))")
def policy_match(spark, d):
    """The handful of policies goes along with each query row."""
    policies = table(spark, d, "events").groupBy().agg(F.collect_set("event_type").alias("p"))
    rows = table(spark, d, "benchmark").join(F.broadcast(policies), F.lit(True))
    return rows.select("item_id", F.explode(F.filter("p", lambda x: F.contains(F.lower(F.col("text")), F.substring(x, 1, 3)))).alias("event_type"))


@query("m04_correction", H + "select o_orderkey, case when o_orderkey % 100 = 0 then 'retracted' else status end as status, o_orderkey % 100 = 0 and valid_to is null as replaced from h")
def correction(spark, d):
    fixed = F.col("o_orderkey") % 100 == 0
    return history(spark, d).select("o_orderkey", F.when(fixed, "retracted").otherwise(F.col("status")).alias("status"), (fixed & F.col("valid_to").isNull()).alias("replaced"))


@query("m05_unchanged", H + "select count(*) as n, count(*) filter (same) as unchanged from (select o_totalprice is not distinct from lag(o_totalprice) over (partition by o_custkey order by version) and o_orderstatus is not distinct from lag(o_orderstatus) over (partition by o_custkey order by version) as same from h)")
def unchanged(spark, d):
    order = Window.partitionBy("o_custkey").orderBy("version")
    same = F.col("o_totalprice").eqNullSafe(F.lag("o_totalprice").over(order)) & F.col("o_orderstatus").eqNullSafe(F.lag("o_orderstatus").over(order))
    return history(spark, d).select(same.alias("same")).agg(F.count("*").alias("n"), F.count_if("same").alias("unchanged"))


@query("m11_reclassify", "select o_custkey, o_orderpriority, count(*) as n, count(*) filter (o_orderstatus = 'O') > 1 as collides from orders group by 1, 2")
def reclassify(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"), (F.count_if(F.col("o_orderstatus") == "O") > 1).alias("collides"))


@query("n06_blocking", "select source, lang, count(*) as block, count(*) * (count(*) - 1) // 2 as pairs from documents group by 1, 2")
def blocking(spark, d):
    n = F.count("*")
    return table(spark, d, "documents").groupBy("source", "lang").agg(n.alias("block"), F.floor(n * (n - 1) / 2).alias("pairs"))


@query("n12_merge_chunks", "select lower(trim(line)) as key, count(*) as n, count(distinct doc_id) as docs, min(doc_id) as first_doc from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where length(trim(line)) > 20 group by 1 having count(*) > 1")
def merge_chunks(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length(F.trim("line")) > 20)
    return lines.groupBy(F.lower(F.trim("line")).alias("key")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("o05_group_cases", "select o_custkey, o_orderpriority, count(distinct o_orderstatus) as candidates, count(*) as members, string_agg(distinct o_orderstatus, '|' order by o_orderstatus) as choices from orders group by 1, 2 having count(distinct o_orderstatus) > 1")
def group_cases(spark, d):
    states = F.sort_array(F.collect_set("o_orderstatus"))
    rows = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.size(states).cast("long").alias("candidates"), F.count("*").alias("members"), F.array_join(states, "|").alias("choices"))
    return rows.where("candidates > 1")


@query("o14_repair_plan", "select o_orderkey, case when k = 1 then 'keep' else 'supersede' end as action from (select o_orderkey, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate desc, o_orderkey desc) as k, count(*) over (partition by o_custkey, o_orderpriority) as n from orders where o_orderstatus = 'O') where n > 1")
def repair_plan(spark, d):
    keys = ["o_custkey", "o_orderpriority"]
    order = Window.partitionBy(*keys).orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    rows = table(spark, d, "orders").where("o_orderstatus = 'O'").withColumns({"k": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy(*keys))})
    return rows.where("n > 1").select("o_orderkey", F.when(F.col("k") == 1, "keep").otherwise("supersede").alias("action"))


@query("o17_established_winner", H + ", t as (select o_custkey, max(version) as last from h group by 1) select h.o_custkey, z.o_orderkey as tip, count(*) as chain from h join t using (o_custkey) join h z on z.o_custkey = h.o_custkey and z.version = t.last group by 1, 2")
def established_winner(spark, d):
    last = F.max_by("o_orderkey", "version")
    return history(spark, d).groupBy("o_custkey").agg(last.alias("tip"), F.count("*").alias("chain"))


@query("p04_stale_temporal", "select o_orderkey, case when o_orderpriority = '5-LOW' then 'promote' else 'expire' end as action from orders where o_orderstatus = 'P' and o_orderdate < timestamp '1996-01-01'")
def stale_temporal(spark, d):
    old = table(spark, d, "orders").where((F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < at("1996-01-01")))
    return old.select("o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", "promote").otherwise("expire").alias("action"))


@query("p08_tombstones", "select count(*) as live from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 10 = 0)")
def tombstones(spark, d):
    dead = table(spark, d, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(dead, "l_orderkey", "left_anti").agg(F.count("*").alias("live"))


@query("p10_history_cleanup", "select event_type, count(*) as n from (select *, row_number() over (partition by event_type order by ts, event_id) as k from events where ts < timestamp '2024-01-08') where k <= 200 group by 1")
def history_cleanup(spark, d):
    """At most 200 rows of each kind a round, oldest first: the bound is the feature."""
    order = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return table(spark, d, "events").where(F.col("ts") < at("2024-01-08")).withColumn("k", F.row_number().over(order)).where("k <= 200").groupBy("event_type").agg(F.count("*").alias("n"))


@query("q06_exposure_feedback", "select v.user_id, count(*) as votes from events v where v.event_type = 'purchase' and exists (select 1 from events e where e.event_type = 'view' and e.user_id = v.user_id and e.ts between v.ts - interval 1 day and v.ts) group by 1")
def exposure_feedback(spark, d):
    """A vote counts if its user was shown something in the day before: the last view is carried forward."""
    order = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "view", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = table(spark, d, "events").withColumn("shown", F.max(F.when(F.col("event_type") == "view", F.col("ts"))).over(order))
    near = (F.col("event_type") == "purchase") & (F.col("shown") >= F.col("ts") - F.expr("interval 1 day"))
    return rows.where(near).groupBy("user_id").agg(F.count("*").alias("votes"))


@query("q13_ranked_lists", "select user_id, n from (select user_id, count(*) as n from events where event_type = 'purchase' group by 1) order by n desc, user_id limit 15")
def ranked_lists(spark, d):
    return table(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "user_id").limit(15)


@query("r01_rebuild", "select o_custkey, count(*) as proofs, max(o_orderdate) as watermark, round(sum(o_totalprice), 2) as body from orders group by 1")
def rebuild(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("proofs"), F.max("o_orderdate").alias("watermark"), F.round(F.sum("o_totalprice"), 2).alias("body"))


@query("s09_since_watermark", "select o_orderpriority, count(*) as n from orders where o_orderdate > (select max(o_orderdate) - interval 365 day from orders) group by 1")
def since_watermark(spark, d):
    o = table(spark, d, "orders")
    mark = o.agg((F.max("o_orderdate") - F.expr("interval 365 day")).alias("mark"))
    return o.join(F.broadcast(mark), F.col("o_orderdate") > F.col("mark")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("s14_alert_dedupe", "select user_id, ts, event_id from (select *, lag(ts) over (partition by user_id order by ts, event_id) as before from events where event_type = 'error') where before is null or ts - before > interval 1 day")
def alert_dedupe(spark, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").where("event_type = 'error'").withColumn("before", F.lag("ts").over(order))
    return rows.where(F.col("before").isNull() | (F.col("ts") - F.col("before") > F.expr("interval 1 day"))).select("user_id", "ts", "event_id")


@query("v04_evidence_prf", "with g as (select doc_id from labels where quality = 0), f as (select doc_id from documents where regexp_matches(text, '[*#$%&]{3}|!!')) select (select count(*) from f join g using (doc_id)) as hits, (select count(*) from f join labels using (doc_id)) as found, (select count(*) from g) as gold")
def evidence_prf(spark, d):
    found = table(spark, d, "documents").where(F.col("text").rlike("[*#$%&]{3}|!!")).select("doc_id", F.lit(1).alias("f"))
    rows = table(spark, d, "labels").join(found, "doc_id", "left")
    return rows.agg(F.count_if((F.col("quality") == 0) & F.col("f").isNotNull()).alias("hits"), F.count_if(F.col("f").isNotNull()).alias("found"), F.count_if(F.col("quality") == 0).alias("gold"))


@query("v11_lifecycle_score", H + "select status, count(*) as n, count(*) filter (valid_to is not null) as closed, count(*) filter (valid_to is not null and recorded_to is not null and recorded_to >= valid_to) as sound from h group by 1")
def lifecycle_score(spark, d):
    closed = F.col("valid_to").isNotNull()
    return history(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.count_if(closed).alias("closed"), F.count_if(closed & (F.col("recorded_to") >= F.col("valid_to"))).alias("sound"))


@query("v12_classification", "with a as (select o_custkey from orders where o_orderstatus = 'O'), b as (select o_custkey from orders where o_orderpriority = '1-URGENT') select count(*) filter (x and y) as tp, count(*) filter (x and not y) as fn, count(*) filter (y and not x) as fp from (select coalesce(a.o_custkey, b.o_custkey) as k, a.o_custkey is not null as x, b.o_custkey is not null as y from (select distinct * from a) a full join (select distinct * from b) b using (o_custkey))")
def classification(spark, d):
    o = table(spark, d, "orders")
    marks = o.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "O").alias("x"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("y"))
    return marks.agg(F.count_if(F.col("x") & F.col("y")).alias("tp"), F.count_if(F.col("x") & ~F.col("y")).alias("fn"), F.count_if(~F.col("x") & F.col("y")).alias("fp"))


@query("v18_hash_sample", "select doc_id from documents order by sha256('seed' || doc_id), doc_id limit 40")
def hash_sample(spark, d):
    """A sample that any engine draws alike: the rows of least hash."""
    return table(spark, d, "documents").orderBy(F.sha2(F.concat(F.lit("seed"), F.col("doc_id").cast("string")), 256), "doc_id").limit(40).select("doc_id")


@query("y08_decay_replay", "select day, round(avg(o_totalprice / 500000 * power(0.5, day / 45.0)), 6) as mean_activation, count(*) filter (o_totalprice / 500000 * power(0.5, day / 45.0) < 0.05) as archived from orders, (select unnest([0, 30, 90, 180]) as day) group by 1")
def decay_replay(spark, d):
    days = F.explode(F.array(*map(F.lit, (0, 30, 90, 180)))).alias("day")
    rows = table(spark, d, "orders").select((F.col("o_totalprice") / 500000).alias("base"), days).withColumn("a", L.decayed(F.col("base"), F.col("day"), F.lit("temporal")))
    return rows.groupBy("day").agg(F.round(F.avg("a"), 6).alias("mean_activation"), F.count_if(F.col("a") < L.ARCHIVE_BELOW).alias("archived"))


@query("v15_weight_grid", "select w, round(avg(w * quality + (1 - w) * (1 - toxic)), 6) as mean from labels, (select unnest([0.0, 0.25, 0.5, 0.75, 1.0])::double as w) group by 1")
def weight_grid(spark, d):
    w = F.explode(F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("w")
    rows = table(spark, d, "labels").agg(F.avg("quality").alias("q"), F.avg(1 - F.col("toxic")).alias("t")).select(w, "q", "t")
    return rows.select("w", F.round(F.col("w") * F.col("q") + (1 - F.col("w")) * F.col("t"), 6).alias("mean"))
