"""Relational queries over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.plans.registry import query
from tessera.sources.tables import table

MONEY = "l_extendedprice * (1 - l_discount)"


def revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@query("host_q1_pricing", f"select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum({MONEY}), 2) as revenue, round(avg(l_discount), 6) as mean_discount, count(*) as n from lineitem where l_shipdate <= timestamp '2000-12-01' group by 1, 2")
def pricing(spark, d):
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("2000-12-01").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(revenue()), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.count("*").alias("n"))


@query("host_q3_top_orders", f"select o_orderkey, o_orderdate, round(sum({MONEY}), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey where c_mktsegment = 'BUILDING' and o_orderdate < timestamp '1998-01-01' group by 1, 2 order by revenue desc, o_orderkey limit 10")
def top_orders(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    o = table(spark, d, "orders").where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).select("o_custkey", "o_orderkey", "o_orderdate")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice", "l_discount")
    rows = o.join(c, "o_custkey").join(li, "o_orderkey").groupBy("o_orderkey", "o_orderdate").agg(F.round(F.sum(revenue()), 2).alias("revenue"))
    return rows.orderBy(F.col("revenue").desc(), "o_orderkey").limit(10)


@query("host_q5_nations", f"select n_name, round(sum({MONEY}), 2) as revenue from region join nation on n_regionkey = r_regionkey join supplier on s_nationkey = n_nationkey join lineitem on l_suppkey = s_suppkey where r_name = 'AFRICA' group by 1")
def nations(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region").where("r_name = 'AFRICA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    rows = table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(revenue()), 2).alias("revenue"))


CUBE = "select {} as status, {} as priority, count(*) as n, round(sum(o_totalprice), 2) as total, grouping(o_orderstatus)::bigint as all_status, grouping(o_orderpriority)::bigint as all_priority from orders group by {}"


def grouped(rows):
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping("o_orderstatus").cast("long").alias("all_status"), F.grouping("o_orderpriority").cast("long").alias("all_priority")).withColumnsRenamed({"o_orderstatus": "status", "o_orderpriority": "priority"})


@query("host_cube", CUBE.format("o_orderstatus", "o_orderpriority", "cube (o_orderstatus, o_orderpriority)"))
def cube(spark, d):
    return grouped(table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority"))


@query("host_rollup", CUBE.format("o_orderstatus", "o_orderpriority", "rollup (o_orderstatus, o_orderpriority)"))
def rollup(spark, d):
    return grouped(table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority"))


@query("host_grouping_sets", CUBE.format("o_orderstatus", "o_orderpriority", "grouping sets ((o_orderstatus), (o_orderpriority))"))
def grouping_sets(spark, d):
    return grouped(table(spark, d, "orders").groupingSets([["o_orderstatus"], ["o_orderpriority"]], "o_orderstatus", "o_orderpriority"))


@query("host_full_outer", "with c as (select c_nationkey as k, count(*) as customers from customer where c_acctbal > 9000 group by 1), s as (select s_nationkey as k, count(*) as suppliers from supplier where s_acctbal > 5000 group by 1) select coalesce(c.k, s.k) as nation, coalesce(customers, 0) as customers, coalesce(suppliers, 0) as suppliers from c full join s on c.k = s.k")
def full_outer(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nation", "full").select("nation", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("c12_semi", "select o_orderpriority, count(*) as n from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R') group by 1")
def semi(spark, d):
    late = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(late, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("c13_anti", "select c_custkey, c_mktsegment from customer where c_custkey not in (select o_custkey from orders)")
def anti(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("c08_by_type_join", "select e.event_id, e.event_type, case when event_type = 'view' then d.lang when event_type = 'click' then n.n_name end as label from events e left join documents d on e.event_type = 'view' and d.doc_id = e.user_id left join nation n on e.event_type = 'click' and n.n_nationkey = e.user_id % 25")
def by_type_join(spark, d):
    """Each kind of evidence joins its own table; keys of other kinds are null and match nothing."""
    e = table(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_type") == "view", F.col("user_id")).alias("doc_id"), F.when(F.col("event_type") == "click", F.col("user_id") % 25).alias("n_nationkey"))
    rows = e.join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "left").join(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", "left")
    return rows.select("event_id", "event_type", F.coalesce("lang", "n_name").alias("label"))


@query("c18_enrich", "select o_orderkey, count(l_linenumber) as lines, coalesce(string_agg(distinct l_returnflag, ',' order by l_returnflag), '') as flags, any_value(c_mktsegment) as segment from orders join customer on c_custkey = o_custkey left join lineitem on l_orderkey = o_orderkey group by 1")
def enrich(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("flags"))
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment")), "c_custkey")
    return rows.join(lines, "o_orderkey", "left").select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("flags", F.lit("")).alias("flags"), "segment")


@query("f04_page", "select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey desc limit 20 offset 40")
def page(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).offset(40).limit(20)


@query("f05_keyset", "select o_orderkey, o_orderdate from orders where (o_orderdate, o_orderkey) < (timestamp '1998-06-01', 1000) order by o_orderdate desc, o_orderkey desc limit 20")
def keyset(spark, d):
    """The page after a cursor; the comparison also prunes row groups by date."""
    date = F.lit("1998-06-01").cast("timestamp_ntz")
    after = (F.col("o_orderdate") < date) | ((F.col("o_orderdate") == date) & (F.col("o_orderkey") < 1000))
    return table(spark, d, "orders").where(after).select("o_orderkey", "o_orderdate").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(20)


@query("f07_case_order", "select o_custkey, o_orderkey, place from (select *, row_number() over (partition by o_custkey order by case o_orderstatus when 'O' then 0 when 'P' then 1 else 2 end, o_orderdate desc, o_orderkey) as place from orders) where place = 1")
def case_order(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    order = Window.partitionBy("o_custkey").orderBy(status, F.col("o_orderdate").desc(), "o_orderkey")
    return table(spark, d, "orders").withColumn("place", F.row_number().over(order).cast("long")).where("place = 1").select("o_custkey", "o_orderkey", "place")


@query("f11_winner", "with r as (select o_orderkey, o_custkey, o_orderdate, count(l_linenumber) as refs from orders left join lineitem on l_orderkey = o_orderkey group by all) select o_custkey, o_orderkey, refs from (select *, row_number() over (partition by o_custkey order by refs desc, o_orderdate, o_orderkey) as k from r) where k = 1")
def winner(spark, d):
    refs = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("refs"))
    rows = table(spark, d, "orders").join(refs, "o_orderkey", "left").withColumn("refs", F.coalesce("refs", F.lit(0)))
    order = Window.partitionBy("o_custkey").orderBy(F.col("refs").desc(), "o_orderdate", "o_orderkey")
    return rows.withColumn("k", F.row_number().over(order)).where("k = 1").select("o_custkey", "o_orderkey", "refs")


@query("g01_union_all", "select kind, count(*) as n from (select 'customer' as kind, c_nationkey as k from customer union all select 'supplier', s_nationkey from supplier) where k < 10 group by 1")
def union_all(spark, d):
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("k"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("k"))
    return c.unionByName(s).where("k < 10").groupBy("kind").agg(F.count("*").alias("n"))


@query("g02_union_distinct", "select l_partkey as key from lineitem where l_quantity >= 49 union select l_suppkey from lineitem where l_quantity >= 49")
def union_distinct(spark, d):
    rows = table(spark, d, "lineitem").where("l_quantity >= 49")
    return rows.select(F.col("l_partkey").alias("key")).union(rows.select("l_suppkey")).distinct()


@query("g04_intersect", "select o_custkey from orders where o_orderstatus = 'O' intersect select o_custkey from orders where o_orderpriority = '1-URGENT'")
def intersect(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'O'").select("o_custkey").intersect(o.where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("g04_except", "select o_custkey from orders where o_orderstatus = 'O' except select o_custkey from orders where o_orderpriority = '1-URGENT'")
def except_(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'O'").select("o_custkey").subtract(o.where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("g05_ordered_distinct", "select o_custkey, string_agg(o_orderstatus, '' order by first) as statuses from (select o_custkey, o_orderstatus, min(o_orderkey) as first from orders group by 1, 2) group by 1")
def ordered_distinct(spark, d):
    first = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderkey").alias("first"))
    kept = F.transform(F.sort_array(F.collect_list(F.struct("first", "o_orderstatus"))), lambda x: x["o_orderstatus"])
    return first.groupBy("o_custkey").agg(F.array_join(kept, "").alias("statuses"))


@query("g06_distinct", "select distinct p_brand, p_type from part")
def distinct(spark, d):
    return table(spark, d, "part").select("p_brand", "p_type").distinct()


@query("host_ranks", "select o_orderkey, rank() over w as r, dense_rank() over w as dr, ntile(4) over (partition by o_custkey order by o_totalprice, o_orderkey) as quartile, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding), 2) as running from orders window w as (partition by o_custkey order by o_orderpriority)")
def ranks(spark, d):
    w = Window.partitionBy("o_custkey")
    by = w.orderBy("o_orderpriority")
    running = F.sum("o_totalprice").over(w.orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return table(spark, d, "orders").select("o_orderkey", F.rank().over(by).cast("long").alias("r"), F.dense_rank().over(by).cast("long").alias("dr"), F.ntile(4).over(w.orderBy("o_totalprice", "o_orderkey")).cast("long").alias("quartile"), F.round(running, 2).alias("running"))


@query("e09_partition_max", "select o_orderkey, round(ln(1 + o_totalprice) / ln(1 + max(o_totalprice) over (partition by o_custkey)), 6) as access from orders")
def partition_max(spark, d):
    most = F.max("o_totalprice").over(Window.partitionBy("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", F.round(F.log1p("o_totalprice") / F.log1p(most), 6).alias("access"))


@query("host_percentile", "select o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) as median, round(quantile_cont(o_totalprice, 0.9), 4) as p90 from orders group by 1")
def percentile(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.percentile("o_totalprice", 0.5), 4).alias("median"), F.round(F.percentile("o_totalprice", 0.9), 4).alias("p90"))


@query("host_asof", "with c as (select o_custkey as k, o_orderdate as at, max(o_orderkey) as o_orderkey from orders group by all), e as (select event_id, user_id, ts - interval 8000 day as at from events) select event_id, (select max_by(o_orderkey, c.at) from c where c.k = e.user_id and c.at <= e.at) as o_orderkey from (select event_id, user_id, timestamp '1996-01-01' + (event_id % 1500) * interval 1 day as at from events) e")
def asof(spark, d):
    """The latest order of a user at or before an instant: both sides in one ordered stream, the last value carried."""
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at")).agg(F.max("o_orderkey").alias("o_orderkey"))
    at = F.lit("1996-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("event_id") % 1500).cast("int"))
    asks = table(spark, d, "events").select(F.col("user_id").alias("k"), at.alias("at"), F.col("event_id"))
    both = orders.withColumn("event_id", F.lit(None).cast("long")).unionByName(asks.withColumn("o_orderkey", F.lit(None).cast("long")))
    order = Window.partitionBy("k").orderBy("at", F.col("event_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("o_orderkey", F.last("o_orderkey", ignorenulls=True).over(order)).where("event_id is not null").select("event_id", "o_orderkey")


@query("d08_grouped_range", "select source, lang, count(*) as n, min(n_chars) as least, max(n_chars) as most from documents group by 1, 2")
def grouped_range(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query("d18_table_rows", " union all ".join(f"select '{t}' as name, count(*) as n from {t}" for t in ("customer", "documents", "events", "lineitem", "orders")))
def table_rows(spark, d):
    counts = [table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("customer", "documents", "events", "lineitem", "orders")]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("h26_text_features", "select doc_id, length(text) as n, len(string_split(text, chr(10))) as lines, upper(substr(text, 1, 1)) as initial, sha256(text) as sha from documents where text is not null")
def text_features(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.length("text").cast("long").alias("n"), F.size(F.split("text", "\n")).cast("long").alias("lines"), X.initial(F.col("text")).alias("initial"), F.sha2("text", 256).alias("sha"))


@query("h12_index_text", "select o_orderkey, 'customer ' || o_custkey || ': ' || case o_orderstatus when 'O' then 'open' when 'F' then 'filled' else 'pending' end || ' (' || lower(o_orderpriority) || ')' as index_text from orders")
def index_text(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "filled").otherwise("pending")
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("customer "), F.col("o_custkey").cast("string"), F.lit(": "), status, F.lit(" ("), F.lower("o_orderpriority"), F.lit(")")).alias("index_text"))


@query("w_pages_by_host", "select regexp_extract(url, '://([^/?#]+)', 1) as host, count(*) as pages, sum(length(html))::bigint as n_chars from pages group by 1")
def pages_by_host(spark, d):
    return table(spark, d, "pages").groupBy(F.regexp_extract("url", "://([^/?#]+)", 1).alias("host")).agg(F.count("*").alias("pages"), F.sum(F.length("html")).alias("n_chars"))
