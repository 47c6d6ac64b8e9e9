"""Whole flows: recall over query variants, the branches of the store, widening probes, boosts and comparisons of rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import fusion, lifecycle, retrieval
from tessera.plans.facts import H, history
from tessera.plans.lifecycle import SCORE
from tessera.plans.registry import ORACLE_SQL, query
from tessera.plans.retrieval import DENSE, FUSED, GOLD_ALL, INDEX, RERANK, SCORED, TERMS, asked, channels, fused, index, judged, needed, scored
from tessera.plans.scoring import TOP10
from tessera.sources.scratch import stored
from tessera.sources.tables import table


def best():
    return [F.col("score").desc(), F.col("doc_id")]


# Recall.

VARIANTS = INDEX.replace(
    f"asked as (select item_id as query_id, term from (select item_id, unnest({TERMS.format('text')}) as term from benchmark) group by all)",
    f"""words as (select item_id, unnest({TERMS.format('text')}) as term from benchmark),
asked as (select item_id * 2 as query_id, term from words group by all union all select item_id * 2 + 1, term from words where length(term) > 5 group by all)""",
)


def variants(spark, d):
    """Each item twice: with all its terms, and with those of more than five letters (odd ids)."""
    terms = asked(spark, d)
    whole = terms.select((F.col("query_id") * 2).alias("query_id"), "term")
    return whole.unionByName(terms.where(F.length("term") > 5).select((F.col("query_id") * 2 + 1).alias("query_id"), "term"))


@query("k04_variant_candidates", VARIANTS + "select query_id, doc_id, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from bm25) where rank <= 50")
def variant_candidates(spark, d):
    """The candidates of every variant of a query, each ranked by itself."""
    found = retrieval.bm25(table(spark, d, "documents"), "doc_id", F.col("text"), variants(spark, d)).withColumn("score", F.round("score", 6))
    return retrieval.top(found, 50, best()).select("query_id", "doc_id", "rank")


@query("k02_weighted_rrf", VARIANTS + "select query_id // 2 as query_id, doc_id, round(sum(case when query_id % 2 = 0 then 1.0 else 0.6 end / (60 + rank)), 8) as rrf from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from bm25) where rank <= 50 group by 1, 2")
def weighted_rrf(spark, d):
    """Variants fused by reciprocal ranks; a rewritten query weighs 0.6."""
    weight = F.when(F.col("query_id") % 2 == 0, 1.0).otherwise(0.6)
    ranked = variant_candidates(spark, d).select(F.floor(F.col("query_id") / 2).alias("query_id"), (F.col("query_id") % 2).alias("channel"), "doc_id", "rank", weight.alias("weight"))
    return fusion.rrf(ranked).select("query_id", "doc_id", F.round("rrf", 8).alias("rrf"))


VISIBLE = RERANK.replace("fused as (", "seen as (select ch.* from ch left join labels using (doc_id) where coalesce(toxic, 0) = 0), fused as (").replace("as channels from ch group by all", "as channels from seen group by all")


@query("k03_recall_flow", VISIBLE + "select query_id, doc_id, score, case when rerank > 0 then 'reranked' else 'prior' end as path, place as rank from bl_ranked where place <= 5")
def recall_flow(spark, d):
    """Collect by channel, drop what may not be seen, fuse, score, rerank, and keep the best five with how they were scored."""
    lexical = stored(retrieval.bm25(table(spark, d, "documents"), "doc_id", F.col("text"), asked(spark, d)).withColumn("score", F.round("score", 6)), "recall-bm25")
    hidden = table(spark, d, "labels").where("toxic = 1").select("doc_id").distinct()
    ch = channels(spark, d, lexical).join(hidden, "doc_id", "left_anti")
    found = retrieval.top(fusion.rrf(ch).withColumn("rrf", F.round("rrf", 8)), 10, [F.col("rrf").desc(), F.col("doc_id")])
    rows = found.join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    most = F.max("n_chars").over(Window.partitionBy("query_id"))
    rows = rows.withColumns({"semantic": F.least(F.lit(1.0), F.col("rrf") / (1.6 / 61)), "recency": 1.0 / (1.0 + F.col("n_chars") / 3000.0), "confidence": F.coalesce(F.col("quality").cast("double"), F.lit(0.5)), "utility": 1 - F.coalesce(F.col("toxic").cast("double"), F.lit(0.0)), "importance": F.lit(0.5), "access": F.log(1 + F.col("n_chars")) / F.log(1 + most)})
    rows = rows.drop("rank").join(lexical.select("query_id", "doc_id", "hits"), ["query_id", "doc_id"], "left").join(needed(spark, d), "query_id", "left")
    share = F.coalesce(F.col("hits"), F.lit(0)) / F.coalesce(F.col("k"), F.lit(1)).cast("double")
    rows = rows.withColumn("rerank", share).withColumn("score", F.round(fusion.blend(share, {k: F.col(k) for k in fusion.WEIGHTS}), 6))
    path = F.when(F.col("rerank") > 0, "reranked").otherwise("prior")
    return retrieval.top(rows, 5, best()).select("query_id", "doc_id", "score", path.alias("path"), "rank")


@query("k09_preference_boost", SCORED + f", i as ({ORACLE_SQL['h24_intent']}) select query_id, doc_id, round(score + case when intent = 'preference' then 0.12 * recency else 0 end, 6) as score from pre join i on item_id = query_id")
def preference_boost(spark, d):
    """A question about preferences favours what is recent."""
    asks = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), X.intent(F.col("text")).alias("intent"))
    boost = F.when(F.col("intent") == "preference", 0.12 * F.col("recency")).otherwise(0.0)
    return scored(spark, d).join(asks, "query_id").select("query_id", "doc_id", F.round(F.col("score") + boost, 6).alias("score"))


@query("k25_text_match", FUSED + f"select query_id, doc_id, round(case when contains(lower(d.text), lower(b.text)) then 1.0 else len(list_filter(list_distinct({TERMS.format('b.text')}), lambda t: contains(lower(d.text), t))) / greatest(1, len(list_distinct({TERMS.format('b.text')}))) end, 6) as match from ranked r join documents d using (doc_id) join benchmark b on b.item_id = r.query_id where r.rank <= 10 and b.text is not null and d.text is not null")
def text_match(spark, d):
    """The share of a query's terms that a result's text holds, or 1 if it holds the query as it is."""
    texts = table(spark, d, "documents").select("doc_id", F.lower("text").alias("text")).where("text is not null")
    asks = table(spark, d, "benchmark").where("text is not null").select(F.col("item_id").alias("query_id"), F.lower("text").alias("query"), F.array_distinct(X.terms(F.col("text"))).alias("terms"))
    share = F.size(F.filter("terms", lambda t: F.contains(F.col("text"), t))) / F.greatest(F.lit(1), F.size("terms"))
    match = F.when(F.contains("text", "query"), 1.0).otherwise(share)
    return fused(spark, d).join(asks, "query_id").join(texts, "doc_id").select("query_id", "doc_id", F.round(match, 6).alias("match"))


@query("j06_widening_probe", f"""with {DENSE}, p as (select dense.*, label = 3 as ok, row_number() over (partition by query_id order by score desc, vec_id) as place from dense join embeddings using (vec_id)),
c as (select query_id, count(*) filter (ok and place <= 15) as a, count(*) filter (ok and place <= 30) as b, count(*) filter (ok and place <= 60) as c from p group by 1),
v as (select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from p where ok)
select query_id, vec_id, score, rank, case when a >= 5 then 15 when b >= 5 then 30 when c >= 5 then 60 else 0 end as probe from v join c using (query_id) where rank <= 5""")
def widening_probe(spark, d):
    """Five nearest that may be seen (label 3): among 15, 30 or 60 nearest of any label, else by a scan of what may be seen.

    The widest probe is taken once and cut by place; only queries that it leaves short are scanned again.
    """
    v = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    asks, ok = v.where("vec_id % 50 = 0"), v.where("label = 3")
    near = stored(retrieval.nearest(asks, v, 60).join(ok.select("vec_id"), "vec_id"), "probe")
    counts = near.groupBy("query_id").agg(*(F.count_if(F.col("rank") <= n).alias(f"in{n}") for n in (15, 30, 60)))
    probe = F.coalesce(*(F.when(F.col(f"in{n}") >= 5, n) for n in (15, 30, 60)), F.lit(0))
    counts = stored(asks.select(F.col("vec_id").alias("query_id")).join(counts, "query_id", "left").select("query_id", probe.alias("probe")), "probe-widths")
    short = stored(asks.join(counts.where("probe = 0").select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi"), "probe-short")
    kept = near.join(counts.where("probe > 0"), "query_id", "left_semi").unionByName(retrieval.nearest(short, ok, 20))
    kept = kept.select("query_id", "vec_id", F.round("score", 6).alias("score"))
    return retrieval.top(kept, 5, [F.col("score").desc(), F.col("vec_id")]).join(counts, "query_id").select("query_id", "vec_id", "score", "rank", "probe")


# The store.

ARRIVED, CUT = "o_orderdate >= timestamp '1997-01-01'", "1997-01-01"
EXACT, COORDINATE, SUBJECT = ("o_custkey", "o_orderpriority", "o_orderstatus"), ("o_custkey", "o_orderpriority"), ("o_custkey",)
EXISTS = "exists (select 1 from orders p where p.o_orderdate < timestamp '1997-01-01' and {})"


@query("t08_store_branches", "with n as (select * from orders where " + ARRIVED + ") select o_orderkey, case when "
       + EXISTS.format("p.o_custkey = n.o_custkey and p.o_orderpriority = n.o_orderpriority and p.o_orderstatus = n.o_orderstatus") + " then 'exact' when n.o_orderpriority in ('1-URGENT', '2-HIGH') and "
       + EXISTS.format("p.o_custkey = n.o_custkey and p.o_orderpriority = n.o_orderpriority") + " then 'conflict' when "
       + EXISTS.format("p.o_custkey = n.o_custkey and p.o_orderpriority = n.o_orderpriority") + " then 'temporal' when "
       + EXISTS.format("p.o_custkey = n.o_custkey and floor(ln(1 + p.o_totalprice) * 20) = floor(ln(1 + n.o_totalprice) * 20)") + " then 'semantic' else 'insert' end as branch from n")
def store_branches(spark, d):
    """What becomes of each arriving row, the first that holds: the same fact is stored, its exclusive slot is held by
    another value, its slot has an earlier state, the subject has a like value, or it is new.

    Every test is an equality join with the different keys of what is stored, so a hot subject costs a row.
    """
    price = F.floor(F.log(1 + F.col("o_totalprice")) * 20).alias("band")
    orders = table(spark, d, "orders").select("o_orderkey", *EXACT, "o_orderdate", price)
    new, old = orders.where(ARRIVED), orders.where(F.col("o_orderdate") < F.lit(CUT).cast("timestamp"))
    for flag, keys in (("exact", EXACT), ("held", COORDINATE), ("like", (*SUBJECT, "band"))):
        new = new.join(old.select(*keys).distinct().withColumn(flag, F.lit(True)), list(keys), "left")
    exclusive = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    branch = F.when(F.col("exact"), "exact").when(F.col("held") & exclusive, "conflict").when(F.col("held"), "temporal").when(F.col("like"), "semantic").otherwise("insert")
    return new.select("o_orderkey", branch.alias("branch"))


@query("n02_pair_decisions", H + """, p as (select o_orderkey, o_orderstatus, o_orderpriority, lag(o_orderkey) over w as before, lag(o_orderstatus) over w as s, lag(o_orderpriority) over w as q from h window w as (partition by o_custkey order by version))
select before as left_id, o_orderkey as right_id, case when o_orderstatus = s and o_orderpriority = q then 'equivalent' when o_orderstatus <> s and o_orderpriority = q and q in ('1-URGENT', '2-HIGH') then 'distinct' else 'gray' end as decision from p where before is not null""")
def pair_decisions(spark, d):
    """Neighbouring versions: one slot and value are equivalent, other values of one exclusive slot are distinct, the rest is gray."""
    w = Window.partitionBy("o_custkey").orderBy("version")
    rows = history(spark, d).select("o_orderkey", "o_orderstatus", "o_orderpriority", F.lag("o_orderkey").over(w).alias("left_id"), F.lag("o_orderstatus").over(w).alias("s"), F.lag("o_orderpriority").over(w).alias("q"))
    slot, value = F.col("o_orderpriority") == F.col("q"), F.col("o_orderstatus") == F.col("s")
    decision = F.when(slot & value, "equivalent").when(slot & F.col("q").isin("1-URGENT", "2-HIGH"), "distinct").otherwise("gray")
    return rows.where("left_id is not null").select("left_id", F.col("o_orderkey").alias("right_id"), decision.alias("decision"))


@query("o15_active_exclusivity", "select o_custkey, o_orderpriority, count(*) as active, max_by(o_orderkey, (o_orderdate, o_orderkey)) as stays from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus = 'O' group by 1, 2 having count(*) > 1")
def active_exclusivity(spark, d):
    """Exclusive slots with several active rows, and the latest of them, which would stay; a sound store has none."""
    rows = table(spark, d, "orders").where("o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus = 'O'")
    return rows.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("active"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("stays")).where("active > 1")


COUNTS = "count(*) filter (event_type in ('purchase', 'signup')) as helpful, count(*) filter (event_type = 'error') as unhelpful, count(*) filter (event_type = 'purchase' and value >= 100) as success, count(*) filter (event_type = 'purchase') as outcomes"


@query("q02_usefulness_upsert", f"with t as (select user_id, {COUNTS} from events group by 1) select user_id, helpful, unhelpful, success, outcomes, round({SCORE}, 6) as score from t")
def usefulness_upsert(spark, d):
    """Stored totals of the first half of the month, with the second half's sums put in; scores are computed again."""
    e = table(spark, d, "events")
    bought = F.col("event_type") == "purchase"
    sums = {"helpful": F.col("event_type").isin("purchase", "signup"), "unhelpful": F.col("event_type") == "error", "success": bought & (F.col("value") >= 100), "outcomes": bought}
    cut = F.lit("2024-01-16").cast("timestamp")
    total = lambda rows: rows.groupBy("user_id").agg(*(F.count_if(c).alias(k) for k, c in sums.items()))
    held = stored(total(e.where(F.col("ts") < cut)), "usefulness-totals")
    both = held.unionByName(total(e.where(F.col("ts").isNull() | (F.col("ts") >= cut))))
    both = both.groupBy("user_id").agg(*(F.sum(k).alias(k) for k in sums))
    return both.withColumn("score", F.round(lifecycle.usefulness(*map(F.col, sums)), 6))


# Comparisons of rankings.


@query("y16_label_scores", GOLD_ALL + ", s as (select query_id, want, count(*) filter (want = got) as hits, coalesce(max(case when want = got then 1.0 / rank end), 0) as rr from g group by all) select want as category, count(*) as queries, round(avg(case when hits > 0 then 1.0 else 0 end), 6) as hit_rate, round(avg(hits / 10.0), 6) as precision, round(avg(rr), 6) as mrr from s group by 1")
def label_scores(spark, d):
    """Hit rate, precision and reciprocal rank by the category of the question; every vector is a question."""
    each = judged(spark, d, 1).groupBy("query_id", "want").agg(F.count_if("relevant").alias("hits"), F.coalesce(F.max(F.when(F.col("relevant"), 1.0 / F.col("rank"))), F.lit(0.0)).alias("rr"))
    return each.groupBy(F.col("want").alias("category")).agg(F.count("*").alias("queries"), F.round(F.avg((F.col("hits") > 0).cast("double")), 6).alias("hit_rate"), F.round(F.avg(F.col("hits") / 10.0), 6).alias("precision"), F.round(F.avg("rr"), 6).alias("mrr"))


NATURAL = INDEX.replace(f"{TERMS.format('text')} as words from documents", f"{TERMS.format(chr(39) * 2 + ' || source || ' + repr(': ') + ' || text')} as words from documents")


@query("y14_index_text_modes", f"with a as ({INDEX}{TOP10}), b as ({NATURAL}{TOP10}), ra as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as plain from a), rb as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as natural from b) select query_id, doc_id, plain, \"natural\", plain - \"natural\" as moved from ra full join rb using (query_id, doc_id)".replace("as natural", 'as "natural"'))
def index_text_modes(spark, d):
    """Places in the first ten when documents are indexed by their text, and by their source and text."""
    docs = table(spark, d, "documents")
    modes = {"plain": F.col("text"), "natural": F.concat("source", F.lit(": "), "text")}
    ranked = [retrieval.top(retrieval.bm25(docs, "doc_id", text, asked(spark, d)).withColumn("score", F.round("score", 6)), 10, best()).select("query_id", "doc_id", F.col("rank").alias(mode)) for mode, text in modes.items()]
    return ranked[0].join(ranked[1], ["query_id", "doc_id"], "full").withColumn("moved", F.col("plain") - F.col("natural"))


GRID = (0.5, 0.8, 1.0, 1.25, 2.0)


@query("y07_weight_grid", SCORED + f""", grid as (select unnest({list(GRID)})::double as factor), s as (select factor, query_id, doc_id, round(factor * 0.65 * semantic + 0.08 * recency + 0.07 * access + 0.075 * confidence + 0.075 * 0.5 + 0.05 * (1 - toxic), 6) as score from feat, grid),
r as (select *, row_number() over (partition by factor, query_id order by score desc, doc_id) as place from s), b as (select query_id, doc_id, place as base from r where factor = 1.0)
select factor, count(*) filter (place <= 5 and base <= 5) as kept, count(*) filter (place = 1 and base = 1) as same_first, sum(abs(place - base))::bigint as moved from r join b using (query_id, doc_id) group by 1""")
def weight_grid(spark, d):
    """Frozen candidates ranked again under other weights of the semantic feature, against the ranking as it is."""
    rows = stored(scored(spark, d), "traces").withColumn("factor", F.explode(F.array(*map(F.lit, GRID))))
    score = F.round(fusion.pre_score() + (F.col("factor") - 1) * fusion.WEIGHTS["semantic"] * F.col("semantic"), 6)
    place = F.row_number().over(Window.partitionBy("factor", "query_id").orderBy(F.col("score").desc(), "doc_id"))
    placed = rows.withColumn("score", score).withColumn("place", place).select("factor", "query_id", "doc_id", "place")
    base = F.max(F.when(F.col("factor") == 1.0, F.col("place"))).over(Window.partitionBy("query_id", "doc_id"))
    top = lambda n: F.count_if((F.col("place") <= n) & (F.col("base") <= n))
    return placed.withColumn("base", base).groupBy("factor").agg(top(5).alias("kept"), top(1).alias("same_first"), F.sum(F.abs(F.col("place") - F.col("base"))).alias("moved"))


@query("i11_index_refresh", INDEX.replace("from documents)", "from documents where source is not null)", 1) + "select term, count(*) as docs, sum(tf)::bigint as occurrences from post group by 1")
def index_refresh(spark, d):
    """The index after some documents are taken out and read again: old postings without them, and their new ones."""
    held = index(spark, d)
    dirty = table(spark, d, "documents").where("doc_id % 7 = 0")
    kept = held.join(dirty.select("doc_id"), "doc_id", "left_anti")
    again = retrieval.postings(dirty.where("source is not null"), "doc_id", F.col("text"))
    gone = table(spark, d, "documents").where("source is null").select("doc_id")
    return kept.join(gone, "doc_id", "left_anti").unionByName(again).groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("occurrences"))


@query("y02_assistant_turns", INDEX.replace("as words from documents)", "as words from (select conv_id * 1000 + turn as doc_id, text from conversations where role = 'assistant'))") + "select query_id, doc_id // 1000 as conv_id, doc_id % 1000 as turn, score from (select *, row_number() over (partition by query_id order by score desc, doc_id) as r from bm25) where r = 1")
def assistant_turns(spark, d):
    """The one turn of the assistant that shares most with a question, any of its words."""
    turns = table(spark, d, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    found = retrieval.bm25(turns, "doc_id", F.col("text"), asked(spark, d)).withColumn("score", F.round("score", 6))
    return retrieval.top(found, 1, best()).select("query_id", F.floor(F.col("doc_id") / 1000).alias("conv_id"), (F.col("doc_id") % 1000).alias("turn"), "score")


# Clocks and checks.

USED = "u as (select user_id, count(*) as uses, avg(value) / 300 as base, (epoch(timestamp '2024-02-01') - epoch(max(ts))) / 86400.0 as days from events group by 1)"


def used(spark, d):
    days = (F.unix_micros(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_micros(F.max("ts").cast("timestamp"))) / 86400e6
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("uses"), (F.avg("value") / 300).alias("base"), days.alias("days"))


@query("h15_access_frequency", f"with {USED} select user_id, round(ln(1 + uses) / ln(1 + max(uses) over ()), 6) as frequency from u")
def access_frequency(spark, d):
    """The most used counts as 1; the maximum is a row of its own and not a window over all."""
    rows = used(spark, d)
    return rows.crossJoin(F.broadcast(rows.agg(F.max("uses").alias("most")))).select("user_id", F.round(F.log1p("uses") / F.log1p("most"), 6).alias("frequency"))


@query("h16_activation", f"with {USED} select user_id, round(least(1, greatest(0, base)) * pow(2, -greatest(0, days) / 30), 6) as activation from u")
def activation(spark, d):
    base, days = F.least(F.lit(1.0), F.greatest(F.lit(0.0), "base")), F.greatest(F.lit(0.0), "days")
    return used(spark, d).select("user_id", F.round(base * F.pow(F.lit(2.0), -days / 30), 6).alias("activation"))


@query("h17_half_life_recency", f"with {USED} select user_id, round(pow(0.5, greatest(0, days) / 14), 6) as recency from u")
def half_life_recency(spark, d):
    return used(spark, d).select("user_id", F.round(F.pow(F.lit(0.5), F.greatest(F.lit(0.0), "days") / 14), 6).alias("recency"))


@query("h21_month_shift", "select o_orderkey, cast(cast(o_orderdate as date) + interval 1 month as date) as next, cast(cast(o_orderdate as date) - interval 3 month as date) as before from orders")
def month_shift(spark, d):
    """Months on and back; a day that a month lacks becomes its last."""
    return table(spark, d, "orders").select("o_orderkey", F.add_months("o_orderdate", 1).alias("next"), F.add_months("o_orderdate", -3).alias("before"))


CHECKS = (("orders", "o_orderkey"), ("customer", "c_custkey"), ("documents", "doc_id"), ("embeddings", "vec_id"), ("events", "event_id"))
REFERS = (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("labels", "doc_id", "documents", "doc_id"))


@query("r07_doctor", " union all ".join(
    [f"select 'null {t}.{k}' as finding, count(*) filter ({k} is null) as n from {t} union all select 'repeated {t}.{k}', count(*) from (select {k} from {t} where {k} is not null group by 1 having count(*) > 1)" for t, k in CHECKS]
    + [f"select 'dangling {t}.{k}', count(*) from {t} where {k} is not null and {k} not in (select {r} from {u} where {r} is not null)" for t, k, u, r in REFERS]))
def doctor(spark, d):
    """Read-only checks: keys that are null or repeated, and references that lead nowhere."""
    found = []
    say = lambda rows, text: rows.select(F.lit(text).alias("finding"), "n")
    for t, k in CHECKS:
        rows = table(spark, d, t)
        found += [say(rows.agg(F.count_if(F.col(k).isNull()).alias("n")), f"null {t}.{k}"), say(rows.where(F.col(k).isNotNull()).groupBy(k).count().where("count > 1").agg(F.count("*").alias("n")), f"repeated {t}.{k}")]
    for t, k, u, r in REFERS:
        held = table(spark, d, u).select(F.col(r).alias(k))
        found.append(say(table(spark, d, t).where(F.col(k).isNotNull()).join(held, k, "left_anti").agg(F.count("*").alias("n")), f"dangling {t}.{k}"))
    out = found[0]
    for each in found[1:]:
        out = out.unionByName(each)
    return out
