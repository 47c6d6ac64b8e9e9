"""More search, keys, clocks, packets and evaluation, over conversations, documents, vectors and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.rules import extracted
from tessera.functions import text as X
from tessera.operators import calibration, fusion, retrieval
from tessera.plans.facts import H, NOW, at, history
from tessera.plans.registry import query
from tessera.plans.retrieval import DENSE, GOLD, INDEX, asked, dense, judged
from tessera.sources.tables import table

TOP10 = "select query_id, doc_id, score from (select *, row_number() over (partition by query_id order by score desc, doc_id) as r from bm25) where r <= 10"


def _top10(spark, d, docs):
    found = retrieval.bm25(docs, "doc_id", F.col("text"), asked(spark, d)).withColumn("score", F.round("score", 6))
    return retrieval.top(found, 10, [F.col("score").desc(), F.col("doc_id")]).select("query_id", "doc_id", "score")


@query("i07_event_search", INDEX.replace("as words from documents)", "as words from (select conv_id * 1000 + turn as doc_id, text from conversations))") + TOP10)
def event_search(spark, d):
    """The same search over the turns of conversations."""
    return _top10(spark, d, table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text"))


@query("i08_cold_search", INDEX.replace("as words from documents)", "as words from documents where doc_id in (select doc_id from labels where quality = 0))") + TOP10)
def cold_search(spark, d):
    """Only what was put aside (here: labelled as low quality) is searched, with its own statistics; ties go to the id."""
    cold = table(spark, d, "labels").where("quality = 0").select("doc_id").distinct()
    return _top10(spark, d, table(spark, d, "documents").select("doc_id", "text").join(cold, "doc_id", "left_semi"))


@query("i04_documents", r"select conv_id, turn, array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> ''), ' ') as document from conversations where text is not null")
def documents(spark, d):
    return table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.array_join(X.terms(F.col("text")), " ").alias("document"))


@query("i12_event_text", "select event_id, json_extract_string(props, '$.k') as text from events where json_extract_string(props, '$.k') is not null")
def event_text(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("text")).where("text is not null")


@query("f03_visible_topk", f"with {DENSE}, q as (select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from dense join (select vec_id from embeddings where label < 5) v using (vec_id)) select query_id, vec_id, score, rank from q where rank <= 10")
def visible_topk(spark, d):
    """The nearest that may be seen (labels under 5): the filter comes before the ranks, so ten are found if there are ten."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    found = retrieval.nearest(v.where("vec_id % 50 = 0"), v.where("label < 5"), 40).withColumn("score", F.round("score", 6))
    return retrieval.top(found.drop("rank"), 10, [F.col("score").desc(), F.col("vec_id")]).select("query_id", "vec_id", "score", "rank")


@query("j04_unit_vectors", "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 5) as norm, round(list_max(list_transform(embedding, lambda x: abs(x::double))) / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 5) as most from embeddings")
def unit_vectors(spark, d):
    x = F.transform("embedding", lambda e: e.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, e: s + e * e))
    return table(spark, d, "embeddings").select("vec_id", F.round(norm, 5).alias("norm"), F.round(F.array_max(F.transform(x, F.abs)) / norm, 5).alias("most"))


@query("j07_dirty_vectors", "select coalesce(doc_id, vec_id) as id, case when vec_id is null then 'insert' when doc_id is null then 'delete' else 'refresh' end as action from documents full join embeddings on doc_id = vec_id where vec_id is null or doc_id is null or n_chars < 200")
def dirty_vectors(spark, d):
    """What the vector table needs: rows without a vector, vectors without a row, and short texts embedded again."""
    docs, v = table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "embeddings").select("vec_id")
    rows = docs.join(v, F.col("doc_id") == F.col("vec_id"), "full").where("vec_id is null or doc_id is null or n_chars < 200")
    action = F.when(F.col("vec_id").isNull(), "insert").when(F.col("doc_id").isNull(), "delete").otherwise("refresh")
    return rows.select(F.coalesce("doc_id", "vec_id").alias("id"), action.alias("action"))


# Keys, clocks and buckets.


@query("h03_isolated_ids", "select c_custkey, 'unknown__' || substr(sha256('[\"isolated\",' || c_custkey || ']'), 1, 16) as subject from customer")
def isolated_ids(spark, d):
    key = F.concat(F.lit('["isolated",'), F.col("c_custkey").cast("string"), F.lit("]"))
    return table(spark, d, "customer").select("c_custkey", F.concat(F.lit("unknown__"), F.substring(F.sha2(key, 256), 1, 16)).alias("subject"))


@query("h09_legacy_keys", "select sha256('v1|' || o_custkey || '|' || o_orderpriority) as legacy_key, count(*) as claims from orders group by 1")
def legacy_keys(spark, d):
    return table(spark, d, "orders").groupBy(F.sha2(F.concat_ws("|", F.lit("v1"), "o_custkey", "o_orderpriority"), 256).alias("legacy_key")).agg(F.count("*").alias("claims"))


@query("h11_case_keys", "select o_custkey, o_orderpriority, sha256('case|' || o_custkey || '|' || o_orderpriority || '|' || count(*)) as case_key, sha256(string_agg(o_orderkey::varchar, '|' order by o_orderkey)) as fingerprint from orders group by 1, 2")
def case_keys(spark, d):
    """A group's key changes with its generation; the fingerprint with its members."""
    rows = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("o_orderkey")), "|").alias("ids"))
    return rows.select("o_custkey", "o_orderpriority", F.sha2(F.concat_ws("|", F.lit("case"), "o_custkey", "o_orderpriority", "n"), 256).alias("case_key"), F.sha2("ids", 256).alias("fingerprint"))


@query("h18_utc_parse", "select event_id, case event_type when 'view' then null when 'click' then date_trunc('second', ts) - interval 2 hour else date_trunc('second', ts) end as at from events")
def utc_parse(spark, d):
    """Times as text: without an offset (here those of views) they are refused, with one they are turned to UTC."""
    zone = F.when(F.col("event_type") == "view", "").when(F.col("event_type") == "click", "+02:00").otherwise("Z")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone)
    parsed = F.to_utc_timestamp(F.try_to_timestamp(text), F.current_timezone()).cast("timestamp_ntz")
    return table(spark, d, "events").select("event_id", F.when(text.rlike(r"(Z|[+-]\d{2}:\d{2})$"), parsed).alias("at"))


@query("h19_second_utc", "select event_id, date_trunc('second', ts) as at from events")
def second_utc(spark, d):
    return table(spark, d, "events").select("event_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("at"))


@query("h23_buckets", H + f"select case when age < 1 then 'day' when age < 7 then 'week' when age < 30 then 'month' when age < 365 then 'year' else 'older' end as bucket, count(*) as n from (select date_diff('day', valid_from, timestamp '{NOW}') as age from h where valid_from <= timestamp '{NOW}') group by 1")
def buckets(spark, d):
    age = F.datediff(at().cast("date"), F.col("valid_from").cast("date"))
    bucket = F.when(age < 1, "day").when(age < 7, "week").when(age < 30, "month").when(age < 365, "year").otherwise("older")
    return history(spark, d).where(F.col("valid_from") <= at()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("f10_candidate_limits", "select item_id, least(500, greatest(5 * (length(text) // 20), 50)) as candidates from benchmark")
def candidate_limits(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.least(F.lit(500), F.greatest(5 * F.floor(F.length("text") / 20), F.lit(50))).cast("long").alias("candidates"))


# Packets.


@query("k18_context_packet", H.replace("with v as", "with recursive v as", 1) + """, it as (select o_custkey as query_id, o_orderkey as doc_id, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank, greatest(1, floor(o_totalprice / 1000)::bigint) as tokens from h where status <> 'expired'),
top as (select * from it where rank <= 10),
fold as (select query_id, rank, case when tokens <= 900 then tokens else 0 end as used, case when tokens <= 900 then doc_id::varchar else '' end as taken from top where rank = 1
  union all select f.query_id, i.rank, case when f.used + i.tokens <= 900 then f.used + i.tokens else f.used end, case when f.used + i.tokens <= 900 then concat_ws(',', nullif(f.taken, ''), i.doc_id) else f.taken end
  from fold f join top i on i.query_id = f.query_id and i.rank = f.rank + 1),
ends as (select query_id, arg_max(used, rank) as used, arg_max(taken, rank) as taken from fold group by 1)
select query_id, used, taken, sha256(taken) as receipt from ends""")
def context_packet(spark, d):
    """At most ten claims of a subject, within a budget of tokens, and a receipt that names what went in."""
    order = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    rows = history(spark, d).where("status <> 'expired'").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.row_number().over(order).cast("long").alias("rank"), F.greatest(F.lit(1), F.floor(F.col("o_totalprice") / 1000)).cast("long").alias("tokens"))
    taken = F.array_join("taken", ",")
    return fusion.pack(rows.where("rank <= 10"), 900).select("query_id", "used", taken.alias("taken"), F.sha2(taken, 256).alias("receipt"))


@query("t04_rule_extraction", r"select conv_id, turn, case when regexp_matches(text, '(?i)(?:^|[^\p{L}])(?:der|die|das)\s+([a-z]+)') then 'de' when regexp_matches(text, '(?i)(?:^|[^\p{L}])(?:the|this|that)\s+([a-z]+)') then 'en' when regexp_matches(text, '(?i)(?:^|[^\p{L}])(?:les|la|le)\s+([a-z]+)') then 'fr' end as rule, coalesce(nullif(regexp_extract(text, '(?i)(?:^|[^\p{L}])(?:der|die|das)\s+([a-z]+)', 1), ''), nullif(regexp_extract(text, '(?i)(?:^|[^\p{L}])(?:the|this|that)\s+([a-z]+)', 1), ''), nullif(regexp_extract(text, '(?i)(?:^|[^\p{L}])(?:les|la|le)\s+([a-z]+)', 1), '')) as value from conversations where text is not null")
def rule_extraction(spark, d):
    """Ordered patterns: the first that matches names the rule, the first that gives a value the value."""
    text = F.col("text")
    of = lambda words: r"(?i)(?:^|[^\p{L}])(?:" + words + r")\s+([a-z]+)"
    rules = [("de", "der|die|das"), ("en", "the|this|that"), ("fr", "les|la|le")]
    rule = F.coalesce(*(F.when(text.rlike(of(w)), n) for n, w in rules))
    value = F.coalesce(*(F.nullif(F.regexp_extract(text, of(w), 1), F.lit("")) for _, w in rules))
    return table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", rule.alias("rule"), value.alias("value"))


SAID = ("现在用", "我喜欢 ", "请记住", "他们使用 ", "", "现在使用", "无")
RULES = r"""with t as (select conv_id, turn, (['现在用', '我喜欢 ', '请记住', '他们使用 ', '', '现在使用', '无'])[turn % 7 + 1] || split_part(coalesce(text, ''), ' ', 1) || case when turn % 7 = 4 then ' 现在挂了' else '' end || '。' as text from conversations where turn is not null),
m as (select *, trim(regexp_extract(text, '现在(?:用|使用)\s*(.+?)(?:[。！!]|$)', 1)) as a, trim(regexp_extract(text, '我喜欢\s*(.+?)(?:[。！!]|$)', 1)) as b, trim(regexp_extract(text, '记住\s*(.+?)(?:[。！!]|$)', 1)) as c,
  trim(regexp_extract(text, '使用\s*(.+?)(?:[。！!]|$)', 1)) as d, trim(regexp_extract(text, '(.+?现在挂了)(?:[。！!]|$)', 1)) as e from t)
select conv_id, turn, case when a <> '' or b <> '' then 'preference' when c <> '' then 'explicit_memory' when d <> '' then 'uses' else 'service_status' end as predicate, coalesce(nullif(a, ''), nullif(b, ''), nullif(c, ''), nullif(d, ''), e) as value,
  case when a || b || c || d = '' then coalesce(nullif(trim(regexp_replace(e, '现在挂了$', '')), ''), 'unknown') end as service, a || b || c || d = '' or starts_with(text, '现在') as state_change
from m where a || b || c || d || e <> ''"""


@query("t04_rules", RULES)
def rules(spark, d):
    """Facts that messages state in words of the five rules."""
    start = F.element_at(F.array(*map(F.lit, SAID)), (F.col("turn") % 7 + 1).cast("int"))
    text = F.concat(start, F.split_part(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(1)), F.when(F.col("turn") % 7 == 4, " 现在挂了").otherwise(""), F.lit("。"))
    rows = table(spark, d, "conversations").where("turn is not null").select("conv_id", "turn", extracted(text).alias("f")).where("f is not null")
    return rows.select("conv_id", "turn", "f.predicate", "f.value", "f.service", "f.state_change")


@query("n11_pending_pairs", f"with {DENSE}, n as (select least(query_id, vec_id) as left_id, greatest(query_id, vec_id) as right_id, max(score) as score from dtop where score >= 0.3 group by 1, 2) select left_id, right_id, score from n order by score desc, left_id, right_id limit 50")
def pending_pairs(spark, d):
    """Pairs over the floor wait for review, each once; the backlog holds fifty, the nearest first."""
    pair = [F.least("query_id", "vec_id").alias("left_id"), F.greatest("query_id", "vec_id").alias("right_id")]
    rows = dense(spark, d).where("score >= 0.3").groupBy(*pair).agg(F.max("score").alias("score"))
    return rows.orderBy(F.col("score").desc(), "left_id", "right_id").limit(50)


# Evaluation.

_U = "(('0x' || substr(md5({} || '|' || b), 1, 8))::bigint / 4294967296.0::double)"
DRAWS = "(" + " + ".join(f"({_U} >= {p!r}::double)::int" for p in calibration.POISSON) + ")"
_BOOT = """, m as (select b, sum(total * w) / sum(n * w)::double as mean from (select *, {w} as w from x, (select unnest(range(1, {k} + 1)) as b)) group by b)
select round(max(mean) filter (r = {low}), 6) as low, round(max(mean) filter (r = {high}), 6) as high from (select *, row_number() over (order by mean, b) as r from m)"""


@query("v06_bootstrap", "with x as (select substr(md5(doc_id::varchar), 1, 3) as unit, sum(quality) as total, count(quality) as n from labels group by 1)" + _BOOT.format(w=DRAWS.replace("{}", "unit"), k=1000, low=26, high=975))
def bootstrap(spark, d):
    return calibration.bootstrap_mean(table(spark, d, "labels"), F.col("quality"), F.col("doc_id").cast("string"), 1000)


@query("v07_cluster_bootstrap", "with x as (select source as unit, sum(quality) as total, count(quality) as n from labels join documents using (doc_id) where source is not null group by 1)" + _BOOT.format(w=DRAWS.replace("{}", "unit"), k=2000, low=51, high=1950))
def cluster_bootstrap(spark, d):
    """All rows of a source are drawn together."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return calibration.bootstrap_mean(rows, F.col("quality"), F.col("source"), 2000, grouped=False)


U12 = r"""with recursive cells as (select round(least(1, n_chars / 5000.0), 2)::double as x, round(length(regexp_replace(text, '[^0-9*#$%&!]', '', 'g')) / greatest(n_chars, 1)::double, 2) as z, quality::double as y, count(*) as n
    from documents join labels using (doc_id) where quality is not null group by all),
total as (select sum(n) as total from cells),
g(step, b, wx, wz) as (select 0, 0.0::double, 0.0::double, 0.0::double
    union all select step + 1, b - 0.1 / total * sum(n * e), wx - 0.1 / total * sum(n * e * x), wz - 0.1 / total * sum(n * e * z)
    from (select g.*, x, z, n, total, 1 / (1 + exp(-greatest(-35, least(35, b + wx * x + wz * z)))) - y as e from g, cells, total where step < 1000) group by step, b, wx, wz, total)
select unnest(['intercept', 'x', 'z']) as name, round(unnest([b, wx, wz]), 6) as weight from g where step = 1000"""


@query("u12_calibration", U12)
def calibrated(spark, d):
    """A document's label by its length and its share of digits and marks: weights of a logistic model."""
    marks = F.length(F.regexp_replace("text", "[^0-9*#$%&!]", "")) / F.greatest("n_chars", F.lit(1))
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("quality", F.round(F.least(F.lit(1.0), F.col("n_chars") / 5000.0), 2).alias("x"), F.round(marks, 2).alias("z"))
    return calibration.fit_logistic(rows, ["x", "z"], "quality").select("name", F.round("weight", 6).alias("weight"))


@query("v08_hits", GOLD + " select count(distinct query_id) as queries, count(distinct case when want = got and rank = 1 then query_id end) as hit1, count(distinct case when want = got and rank <= 3 then query_id end) as hit3, round(count(*) filter (want = got and rank <= 3) / (3.0 * count(distinct query_id)), 6) as precision3 from g")
def hits(spark, d):
    found = lambda k: F.when(F.col("relevant") & (F.col("rank") <= k), F.col("query_id"))
    every = F.countDistinct("query_id")
    return judged(spark, d).agg(every.alias("queries"), F.countDistinct(found(1)).alias("hit1"), F.countDistinct(found(3)).alias("hit3"), F.round(F.count_if(F.col("relevant") & (F.col("rank") <= 3)) / (3.0 * every), 6).alias("precision3"))


@query("y12_projection_audit", "select 'text' as what, coalesce(lang, '?') as kind, count(*) as n, count(*) filter (length(coalesce(text, '')) <> n_chars) as stale from documents group by 1, 2 union all select 'vector', len(embedding)::varchar, count(*), count(*) filter (list_count(embedding) <> len(embedding)) from embeddings group by 1, 2")
def projection_audit(spark, d):
    """Derived columns against what they are derived from, and the vectors by width."""
    text = table(spark, d, "documents").groupBy(F.lit("text").alias("what"), F.coalesce("lang", F.lit("?")).alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.length(F.coalesce("text", F.lit(""))) != F.col("n_chars")).alias("stale"))
    holes = F.exists("embedding", lambda x: x.isNull())
    vector = table(spark, d, "embeddings").groupBy(F.lit("vector").alias("what"), F.size("embedding").cast("string").alias("kind")).agg(F.count("*").alias("n"), F.count_if(holes).alias("stale"))
    return text.unionByName(vector)
