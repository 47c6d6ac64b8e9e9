"""Recall from end to end: what may be seen, channels, fusion, reranking, relations, echoes, the gate and the budget."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import temporal as T
from tessera.operators import fusion, retrieval
from tessera.plans.registry import query
from tessera.plans.retrieval import INDEX, asked, bm25, needed
from tessera.sources.scratch import stored
from tessera.sources.tables import table

#: When the questions are asked, and what of the record they may know.
AS_OF, KNOWN = "2024-06-01", "2024-05-20"
BUDGET, SEEDS, ATTENUATION, ECHO_DAYS = 3000, 10, 0.4, 15


def facts(spark, d):
    """Documents as facts with valid and recorded times, some closed, archived or expiring."""
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", day(i % 200).alias("valid_from"))
    return rows.withColumns({
        "valid_to": F.when(i % 4 == 0, F.date_add("valid_from", 60)),
        "status": F.when(i % 13 == 0, "archived").when(i % 4 == 0, "superseded").otherwise("active"),
        "recorded_from": F.date_add("valid_from", (i % 9).cast("int")),
        "recorded_to": F.lit(None).cast("date"),
        "expires_at": F.when(i % 7 == 0, F.date_add("valid_from", 150)),
    })


SQL = INDEX + f""", fact as (select doc_id, lang, source, n_chars, date '2024-01-01' + (doc_id % 200)::int as vf, case when doc_id % 13 = 0 then 'archived' when doc_id % 4 = 0 then 'superseded' else 'active' end as status from documents),
timed as (select *, case when doc_id % 4 = 0 then vf + 60 end as vt, vf + (doc_id % 9)::int as rf, case when doc_id % 7 = 0 then vf + 150 end as ex from fact),
seen as (select * from timed where vf <= date '{AS_OF}' and (vt is null or vt > date '{AS_OF}') and rf <= date '{KNOWN}' and status <> 'archived' and (status = 'active' or vt is not null) and (ex is null or ex > date '{AS_OF}')),
lex as (select query_id, doc_id, hits, row_number() over (partition by query_id order by score desc, doc_id) as rank from bm25 join seen using (doc_id)),
lng as (select item_id as query_id, case item_id % 4 when 0 then 'en' when 1 then 'de' when 2 then 'fr' else 'es' end as lang from benchmark),
sec as (select query_id, doc_id, rank from lng join (select *, row_number() over (partition by lang order by n_chars desc, doc_id) as rank from seen) using (lang) where rank <= 50),
ch as (select query_id, 'lexical' as channel, doc_id, rank, 1.0::double as weight from lex where rank <= 50 union all select query_id, 'language', doc_id, rank, 0.6::double from sec),
fused as (select query_id, doc_id, round(sum(weight / (60 + rank)), 8) as rrf, count(distinct channel) as channels from ch group by all),
top20 as (select * from (select *, row_number() over (partition by query_id order by rrf desc, doc_id) as r from fused) where r <= 20),
need as (select query_id, count(*) as k from asked group by 1),
feat as (select t.query_id, t.doc_id, coalesce(l.hits, 0) / coalesce(k, 1)::double as rerank, 1.0 / (1.0 + greatest(0, date '{AS_OF}' - s.vf) / 30.0) as recency, coalesce(b.quality, 0.5)::double as confidence,
  1 - coalesce(b.toxic, 0)::double as utility, ln(1 + n_chars) / ln(1 + max(n_chars) over (partition by t.query_id)) as access
  from top20 t join seen s using (doc_id) left join lex l using (query_id, doc_id) left join need n on n.query_id = t.query_id left join labels b using (doc_id)),
scored as (select *, round(0.8 * least(1, rerank) + 0.2 * (0.08 * recency + 0.07 * access + 0.075 * confidence + 0.075 * 0.5 + 0.05 * utility) / 0.35, 6) as score from feat),
seeds as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as r from scored) where r <= {SEEDS}),
hops as (select query_id, doc_id + 1 as doc_id, max(round(score * {ATTENUATION}, 6)) as score from seeds where doc_id % 3 = 0 group by 1, 2),
every as (select query_id, doc_id, score, 'reranked' as path from seeds where rerank >= 0.45
  union all select h.query_id, h.doc_id, h.score, 'related' from hops h join seen using (doc_id) where h.score >= 0.2 and not exists (select 1 from seeds s where s.query_id = h.query_id and s.doc_id = h.doc_id)),
fresh as (select e.*, greatest(1, (n_chars + 1) // 2) as tokens from every e join seen using (doc_id) where coalesce(source, '') <> 'src' || query_id % 20 or rf <= date '{KNOWN}' - {ECHO_DAYS}),
it as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from fresh) where rank <= {SEEDS}),
fold as (select query_id, rank, case when tokens <= {BUDGET} then tokens else 0 end as used, tokens <= {BUDGET} as packed from it where rank = 1
  union all select f.query_id, i.rank, case when f.used + i.tokens <= {BUDGET} then f.used + i.tokens else f.used end, f.used + i.tokens <= {BUDGET} from fold f join it i on i.query_id = f.query_id and i.rank = f.rank + 1)
select query_id, rank, doc_id, path, score, packed from it join fold using (query_id, rank)"""


@query("k03_recall_whole", SQL.replace("with w as", "with recursive w as", 1))
def recall(spark, d):
    """Each item's ten best facts in force and known, with related ones, and which of them fit the budget.

    Only facts that may be seen are ranked. A relation leads from every third fact to the next one; what it reaches counts
    two fifths of the fact it was reached from. Facts of the asker's own session that were recorded in the last days are echoes.
    """
    as_of, known = F.lit(AS_OF).cast("date"), F.lit(KNOWN).cast("date")
    seen = stored(facts(spark, d).where(T.visible(as_of, known)), "recall-seen")
    lexical = stored(bm25(spark, d).join(seen.select("doc_id"), "doc_id", "left_semi"), "recall-lexical")
    best = [F.col("score").desc(), F.col("doc_id")]
    first = retrieval.top(lexical, 50, best).select("query_id", F.lit("lexical").alias("channel"), "doc_id", "rank", F.lit(1.0).alias("weight"))
    lang = F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (F.col("item_id") % 4 + 1).cast("int"))
    longest = retrieval.top(seen.select("doc_id", "lang", "n_chars"), 50, [F.col("n_chars").desc(), F.col("doc_id")], ("lang",))
    second = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), lang.alias("lang")).join(longest, "lang").select("query_id", F.lit("language").alias("channel"), "doc_id", "rank", F.lit(0.6).alias("weight"))
    found = fusion.rrf(first.unionByName(second)).withColumn("rrf", F.round("rrf", 8))
    found = retrieval.top(found, 20, [F.col("rrf").desc(), F.col("doc_id")]).drop("rank")

    rows = found.join(seen, "doc_id").join(lexical.select("query_id", "doc_id", "hits"), ["query_id", "doc_id"], "left").join(needed(spark, d), "query_id", "left")
    rows = rows.join(table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    rerank = F.coalesce("hits", F.lit(0)) / F.coalesce("k", F.lit(1)).cast("double")
    most = F.max("n_chars").over(Window.partitionBy("query_id"))
    rows = rows.withColumns({"rerank": rerank, "semantic": F.lit(0.0), "recency": T.recency(F.date_diff(as_of, "valid_from")), "confidence": F.coalesce(F.col("quality").cast("double"), F.lit(0.5)), "utility": 1 - F.coalesce(F.col("toxic").cast("double"), F.lit(0.0)), "importance": F.lit(0.5), "access": F.log(1 + F.col("n_chars")) / F.log(1 + most)})
    rows = rows.withColumn("score", F.round(fusion.blend(F.col("rerank"), {k: F.col(k) for k in fusion.WEIGHTS}), 6))
    seeds = stored(retrieval.top(rows, SEEDS, best).select("query_id", "doc_id", "score", "rerank", "channels"), "recall-seeds")

    hops = seeds.where("doc_id % 3 = 0").groupBy("query_id", (F.col("doc_id") + 1).alias("doc_id")).agg(F.max(F.round(F.col("score") * ATTENUATION, 6)).alias("score"))
    hops = hops.where("score >= 0.2").join(seeds.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    verdict = fusion.relevance(F.col("rerank") > 0, F.col("rerank"), F.col("channels"), 0.5)
    every = seeds.where(verdict != "irrelevant").select("query_id", "doc_id", "score", F.lit("reranked").alias("path")).unionByName(hops.withColumn("path", F.lit("related")))
    own = F.coalesce("source", F.lit("")) == F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string"))
    fresh = every.join(seen.select("doc_id", "source", "n_chars", "recorded_from"), "doc_id").where(~own | (F.col("recorded_from") <= F.date_sub(known, ECHO_DAYS)))
    ranked = stored(retrieval.top(fresh.withColumn("tokens", F.greatest(F.lit(1), F.floor((F.col("n_chars") + 1) / 2))), SEEDS, best), "recall-ranked")
    packed = fusion.pack(ranked, BUDGET).select("query_id", "taken")
    return ranked.join(packed, "query_id").select("query_id", "rank", "doc_id", "path", "score", F.array_contains("taken", F.col("doc_id")).alias("packed"))
