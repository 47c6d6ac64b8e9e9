"""Quotes in their sources, folding of results, duplicates at writing, and pairs of like vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.evidence import quoted_in
from tessera.functions.vector import cosine
from tessera.operators import dedup as D
from tessera.operators import retrieval
from tessera.plans.registry import query
from tessera.plans.retrieval import COS, fused
from tessera.sources.pair_backlog import PairBacklog
from tessera.sources.scratch import shared_dir, stored
from tessera.sources.tables import table


@query("h32_evidence_quotes")
def evidence_quotes(spark, d):
    """Of each turn a quote from its middle, as it is or changed more and more: is it in the turn?"""
    part = F.substring("text", (F.length("text") / 4 + 1).cast("int"), (F.length("text") / 2).cast("int"))
    kind = (F.col("conv_id") + F.col("turn")) % 5
    quote = F.when(kind == 0, F.upper(F.regexp_replace(part, "[,. ]", " "))).when(kind == 1, F.regexp_replace(part, "(.{11}).", "$1q"))
    quote = quote.when(kind == 2, F.regexp_replace(part, "(.).", "$1q")).when(kind == 3, F.concat(part, F.lit(" 8080"))).otherwise(F.reverse(part))
    rows = table(spark, d, "conversations").select("conv_id", "turn", kind.alias("kind"), quote.alias("quote"), "text")
    return rows.select("conv_id", "turn", "kind", quoted_in("quote", "text").alias("held"))


@query("k11_fold_near")
def fold_near(spark, d):
    """Near copies among a query's results fold into the first of them; equal texts are confirmed pairs."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    keep = F.min("doc_id").over(Window.partitionBy(F.sha2("text", 256)))
    rows = stored(fused(spark, d).select("query_id", "rank", "doc_id").join(docs, "doc_id"), "fold-rows")
    shown = rows.select("doc_id", "text").distinct().where("text is not null").withColumn("left_id", keep)
    pairs = shown.where("left_id <> doc_id").select("left_id", F.col("doc_id").alias("right_id"))
    return D.fold_near(rows, pairs).withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), ","))


@query("n04_write_search")
def write_search(spark, d):
    """Every fiftieth vector with its text is written: what the others of its label make of it."""
    v = table(spark, d, "embeddings").join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("value")), "vec_id", "left")
    v = stored(v.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("key"), "value", "embedding"), "write-search")
    new, held = v.where("id % 50 = 0"), v.where("id % 50 <> 0")
    pairs = D.similar_pairs(v, "key", 0.4, 2.0, "id")
    sides = pairs.select(F.col("left_id").alias("new_id"), F.col("right_id").alias("id"), "score").unionByName(pairs.select(F.col("right_id").alias("new_id"), F.col("left_id").alias("id"), "score"))
    nearest = sides.where("new_id % 50 = 0 and id % 50 <> 0")
    return D.write_search(new, held, F.round(cosine(F.col("n.embedding"), F.col("h.embedding")), 6), nearest, 0.4)


@query("c16_similarity_band", f"""with p as (select a.vec_id as left_id, b.vec_id as right_id, round({COS}, 6) as score from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id)
select left_id, right_id, score from p where score >= 0.3 and score < 0.45 and (left_id + right_id) % 7 <> 0""")
def similarity_band(spark, d):
    """Pairs of one label in a grey band of likeness that nobody has reviewed yet."""
    v = stored(table(spark, d, "embeddings").select("vec_id", "label", "embedding"), "band-vectors")
    pairs = stored(D.similar_pairs(v, "label", 0.3, 0.45), "band-pairs")
    reviewed = pairs.where("(left_id + right_id) % 7 = 0").select("left_id", "right_id")
    return pairs.join(reviewed, ["left_id", "right_id"], "left_anti")


@query("n07_cross_subject", f"""with v as (select *, vec_id % 20 as subject from (select *, row_number() over (partition by vec_id % 3 order by vec_id desc) as r from embeddings) where r <= 200)
select a.vec_id % 3 as namespace, a.vec_id as left_id, b.vec_id as right_id, round({COS}, 6) as score from v a join v b on a.vec_id % 3 = b.vec_id % 3 and a.label = b.label and a.vec_id < b.vec_id and a.subject <> b.subject where round({COS}, 6) >= 0.3""")
def cross_subject(spark, d):
    """Among the 200 latest of a namespace: pairs of one label, two subjects and like vectors."""
    v = table(spark, d, "embeddings").select("vec_id", "label", "embedding", (F.col("vec_id") % 3).alias("namespace"), (F.col("vec_id") % 20).alias("subject"))
    latest = retrieval.top(v, 200, [F.col("vec_id").desc()], ("namespace",)).drop("rank")
    a, b = latest.alias("a"), latest.alias("b")
    on = (F.col("a.namespace") == F.col("b.namespace")) & (F.col("a.label") == F.col("b.label")) & (F.col("a.vec_id") < F.col("b.vec_id")) & (F.col("a.subject") != F.col("b.subject"))
    pairs = a.join(b, on).select("a.namespace", F.col("a.vec_id").alias("left_id"), F.col("b.vec_id").alias("right_id"), F.round(cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("score"))
    return pairs.where("score >= 0.3")


@query("n14_safe_duplicates")
def safe_duplicates(spark, d):
    """Among a query's ten results, as facts of their source: pairs that are one fact beyond doubt.

    Such texts have the same atoms, which are taken once a result; pairs are dealt to all tasks, as results are few rows.
    """
    none = F.lit(None).cast("string")
    docs = table(spark, d, "documents").join(fused(spark, d).select("query_id", "rank", "doc_id"), "doc_id")
    facts = docs.select("query_id", "rank", "doc_id", F.col("lang").alias("namespace"), F.lit("user").alias("subject"), none.alias("predicate"), none.alias("slot"), none.alias("attribute"), F.create_map().cast("map<string,string>").alias("qualifiers"), none.alias("status"), (F.col("doc_id") % 7).alias("valid_from"), F.lit(None).cast("long").alias("valid_to"), F.array("lang").alias("entities"), F.col("text").alias("value"))
    facts = stored(facts.where("value is not null").withColumn("atoms", F.md5(D.near_copy_key("value")["atoms"])), "safe-facts")
    met = (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.atoms") == F.col("b.atoms")) & (F.col("a.rank") < F.col("b.rank"))
    pairs = facts.alias("a").join(facts.alias("b"), met).select(F.struct("a.*").alias("a"), F.struct("b.*").alias("b"))
    pairs = stored(pairs.repartition(4 * spark.sparkContext.defaultParallelism), "safe-pairs")
    return pairs.where(D.safe_near_duplicate(F.lit(1.0))).select("a.query_id", F.col("a.doc_id").alias("left_id"), F.col("b.doc_id").alias("right_id"))


BACKLOG = f"""with p as (select a.vec_id as left_id, b.vec_id as right_id, round({COS}, 6) as similarity from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id where round({COS}, 6) >= 0.3 and round({COS}, 6) < 2),
w as (select *, row_number() over (order by similarity desc, left_id, right_id) as r from p)
"""


def backlog(spark, d):
    """Pairs of one label wait, up to 10,000; no vectors of these tables are as alike as 0.88, so the floor is 0.3."""
    waiting = PairBacklog(spark, f"{shared_dir(spark)}/pairs-{uuid.uuid4().hex}")
    pairs = stored(D.similar_pairs(table(spark, d, "embeddings"), "label", 0.3, 2.0).withColumnRenamed("score", "similarity"), "backlog-pairs")
    waiting.add(pairs, floor=0.3)
    waiting.add(pairs, floor=0.3)
    return waiting


@query("n10_drained_pairs", BACKLOG + "select left_id, right_id, case when similarity < 0.35 then 'dismissed_below_floor' end as decision from w where r <= 10000")
def drained_pairs(spark, d):
    """What is below 0.35 is dismissed as the set that was counted."""
    waiting = backlog(spark, d)
    waiting.drain(0.35, waiting.inspect(0.35)["candidates"])
    return waiting.read().select("left_id", "right_id", "decision")


@query("n09_pairs_in_turn", BACKLOG + "select left_id, right_id, similarity, row_number() over (order by (left_id < 250)::int, left_id, right_id) as rank from w where r <= 10000 qualify rank <= 20")
def pairs_in_turn(spark, d):
    return backlog(spark, d).next_in_turn(20, (249, 10**12))
