"""Facts written, corrected and back-filled under a version log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.sources.fact_store import FactStore, value_text
from tessera.sources.scratch import shared_dir
from tessera.sources.tables import table

#: Ids of facts that replace others.
NEW = 10_000_000_000


def facts(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("subject"), F.col("lang").alias("predicate"), F.col("text").alias("value"), F.lit(0).cast("long").alias("valid_from"))


def filled(spark, d):
    store = FactStore(spark, f"{shared_dir(spark)}/facts-{uuid.uuid4().hex}")
    store.insert(facts(spark, d))
    return store


def corrected(spark, d):
    """Corrections of every twentieth fact, half of them by someone who saw another text, and of some that never were."""
    store = filled(spark, d)
    known = store.read().select("id", F.when(F.col("id") % 40 == 0, F.col("fact_hash")).otherwise(F.lit("stale")).alias("expected_hash")).where("id % 20 = 0")
    known = known.unionByName(known.where("id % 100 = 0").select((-F.col("id") - 1).alias("id"), "expected_hash"))
    asked = known.withColumns({"value": F.concat(F.lit("corrected "), F.col("id").cast("string")), "at": F.lit(7).cast("long"), "new_id": F.col("id") + NEW})
    return store, asked, store.correct(asked)


CORRECTED = f"""with c as (select doc_id as id from documents where doc_id % 20 = 0), f as (
select doc_id as id, source as subject, lang as predicate, text as value, case when doc_id % 40 = 0 then 'superseded' else 'active' end as status from documents
union all select id + {NEW}, source, lang, 'corrected ' || id, 'active' from c join documents on doc_id = id where id % 40 = 0)
"""


@query("a06_fact_insert", "select doc_id as id, sha256(concat_ws(' ', source, lang, text)) as index_sha, 'active' as status from documents")
def fact_insert(spark, d):
    """Facts are written with their projections; writing them again changes none."""
    store = filled(spark, d)
    store.insert(facts(spark, d).withColumn("value", F.lit("other")))
    return store.read().select("id", F.sha2("index_text", 256).alias("index_sha"), "status")


@query("m15_correction", CORRECTED + "select id, case when id % 40 = 0 then 'applied' else 'changed' end as outcome from c union all select -id - 1, 'missing' from c where id % 100 = 0")
def correction(spark, d):
    return corrected(spark, d)[2]


@query("m15_corrected_facts", CORRECTED + "select status, subject, count(*) as n, count(*) filter (value like 'corrected %') as fixed from f group by 1, 2")
def corrected_facts(spark, d):
    """The state after corrections that were sent twice."""
    store, asked, _ = corrected(spark, d)
    store.correct(asked)
    return store.read().groupBy("status", "subject").agg(F.count("*").alias("n"), F.count_if(F.col("value").startswith("corrected ")).alias("fixed"))


@query("p15_backfill", "select doc_id as id, sha256(coalesce(text, '')) as index_sha from documents")
def backfill(spark, d):
    """The projection in another form, thousands of facts at a time, each batch from where the last version ended."""
    store, rows = filled(spark, d), table(spark, d, "documents").count()
    size = max(1000, rows // 3)
    while True:
        store.backfill(size, value_text)
        if store.manifest()["cursor"] is None:
            return store.read().select("id", F.sha2("index_text", 256).alias("index_sha"))
