"""The stored index through changes: synchronised, merged and compared with its source."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators.lexical_index import LexicalIndex
from tessera.plans.registry import query
from tessera.plans.retrieval import INDEX, asked
from tessera.sources.scratch import shared_dir
from tessera.sources.tables import table


def behind(spark, d):
    """An index of an older state: without every tenth document, and with half of the words of the next ones."""
    index = LexicalIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    old = F.when(F.col("doc_id") % 10 == 1, F.substring("text", F.lit(1), (F.length("text") / 2).cast("int"))).otherwise(F.col("text"))
    index.write(table(spark, d, "documents").where("doc_id % 10 <> 0").withColumn("text", old))
    return index


def synchronised(spark, d):
    """The same, brought up to the documents as they are, less some that are deleted."""
    index, docs = behind(spark, d), table(spark, d, "documents")
    changed = docs.where("doc_id % 10 < 2 and doc_id % 50 <> 11 and doc_id % 50 <> 7")
    index.write(changed, gone=docs.where("doc_id % 50 in (11, 7)").select("doc_id"))
    return index


LEFT = INDEX.replace("from documents)", "from documents where doc_id % 50 not in (11, 7))", 1)


@query("i11_synced_search", LEFT + "select query_id, doc_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from bm25) where rank <= 10")
def synced_search(spark, d):
    return synchronised(spark, d).search(asked(spark, d), 10)


@query("i11_merged_terms", LEFT + "select term, count(*) as df from post group by term")
def merged_terms(spark, d):
    index = synchronised(spark, d)
    index.merge()
    return index.vocabulary()


@query("i11_completeness", "select doc_id, 'missing' as side from documents where doc_id % 10 = 0 and doc_id % 3 <> 0 union all select doc_id, 'extra' from documents where doc_id % 10 <> 0 and doc_id % 3 = 0")
def completeness(spark, d):
    """An index that is behind, against a source that has lost every third document."""
    return behind(spark, d).missing(table(spark, d, "documents").where("doc_id % 3 <> 0"))
