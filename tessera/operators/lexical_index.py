"""A stored inverted index: segments of posting blocks under a manifest, with pruned top-k search.

A segment is a folder of parquet tables: ``postings`` (blocks of up to 128 documents of a term, in buckets of terms, with
the block's greatest tf and least length), ``terms`` (how many documents each term gains or loses by the segment),
``docs`` (each document's length and terms) and ``dead`` (documents that older segments may have and that no longer count
there). The index is what the newest manifest lists. A change writes its segment first and then the next manifest, which
only one writer can create, so readers see whole states and a crash leaves the old one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import terms
from tessera.operators.retrieval import pruned_top
from tessera.sources.scratch import stored
from tessera.sources.version_log import VersionLog

#: Buckets of terms, documents of a block, and a query's rarest terms that are scored first.
BUCKETS, BLOCK, LEADS = 64, 128, 6
K1, B = 1.2, 0.75
_BLOCKS = "bucket int, term string, low long, high long, max_tf int, min_terms int, docs array<long>, tfs array<int>, sizes array<int>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``bucket, term, doc_id, tf, doc_terms``, sorted by term and document, in blocks."""
    for batch in batches:
        if not batch.num_rows:
            continue
        term = batch.column(1).dictionary_encode().indices.to_numpy()
        fresh = np.concatenate([[True], term[1:] != term[:-1]])
        start = np.flatnonzero(fresh)
        place = np.arange(len(term)) - np.repeat(start, np.diff(np.append(start, len(term))))
        start = np.flatnonzero(place % BLOCK == 0)
        doc, tf, size = (batch.column(c).to_numpy() for c in (2, 3, 4))
        at = pa.array(np.append(start, len(term)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(v)) for v in (doc, tf.astype(np.int32), size.astype(np.int32))]
        head, last = pa.array(start), np.append(start[1:], len(term)) - 1
        stats = [pa.array(v) for v in (doc[start], doc[last], np.maximum.reduceat(tf, start).astype(np.int32), np.minimum.reduceat(size, start).astype(np.int32))]
        names = [f.split()[0] for f in _BLOCKS.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(head), batch.column(1).take(head), *stats, *lists], names=names)


class LexicalIndex(VersionLog):
    """An index at ``path``; every change returns nothing and makes a new version, every read is of the newest one."""

    EMPTY = {"segments": [], "docs": 0, "terms": 0, "clean": True}

    def _table(self, name: str, manifest: dict) -> DataFrame | None:
        parts = [self.spark.read.parquet(f"{self.path}/segments/{s}/{name}").withColumn("seq", F.lit(k)) for k, s in enumerate(manifest["segments"])]
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out

    def _live(self, rows: DataFrame, manifest: dict) -> DataFrame:
        """Rows (``doc_id, seq``) that no later segment declares dead."""
        if manifest["clean"]:
            return rows
        dead = self._table("dead", manifest).groupBy("doc_id").agg(F.max("seq").alias("until"))
        return rows.join(dead, "doc_id", "left").where("until is null or seq >= until").drop("until")

    def docs(self) -> DataFrame | None:
        """``doc_id, doc_terms, terms, seq`` of every live document, those without terms too."""
        manifest = self.manifest()
        found = self._table("docs", manifest)
        return None if found is None else self._live(found, manifest)

    def write(self, docs: DataFrame, doc_id: str = "doc_id", text: Column | str = "text", gone: DataFrame | None = None, base: dict | None = None) -> None:
        """Add documents, or replace those of the same ids, and delete those of ``gone`` (``doc_id``), as one segment.

        Ids are unique whole numbers. Null texts have no terms.
        """
        base = self.manifest() if base is None else base
        name = uuid.uuid4().hex
        folder = f"{self.path}/segments/{name}"
        words = docs.select(F.col(doc_id).cast("long").alias("doc_id"), terms(F.col(text) if isinstance(text, str) else text).alias("words"))
        words.select("doc_id", F.size("words").alias("doc_terms"), F.array_distinct("words").alias("terms")).write.parquet(f"{folder}/docs")
        tfs = words.select("doc_id", F.size("words").alias("doc_terms"), F.explode("words").alias("term")).groupBy("doc_id", "doc_terms", "term").agg(F.count("*").cast("int").alias("tf"))
        bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
        tfs = tfs.select(bucket.alias("bucket"), "term", "doc_id", "tf", "doc_terms")
        # A frequent term's documents go to many tasks; none is a group.
        tfs.repartitionByRange("bucket", "term", "doc_id").sortWithinPartitions("bucket", "term", "doc_id").mapInArrow(_blocks, _BLOCKS).write.partitionBy("bucket").parquet(f"{folder}/postings")

        own = self.spark.read.parquet(f"{folder}/docs")
        dead = own.select("doc_id") if gone is None else own.select("doc_id").unionByName(gone.select(F.col("doc_id").cast("long").alias("doc_id"))).distinct()
        gained = own.select(F.explode("terms").alias("term"), F.lit(1).alias("df"))
        counts = F.count_if(F.col("doc_terms") > 0), F.coalesce(F.sum("doc_terms"), F.lit(0))
        n, total = own.agg(*counts).first()
        older = self._table("docs", base)
        if older is None:
            dead = dead.limit(0)
        else:
            replaced = stored(self._live(older, base).join(dead, "doc_id", "left_semi"), "index-replaced")
            gained = gained.unionByName(replaced.select(F.explode("terms").alias("term"), F.lit(-1).alias("df")))
            less, fewer = replaced.agg(*counts).first()
            n, total = n - less, total - fewer
            dead = replaced.select("doc_id").distinct()
        dead.write.parquet(f"{folder}/dead")
        clean = base["clean"] and (older is None or self.spark.read.parquet(f"{folder}/dead").isEmpty())
        gained.groupBy("term").agg(F.sum("df").alias("df")).withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{folder}/terms")
        self.commit(base, segments=[*base["segments"], name], docs=base["docs"] + n, terms=base["terms"] + total, clean=clean)

    def rebuild(self, docs: DataFrame, doc_id: str = "doc_id", text: Column | str = "text") -> None:
        """Replace all segments by one of ``docs``, at once."""
        base = self.manifest()
        self.write(docs, doc_id, text, base={"version": base["version"], **self.EMPTY})

    def merge(self) -> None:
        """All segments as one, without what is dead. Texts are not read."""
        base = self.manifest()
        name = uuid.uuid4().hex
        folder = f"{self.path}/segments/{name}"
        docs = self._live(self._table("docs", base), base).drop("seq")
        docs.write.parquet(f"{folder}/docs")
        bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
        rows = self._live(self._postings(base, None), base).select(bucket.alias("bucket"), "term", "doc_id", "tf", "doc_terms")
        rows.repartitionByRange("bucket", "term", "doc_id").sortWithinPartitions("bucket", "term", "doc_id").mapInArrow(_blocks, _BLOCKS).write.partitionBy("bucket").parquet(f"{folder}/postings")
        self._table("terms", base).groupBy("bucket", "term").agg(F.sum("df").alias("df")).where("df > 0").write.partitionBy("bucket").parquet(f"{folder}/terms")
        docs.limit(0).select("doc_id").write.parquet(f"{folder}/dead")
        self.commit(base, segments=[name], clean=True)

    def missing(self, source: DataFrame, doc_id: str = "doc_id") -> DataFrame:
        """``doc_id, side``: documents of ``source`` that the index lacks (missing), and the other way round (extra)."""
        own, rows = self.docs().select("doc_id"), source.select(F.col(doc_id).cast("long").alias("doc_id"))
        return rows.exceptAll(own).withColumn("side", F.lit("missing")).unionByName(own.exceptAll(rows).withColumn("side", F.lit("extra")))

    def vocabulary(self) -> DataFrame:
        """``term, df``: in how many live documents each term is."""
        return self._table("terms", self.manifest()).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    # Search.

    def _blocks_of(self, manifest: dict, asked: DataFrame | None) -> DataFrame:
        """Blocks of the terms that are asked for; only their buckets are read."""
        rows = self._table("postings", manifest)
        if asked is None:
            return rows
        wanted = asked.select("term").distinct()
        buckets = [r[0] for r in wanted.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).distinct().collect()]
        return rows.where(F.col("bucket").isin(buckets)).join(wanted, "term", "left_semi")

    def _postings(self, manifest: dict, asked: DataFrame | None) -> DataFrame:
        zipped = F.explode(F.arrays_zip("docs", "tfs", "sizes")).alias("p")
        return self._blocks_of(manifest, asked).select("term", "seq", zipped).select("term", "seq", F.col("p.docs").alias("doc_id"), F.col("p.tfs").alias("tf"), F.col("p.sizes").alias("doc_terms"))

    def _weighed(self, manifest: dict, asked: DataFrame) -> tuple[DataFrame, Column]:
        """``term, idf`` of the asked terms that documents have, and a posting's share of its idf."""
        mean = manifest["terms"] / max(manifest["docs"], 1)
        idf = F.log(1 + (manifest["docs"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
        found = self._table("terms", manifest).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        share = lambda tf, size: F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(size) / mean))
        return found.select("term", "df", idf.alias("idf")), share

    def scores(self, asked: DataFrame) -> DataFrame:
        """``query_id, doc_id, score, hits`` of every document with a term of the query (``query_id, term``)."""
        manifest = self.manifest()
        if not manifest["segments"]:
            return asked.select("query_id", F.lit(0).cast("long").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("hits")).limit(0)
        idf, share = self._weighed(manifest, asked)
        rows = self._live(self._postings(manifest, asked), manifest).join(idf, "term").select("doc_id", "term", (F.col("idf") * share("tf", "doc_terms")).alias("weight"))
        return asked.join(rows.repartition("doc_id"), "term").groupBy("query_id", "doc_id").agg(F.sum("weight").alias("score"), F.count("*").alias("hits"))

    def hits(self, asked: DataFrame, pairs: DataFrame) -> DataFrame:
        """``query_id, doc_id, hits``: how many of a query's different terms (``query_id, term``) a document has, for ``pairs``.

        Pairs that have none in common are left out. Documents' own terms are read, and no postings.
        """
        docs = self.docs()
        if docs is None:
            return self.scores(asked).select("query_id", "doc_id", "hits")
        own = docs.select("doc_id", "terms").join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
        wanted = asked.groupBy("query_id").agg(F.collect_set("term").alias("wanted"))
        found = pairs.select("query_id", "doc_id").distinct().join(wanted, "query_id").join(own, "doc_id")
        return found.select("query_id", "doc_id", F.size(F.array_intersect("wanted", "terms")).cast("long").alias("hits")).where("hits > 0")

    def search(self, asked: DataFrame, k: int, places: int = 6) -> DataFrame:
        """``query_id, doc_id, score, rank``: the k best of each query, as ``scores`` has them, rounded, ties to lesser ids.

        See ``pruned_top``; a block's greatest tf and least length bound what a term adds.
        """
        manifest = self.manifest()
        if not manifest["segments"]:
            return self.scores(asked).select("query_id", "doc_id", "score", F.lit(0).cast("long").alias("rank"))
        asked = stored(asked.select("query_id", "term").distinct(), "asked")
        idf, share = self._weighed(manifest, asked)
        blocks = self._blocks_of(manifest, asked).select("term", "max_tf", "min_terms").groupBy("term").agg(F.max(share("max_tf", "min_terms")).alias("most"))
        known = idf.join(blocks, "term").select("term", F.col("idf").alias("factor"), (F.col("idf") * F.col("most")).alias("bound"))
        rows = self._live(self._postings(manifest, asked), manifest).select("term", "doc_id", share("tf", "doc_terms").alias("value"))
        rows = stored(rows.join(idf.select("term"), "term", "left_semi"), "asked-postings")
        return pruned_top(asked.join(known, "term").select("query_id", "term", "factor", "bound"), rows, k, places, LEADS)
