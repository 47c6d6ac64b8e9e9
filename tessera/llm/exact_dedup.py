"""Exact dedup over an extendible-hash index kept in shared files."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import stored, table

#: Bits of the key that are weighed first, and those added where a bucket is still overfull.
FIRST_BITS, MORE_BITS = 16, 4
#: Bytes of a bucket, and the number of buckets beyond which buckets grow instead, so that the directory stays small.
CAPACITY, MOST_BUCKETS = 1_000_000, 1 << 20
#: Owner tasks, at most one a bucket, and the bytes of an owner beyond which there are more.
OWNERS, OWNED = 2000, 64_000_000


class Directory:
    """An extendible-hash directory: a power of two of entries, each naming a bucket with a local depth."""

    def __init__(self) -> None:
        self.depth = 0
        self.entries = np.zeros(1, np.int32)
        self.local = [0]

    def split(self, bucket: int, prefix: int) -> int:
        """Split the bucket of the keys that begin with the ``local`` bits ``prefix`` by one more bit.

        The directory doubles if the bucket used all its bits. The new bucket has the keys whose next bit is 1.
        """
        if self.local[bucket] == self.depth:
            self.entries = np.repeat(self.entries, 2)
            self.depth += 1
        self.local[bucket] += 1
        self.local.append(self.local[bucket])
        new = len(self.local) - 1
        shift = self.depth - self.local[bucket]
        self.entries[(2 * prefix + 1) << shift : (2 * prefix + 2) << shift] = new
        return new

    @classmethod
    def build(cls, weigh: Callable[[int, list[int]], dict[int, tuple[int, int]]], capacity: int, bits: int = FIRST_BITS, more: int = MORE_BITS) -> Directory:
        """``weigh(bits, over)``: weight and number of keys (2 for more) by the first ``bits``, under the prefixes ``over``.

        Buckets over ``capacity`` are split as long as they have several keys: copies of one key chain.
        """
        made, work, step, over = cls(), [(0, 0, 0)], bits, [0]
        while work:
            weights = weigh(step, over)
            keys = sorted(weights)
            upto, different = ([0, *accumulate(weights[k][i] for k in keys)] for i in (0, 1))
            full = []
            while work:
                bucket, prefix, depth = work.pop()
                a, b = (bisect_left(keys, x << (step - depth)) for x in (prefix, prefix + 1))
                if upto[b] - upto[a] <= capacity or different[b] - different[a] < 2:
                    continue
                if depth == step:
                    full.append((bucket, prefix, depth))
                    continue
                new = made.split(bucket, prefix)
                work += [(bucket, 2 * prefix, depth + 1), (new, 2 * prefix + 1, depth + 1)]
            work, over, step = full, [p for _, p, _ in full], min(64, step + more)
        return made

    def owner(self, key: np.ndarray, owners: int) -> np.ndarray:
        """The task that owns the bucket of each key: buckets in order of their keys, dealt evenly."""
        starts = np.unique(self.entries, return_index=True)[1]
        rank = np.argsort(np.argsort(starts))
        return (rank[self.bucket(key)] * owners // len(self.local)).astype(np.int32)

    def bucket(self, key: np.ndarray) -> np.ndarray:
        """Buckets of signed 64-bit keys."""
        return self.entries[(key.view(np.uint64) >> np.uint64(64 - self.depth)).astype(np.int64)] if self.depth else np.zeros(len(key), np.int32)


_SPACES = re.compile(rb"[\x20\x09-\x0d]+")


def entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = 32_000_000) -> DataFrame:
    """The index's entries ``doc_id, rep, key, sha, text``; only a text's first row of a task carries the text.

    ``rep`` numbers the equal texts that a task has met together, so a text with very many copies reaches its owner
    once per task. Up to ``memory`` bytes of repeated texts are remembered from batch to batch; beyond that a text
    only gets another ``rep``.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        kept: OrderedDict[bytes, tuple[int, bytes]] = OrderedDict()
        size = 0
        for batch in batches:
            reps, keys, shas, texts = [], [], [], []
            here: dict[bytes, int] = {}
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                text = _SPACES.sub(b" ", raw or b"")
                sha = hashlib.sha256(text).digest()
                rep = here.get(text)
                if rep is None and sha in kept and kept[sha][1] == text:
                    rep = here[text] = kept[sha][0]
                elif rep is not None and sha not in kept and len(text) < memory:
                    kept[sha] = rep, text
                    size += len(text)
                    while size > memory:
                        size -= len(kept.popitem(last=False)[1][1])
                texts.append(None if rep is not None else text)
                if rep is None:
                    number += 1
                    rep = here[text] = number
                reps.append(rep)
                keys.append(int.from_bytes(sha[:8], "big", signed=True))
                shas.append(sha)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(reps, pa.int64()), pa.array(keys, pa.int64()), pa.array(shas, pa.binary()), pa.array(texts, pa.binary())], names=["doc_id", "rep", "key", "sha", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(read, f"doc_id {kind}, rep long, key long, sha binary, text binary")


def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner task: rows come by key; texts of one key are compared byte by byte along its chain."""
    last, chain = None, []
    for batch in batches:
        found = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if key != last:
                last, chain = key, []
            at = next((i for i, t in enumerate(chain) if t == text), -1)
            if at < 0:
                at = len(chain)
                chain.append(text)
            found.append(at)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int32())], names=["key", "rep", "link"])


def dedup(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, sha`` for every row: which row of equal texts stays.

    The entries are files in the shared folder. The directory is built from bytes by prefix of the key, of 16 bits and
    then of four more under each bucket that is still over ``capacity`` bytes, so it doubles as often as it must. With more
    than 2 ** 20 buckets' worth of texts, buckets grow, so prefixes on the driver stay within some 2 ** 24. An owner task
    reads its buckets' range of keys in order, and holds the texts of one key. Equal means equal bytes after
    white space is normalised; the smallest doc_id stays, null ids last. Null texts count as empty; repeated rows with the
    smallest id all stay; rows whose group has only null ids have a null ``keep_id`` and stay. No rows, no result; other
    columns are not read. A text must fit in memory some three times.
    """
    spark = docs.sparkSession
    index = stored(entries(docs, id_col, text_col), "exact-index")
    heads = index.where("text is not null")
    total = heads.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    capacity = max(capacity, total // MOST_BUCKETS)

    def weigh(bits: int, over: list[int]) -> dict[int, tuple[int, int]]:
        rows = heads.select(F.shiftrightunsigned("key", 64 - bits).alias("prefix"), "key", F.least(F.octet_length("text").cast("long") + 64, F.lit(capacity // 4 + 1)).alias("weight"))
        if bits > FIRST_BITS:
            rows = rows.join(F.broadcast(spark.createDataFrame([(p,) for p in over], "above long")), F.shiftrightunsigned("prefix", MORE_BITS) == F.col("above"))
        several = F.when(F.min("key") == F.max("key"), 1).otherwise(2)
        return {r.prefix % (1 << bits): (r.weight, r.several) for r in rows.groupBy("prefix").agg(F.sum("weight").alias("weight"), several.alias("several")).collect()}

    directory = Directory.build(weigh, capacity)
    owners = min(len(directory.local), max(OWNERS, total // OWNED))
    shared = spark.sparkContext.broadcast(directory)

    @F.pandas_udf("int")
    def owner_of(key: pd.Series) -> pd.Series:
        return pd.Series(shared.value.owner(key.to_numpy(), owners))

    owned = heads.select("key", "rep", "text", owner_of("key").alias("owner"))
    owned = owned.repartition(owners, "owner").sortWithinPartitions("key").select("key", "rep", "text")
    links = stored(owned.mapInArrow(chains, "key long, rep long, link int"), "exact-links")

    counts = index.groupBy("rep").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    classes = links.join(counts, "rep").groupBy("key", "link").agg(F.sum("n").alias("group_size"), F.min("least").alias("keep_id"))
    found = links.join(classes, ["key", "link"]).select("rep", "keep_id", "group_size")
    rows = index.select("doc_id", "rep", "sha").join(found, "rep")
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "sha")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


ORACLE_SQL = r"""
with t as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over (partition by text_sha256) as keep_id,
  count(*) over (partition by text_sha256) as group_size,
  doc_id = min(doc_id) over (partition by text_sha256) as kept, text_sha256
from t
"""
