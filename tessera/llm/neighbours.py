"""Approximate nearest neighbours by a permutation index over pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._shared import table

#: A permutation's positions are kept in one byte each.
MOST_PIVOTS = 256


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, embedding`` of the rows with an id and a finite vector other than zero."""
    v = F.col("embedding")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & v.isNotNull() & ok)


def pivots(vectors: DataFrame, most: int = MOST_PIVOTS) -> np.ndarray:
    """At most ``most`` unit vectors from a bounded sample, each the farthest from those before it.

    The sample is the 4 * ``most`` rows with the least hash of their id: all that reaches the driver.
    """
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * most).select("embedding").toPandas()["embedding"]
    if not len(sample):
        return np.zeros((0, 0))
    sizes = [len(x) for x in sample]
    width = max(set(sizes), key=lambda k: (sizes.count(k), -k))
    x = np.array([r for r in sample if len(r) == width], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    chosen, far = [0], x @ x[0]
    while len(chosen) < min(most, len(x)):
        i = int(far.argmin())
        if far[i] > 1 - 1e-9:
            break
        chosen.append(i)
        far = np.maximum(far, x @ x[i])
    return x[chosen]


def index(vectors: DataFrame, pivot: np.ndarray) -> DataFrame:
    """``vec_id, embedding, perm``: byte p of ``perm`` is the place of pivot p when pivots are ordered by nearness."""

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            near = (x @ pivot.T) / np.linalg.norm(x, axis=1, keepdims=True)
            order = np.argsort(-np.round(near, 12), axis=1, kind="stable")
            place = np.empty(order.shape, np.uint8)
            np.put_along_axis(place, order, np.arange(len(pivot), dtype=np.uint8)[None, :], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in place], pa.binary())], names=["vec_id", "embedding", "perm"])

    same_width = vectors.where(F.size("embedding") == pivot.shape[1])
    return same_width.mapInArrow(permute, "vec_id long, embedding array<double>, perm binary")


def _places(column, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, n)


def search_shard(queries: pa.Table, shard: pa.Table, n_pivots: int, k: int, post: int, probe: int, rerank: int) -> pa.Table:
    """The ``k`` nearest found in one shard for each query of a block.

    The shard's inverted file lists each vector under its ``post`` nearest pivots; a query reads the lists of its
    ``probe`` nearest. Those are ranked by footrule distance of the whole permutations, and the first ``rerank`` by
    cosine on the vectors themselves. Ties go to the smaller id throughout.
    """
    kinds = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
    out: dict[str, list] = {c: [] for c in kinds}
    if queries.num_rows and shard.num_rows:
        ids = shard["vec_id"].to_numpy()
        by_id = np.argsort(ids, kind="stable")
        ids, x, places = ids[by_id], _matrix(shard["embedding"])[by_id], _places(shard["perm"], n_pivots)[by_id]
        norms = np.sqrt((x * x).sum(axis=1))
        row, pivot = np.nonzero(places < post)
        by_pivot = np.argsort(pivot, kind="stable")
        row, starts = row[by_pivot], np.searchsorted(pivot[by_pivot], np.arange(n_pivots + 1))
        q_ids, q_x, q_places = queries["vec_id"].to_numpy(), _matrix(queries["embedding"]), _places(queries["perm"], n_pivots)
        for q in range(len(q_ids)):
            listed = np.zeros(len(ids), bool)
            for p in np.flatnonzero(q_places[q] < probe):
                listed[row[starts[p] : starts[p + 1]]] = True
            listed &= ids != q_ids[q]
            found = np.flatnonzero(listed)
            if len(found) > rerank:
                own = places[found]
                foot = (np.maximum(own, q_places[q]) - np.minimum(own, q_places[q])).sum(axis=1, dtype=np.int64)
                found = found[np.argpartition(foot * len(ids) + found, rerank)[:rerank]]
            if not len(found):
                continue
            score = (x[found] * q_x[q]).sum(axis=1) / (norms[found] * np.sqrt((q_x[q] * q_x[q]).sum()))
            best = np.lexsort((ids[found], -score))[:k]
            out["query_id"] += [q_ids[q]] * len(best)
            out["vec_id"] += ids[found][best].tolist()
            out["score"] += score[best].tolist()
    return pa.table({c: pa.array(out[c], t) for c, t in kinds.items()})


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, post: int = 4, probe: int = 48, rerank: int = 600, shard_rows: int = 4096, block_rows: int = 16384, n_pivots: int = MOST_PIVOTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row the ``k`` rows of largest cosine that the index finds.

    Rows are dealt by a hash of their id to shards of about ``shard_rows``, and queries to blocks of about
    ``block_rows``; a task searches one shard for one block, so neither a common pivot nor very many equal vectors
    make a large task, and memory is bounded. The index is approximate: recall falls as vectors spread evenly over
    many dimensions, and rises with ``probe`` and ``rerank``. Vectors that are null, zero, or hold null or non-finite
    components, rows without an id, and vectors of another length than most of the sample take no part. A row is
    never its own neighbour; rows that share an id count as one neighbour, by their largest score. Fewer candidates
    than ``k`` give fewer rows; no rows, no result; other columns are not read.
    """
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    pivot = pivots(rows, n_pivots)
    n = len(pivot)
    shards = max(1, -(-vectors.count() // shard_rows))
    blocks = max(1, -(-queries.count() // block_rows))
    if n:
        rows, asked = index(rows, pivot), index(asked, pivot)
    else:
        rows, asked = (df.withColumn("perm", F.lit(b"")) for df in (rows, asked))
    rows = rows.withColumns({"shard": F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    asked = asked.withColumns({"shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), "block": F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")})

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return search_shard(left, right, n, k, post, probe, rerank)

    found = asked.groupBy("shard", "block").cogroup(rows.groupBy("shard", "block")).applyInArrow(both, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 50 = 0"))
