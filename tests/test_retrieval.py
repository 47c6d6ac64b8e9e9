import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators.lexical_index import LexicalIndex
from tessera.operators.retrieval import bm25, bm25_top, counted, nearest_of, sparse_top_of, top
from tessera.plans import catalogue


def vectors(ids, x):
    return pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float32()))})


@pytest.mark.parametrize("tile", [(256, 4096), (7, 13), (1, 1)])
@pytest.mark.parametrize("k", [1, 5, 60])
def test_tiles_find_what_one_sort_finds(tile, k):
    rng = np.random.default_rng(k)
    x = rng.integers(-1, 2, (50, 3)).astype(np.float32)  # many ties, some zero vectors
    ids = rng.permutation(1000)[:50]
    got = nearest_of(vectors(ids[:9], x[:9]), vectors(ids, x), k, tile).to_pylist()
    unit = x.astype(float) / np.maximum(np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True)), 1e-300)
    want = []
    for i in range(9):
        near = sorted((-round(float(unit[i] @ unit[j]), 9), int(ids[j])) for j in range(50) if j != i)
        want += [(int(ids[i]), j, -s) for s, j in near[:k]]
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == want


def test_scores_of_a_shard_are_never_held_at_once():
    x = np.random.default_rng(1).normal(size=(20_000, 8)).astype(np.float32)
    asked, held = vectors(range(0, 20_000, 20), x[::20]), vectors(range(20_000), x)
    tracemalloc.start()
    assert nearest_of(asked, held, 40).num_rows == 40_000
    assert tracemalloc.get_traced_memory()[1] < 60e6 < 8 * 1000 * 20_000
    tracemalloc.stop()


def sparse(name, ids, rows):
    terms, weights = ([[e[k] for e in row] for row in rows] for k in (0, 1))
    return pa.table({name: pa.array(ids, pa.int64()), "terms": pa.array(terms, pa.list_(pa.string())), "weights": pa.array(weights, pa.list_(pa.float64()))})


@pytest.mark.parametrize("tile", [(256, 1024), (5, 7), (1, 1)])
@pytest.mark.parametrize("k", [1, 6, 80])
def test_sparse_tiles_find_what_one_sort_finds(tile, k):
    rng = np.random.default_rng(k)
    # Terms that nearly all rows have, rare ones, ties, rows without terms.
    rows = [[(f"t{t}", float(rng.integers(1, 3))) for t in rng.choice(300, n, p=1 / np.arange(1, 301) / sum(1 / np.arange(1, 301)), replace=False)] for n in rng.integers(0, 30, 70)]
    ids = rng.permutation(1000)[:70]
    got = sparse_top_of(sparse("query_id", ids[:11], rows[:11]), sparse("doc_id", ids, rows), k, 6, tile, 50).to_pylist()
    want = []
    for i in range(11):
        q = dict(rows[i])
        scores = [(sum(q[t] * w for t, w in row if t in q), int(j)) for j, row in zip(ids, rows)]
        want += [(int(ids[i]), j, s) for s, j in sorted(((s, j) for s, j in scores if s), key=lambda x: (-x[0], x[1]))[:k]]
    assert [(r["query_id"], r["doc_id"], r["score"]) for r in got] == want


@pytest.mark.parametrize("only", [None, ["b", "zz", "c"], []])
def test_words_are_counted_by_document(spark, only):
    texts = {1: "a b, B c", 2: "", 3: None, 4: "c c c x-y 1", 5: "!"}
    df = spark.createDataFrame(list(texts.items()), "id long, text string").coalesce(1)
    got = {r.doc_id: (r.doc_terms, dict(zip(r.terms, r.tfs, strict=True))) for r in counted(df, "id", F.col("text"), only).collect()}
    every = {1: (4, {"a": 1, "b": 2, "c": 1}), 2: (0, {}), 3: (0, {}), 4: (6, {"c": 3, "x": 1, "y": 1, "1": 1}), 5: (0, {})}
    assert got == {i: (n, {t: c for t, c in tf.items() if only is None or t in only}) for i, (n, tf) in every.items()}


@pytest.mark.parametrize("most", [200_000, 1])
def test_the_best_by_bm25_are_those_of_all(spark, most):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("ab cd ef gh ij kl".split()) for _ in range(rng.randrange(9)))) for i in range(90)], "doc_id long, text string")
    asked = spark.createDataFrame([(q, t) for q, text in enumerate(["ab", "cd ef none", "none", "ab cd ef gh ij kl"]) for t in text.split()], "query_id long, term string")
    every = bm25(docs, "doc_id", F.col("text"), asked).withColumn("score", F.round("score", 6))
    want = top(every, 7, [F.col("score").desc(), F.col("doc_id")]).select("query_id", "doc_id", "score", "rank")
    got = bm25_top(docs, "doc_id", F.col("text"), asked, 7, most_terms=most).select("query_id", "doc_id", "score", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["e02_relative_drop", "y07_weight_grid", "n14_safe_duplicates"])
def test_one_search_builds_no_index(spark, tmp_path, monkeypatch, name):
    docs = [(i, f"alpha word{i % 7}", "en", "src0", 10 + i) for i in range(80)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "alpha word3")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(LexicalIndex, "write", lambda *_: pytest.fail("an index was built"))
    assert catalogue.QUERIES[name](spark, str(tmp_path)).count() > 0


def test_fused_ranks_store_no_pairs(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    texts = {i: " ".join(rng.choice("ab cd ef gh ij".split()) for _ in range(5)) for i in range(1, 70)} | {0: "ab cd ef gh ij", 33: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0, float(i)], 0) for i in range(60)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr("tessera.operators.retrieval.pruned_top", lambda *_: pytest.fail("pairs were stored"))
    got = {(r.query_id, r.vec_id): r.fused for r in catalogue.QUERIES["y05_fused_ranks"](spark, str(tmp_path)).collect()}
    dense = sorted(range(1, 60), key=lambda i: (-round(1 / (1 + i * i) ** 0.5, 6), i))
    weight = lambda t: {w: 1 + np.log(t.split().count(w)) for w in set(t.split())}
    sparse = {i: round(sum(weight(texts[i]).values()), 6) for i in range(1, 60) if texts[i]}
    places = {i: 0.6 / (61 + r) for r, i in enumerate(dense[:50])}
    for r, i in enumerate(sorted(sparse, key=lambda i: (-sparse[i], i))[:50]):
        places[i] = places.get(i, 0) + 0.4 / (61 + r)
    best = sorted(places, key=lambda i: (-round(places[i], 8), i))[:10]
    assert {i: f for (q, i), f in got.items() if q == 0} == {i: pytest.approx(places[i], abs=1e-7) for i in best}
