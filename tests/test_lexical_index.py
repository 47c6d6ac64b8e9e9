import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import lexical_index
from tessera.operators.lexical_index import LexicalIndex
from tessera.sources.version_log import Conflict

WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu") for b in ("n", "rt", "sh", "l", "ck")]


def texts(n, seed):
    rng = random.Random(seed)
    return {i: None if i % 50 == 9 else " ".join(rng.choices(WORDS, [1 / (k + 1) for k in range(len(WORDS))], k=rng.randrange(0, 40))) for i in range(n)}


def frame(spark, rows):
    return spark.createDataFrame(sorted(rows.items()), "doc_id long, text string").repartition(3)


def brute(rows, asked, k):
    docs = {i: re.findall(r"\w+", t or "") for i, t in rows.items()}
    sized = [len(w) for w in docs.values() if w]
    n, mean, df = len(sized), sum(sized) / len(sized), Counter(t for w in docs.values() for t in set(w))
    out = []
    for q, terms in asked.items():
        scored = []
        for i, w in docs.items():
            tf = Counter(w)
            hit = [t for t in terms if tf[t]]
            if hit:
                scored.append((-round(sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in hit), 6), i))
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def result(df):
    return sorted((r.query_id, r.doc_id, r.score, r.rank) for r in df.collect())


@pytest.fixture
def asked(spark):
    rng = random.Random(2)
    want = {q: set(rng.sample(WORDS, 1 + q % 9)) | ({"absent"} if q % 3 == 0 else set()) for q in range(20)}
    return want, spark.createDataFrame([(q, t) for q, ts in want.items() for t in ts], "query_id long, term string")


@pytest.mark.parametrize("leads", [1, 6])
def test_search_sync_delete_and_merge(spark, tmp_path, monkeypatch, asked, leads):
    monkeypatch.setattr(lexical_index, "LEADS", leads)
    monkeypatch.setattr(lexical_index, "BLOCK", 16)
    want, table = asked
    rows, index = texts(600, 1), LexicalIndex(spark, f"{tmp_path}/index")
    assert index.search(table, 5).count() == 0 and index.version() == -1
    index.write(frame(spark, rows))
    assert result(index.search(table, 5)) == brute(rows, want, 5)

    changed = {i: t for i, t in texts(700, 5).items() if i % 3 == 0}
    gone = list(range(0, 600, 7))
    index.write(frame(spark, {i: t for i, t in changed.items() if i not in gone}), gone=spark.createDataFrame([(g,) for g in gone], "doc_id long"))
    now = {i: t for i, t in (rows | changed).items() if i not in gone}
    for _ in range(2):
        assert result(index.search(table, 5)) == brute(now, want, 5)
        full = {(r.query_id, r.doc_id): round(r.score, 6) for r in index.scores(table).collect()}
        assert all(full[q, i] == s for q, i, s, _ in brute(now, want, 5))
        df = Counter(t for x in now.values() for t in set((x or "").split()))
        assert {r.term: r.df for r in index.vocabulary().collect()} == dict(df)
        assert index.missing(frame(spark, now)).count() == 0
        index.merge()
    assert len(index.manifest()["segments"]) == 1 and index.manifest()["clean"]
    short = {i: t for i, t in now.items() if i > 5} | {9999: "new"}
    assert sorted(map(tuple, index.missing(frame(spark, short)).collect())) == sorted([(i, "extra") for i in now if i <= 5] + [(9999, "missing")])
    index.rebuild(frame(spark, rows))
    assert result(index.search(table, 5)) == brute(rows, want, 5)


def test_one_of_two_writers_wins(spark, tmp_path, asked):
    want, table = asked
    rows, index = texts(60, 1), LexicalIndex(spark, f"{tmp_path}/index")
    index.write(frame(spark, rows))
    base = index.manifest()
    index.write(frame(spark, {1: "ban ban"}), base=base)
    with pytest.raises(Conflict):
        index.write(frame(spark, {2: "kel"}), base=base)
    assert result(index.search(table, 3)) == brute(rows | {1: "ban ban"}, want, 3)


def test_only_asked_buckets_are_read(spark, tmp_path):
    index = LexicalIndex(spark, f"{tmp_path}/index")
    index.write(frame(spark, texts(200, 1)))
    one = spark.createDataFrame([(1, "ban")], "query_id long, term string")
    found = index._blocks_of(index.manifest(), one)
    files = {r[0] for r in found.select(F.input_file_name()).distinct().collect()}
    assert len(files) == 1


def test_hits_are_those_of_all_scores(spark, tmp_path, asked):
    _, table = asked
    index = LexicalIndex(spark, f"{tmp_path}/index")
    pairs = table.select("query_id").distinct().crossJoin(spark.range(70).select(F.col("id").alias("doc_id")))
    assert index.hits(table, pairs).count() == 0
    index.write(frame(spark, texts(60, 1)))
    index.write(frame(spark, {1: "ban ban", 62: "kel ban"}), gone=spark.createDataFrame([(2,)], "doc_id long"))
    every = index.scores(table).select("query_id", "doc_id", "hits")
    assert sorted(map(tuple, index.hits(table, pairs.unionByName(pairs)).collect())) == sorted(map(tuple, every.collect()))


def test_reranking_never_scores_every_document(spark, tmp_path, monkeypatch):
    from tessera.plans import catalogue

    docs = [(i, f"alpha word{i % 7}", "en", "src0", 10 + i) for i in range(80)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "alpha word3")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(LexicalIndex, "scores", lambda *_: pytest.fail("every document was scored"))
    assert catalogue.QUERIES["k10_rerank_blend"](spark, str(tmp_path)).count() == 10
