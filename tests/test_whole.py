"""Queries that do the whole job, on tables small enough to work out by hand."""

import random

import pytest

from tessera.operators import dedup
from tessera.plans import catalogue

ASKED = "one two three four five six seven eight nine ten"


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """Documents 1 and 2 have all and the first eight words of item 0, document 3 only its last; document 4 none."""
    d = str(tmp_path_factory.mktemp("texts"))
    docs = [(1, ASKED), (2, ASKED.removesuffix(" nine ten")), (3, "ten others of no interest"), (4, "nothing to see")]
    spark.createDataFrame([(i, t, "en", f"src{i}", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, ASKED + " ten")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_queries_read_their_whole_text(spark, texts):
    run = lambda name: catalogue.QUERIES[name](spark, texts).collect()
    assert {r.doc_id for r in run("i06_bm25_and")} == {1}
    assert {r.doc_id for r in run("i06_bm25_or")} == {1, 2, 3}
    assert [(r.docs, r.best) for r in run("i13_coverage")] == [(3, 1.0)]
    assert {r.doc_id for r in run("e01_channel_rank") if r.channel == "lexical"} == {1, 2, 3}
    # 8 of 10 terms are relevant in two channels, 1 of 10 is not, and none is more than all.
    assert {r.doc_id: r.verdict for r in run("k13_relevance")} == {1: "relevant", 2: "relevant", 3: "irrelevant", 4: "irrelevant"}


def test_tags_count_every_document(spark, tmp_path):
    docs = [(i, lang, f"src{i % 3}") for i, lang in enumerate(["es", "es", "es", "de", None, "es"])]
    spark.createDataFrame(docs, "doc_id long, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1,), (22,)], "item_id long").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.item_id, r.tag, r.n) for r in catalogue.QUERIES["c11_tag_overlap"](spark, str(tmp_path)).collect())
    assert got == [(1, "es", 4), (1, "src1", 2), (22, "es", 4), (22, "src2", 2)]


def vectors(spark, d, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{d}/embeddings.parquet")


def test_every_vector_is_judged(spark, tmp_path):
    vectors(spark, tmp_path, [(i, [1.0, float(i), 0.5], i % 2) for i in range(1, 8)])
    ap = {r.query_id: r.ap for r in catalogue.QUERIES["y04_average_precision"](spark, str(tmp_path)).collect()}
    assert sorted(ap) == list(range(1, 8))
    # The six others of 7 are 6, 5, 4, 3, 2, 1: 5, 3 and 1 have its label.
    assert ap[7] == pytest.approx((1 / 2 + 2 / 4 + 3 / 6) / 3, abs=1e-6)
    scores = {r.category: (r.queries, r.hit_rate) for r in catalogue.QUERIES["y16_label_scores"](spark, str(tmp_path)).collect()}
    assert scores == {0: (3, 1.0), 1: (4, 1.0)}


def test_scores_alike_in_six_places_go_by_id(spark, tmp_path):
    # Nearer by less than six places show, the greater the id.
    vectors(spark, tmp_path, [(0, [1.0, 0.0], 1)] + [(i, [1.0, 1e-4 + (100 - i) * 1e-6], 1) for i in range(1, 100)])
    got = catalogue.QUERIES["j05_cosine_topk"](spark, str(tmp_path)).where("query_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1, 11)) and {r.score for r in got} == {1.0}


def classes(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block_rows", [2000, 7])
def test_near_copies_are_those_of_brute_force(spark, block_rows):
    rng = random.Random(5)
    words = "service port runs slow node cache disk the a user theme dark light model uses often never 80 443".split()
    lines = ["The service runs on port 8080.", "service runs on port 8080", "service runs on port 8081", "!!", "--", "", "a", "ab", "no", "the", "abcdefghi", "abcdefghixy"]
    for _ in range(25):
        line = " ".join(rng.choice(words) for _ in range(rng.randrange(2, 40)))
        at = rng.randrange(len(line))
        lines += [line, line[:at] + "q" + line[at + 1 :], "x" + line[1:], line + " end", line.upper(), "".join(c if rng.random() > 0.07 else rng.choice("klmn") for c in line)]
        lines.append(line.replace(" the ", " The ").replace("dark", "Dark"))
    lines = sorted(set(lines))
    pairs = [(a, b) for i, a in enumerate(lines) for b in lines[:i] if dedup.is_near_copy(a, b) or dedup.is_near_copy(b, a)]
    df = spark.createDataFrame([(x, x) for x in lines], "line_id string, line string").repartition(3)
    links = [tuple(r) for r in dedup.near_copy_links(df, block_rows).collect()]
    assert classes(lines, links) == classes(lines, pairs)
    assert len(links) == len(set(links)) and set(links) <= {tuple(sorted(p)) for p in pairs}
