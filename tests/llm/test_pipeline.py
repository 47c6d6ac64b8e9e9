"""The pipeline on a small corpus: every stage against a plain version on what the stage before it kept."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import bpe, quality, stages
from tests.llm import cases
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_near_dedup import brute as brute_near

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t_doc string, size int"


def corpus():
    rng = random.Random(4)
    rows, labels = [], []
    base = cases.prose(rng, 150)
    for i in range(260):
        text = cases.prose(rng, rng.randrange(40, 160)).capitalize() + "."
        junk = i % 5 == 0
        if junk:
            text = text.upper().replace(" ", "!! ")
        elif i % 5 == 1:
            text = text + "\nSubscribe to our letter."
        elif i % 5 == 2:
            words = base.split(" ")
            words[rng.randrange(150)] = f"edit{i}"
            text = " ".join(words) if i % 4 else base
        rows.append((i, text, "en", f"site{i % 14:02d}", len(text), "x", 1))
        if i % 3:
            labels.append((i, 0 if junk else 1, 0))
    rows += [(900, "Subscribe to our letter.", "en", "site01", 24, "x", 1), (901, None, None, None, None, None, None), (902, "", "en", "site02", 0, "x", 1), rows[3]]
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def steps(spark, folder, tmp_path_factory):
    out = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp('out')}/{name}"
        stage(spark, out[-1], folder).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def tuples(df):
    return [tuple(r) for r in df.collect()]


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mix", "tokens"]
    assert all(s.columns == steps[0].columns for s in steps[1:-1])


def test_quality_drops_what_it_rejects(spark, steps, folder):
    scored = quality.score(steps[0], spark.read.parquet(f"{folder}/labels.parquet")).collect()
    good = {r.doc_id for r in scored if r.predicted}
    assert sorted(tuples(steps[1]), key=str) == sorted((r for r in tuples(steps[0]) if r[0] in good), key=str)
    kept = {r[0] for r in tuples(steps[1])}
    assert not kept & set(range(0, 260, 5)) and len(kept & {i for i in range(260) if i % 5}) > 200


def test_line_dedup_takes_shared_lines(steps):
    want = {}
    before = tuples(steps[1])
    for doc, _, removed, kept in brute_lines(before, 10):
        if not removed or kept.split():
            want[doc] = kept
    after = {r[0]: r for r in tuples(steps[2])}
    assert {i: r[1] or "" for i, r in after.items()} == want
    assert sum("Subscribe" in (r[1] or "") for r in after.values()) == 1 and 900 not in after
    assert all(r[4] == len(r[1]) for r in after.values() if r[1])


def test_near_dedup_leaves_one_of_a_group(steps):
    keep = {i for i, _, _, kept in brute_near(tuples(steps[2]), 5, 80) if kept}
    assert sorted(tuples(steps[3]), key=str) == sorted((r for r in tuples(steps[2]) if r[0] in keep), key=str)


def test_mix_takes_whole_documents_near_the_targets(steps):
    before, after = tuples(steps[3]), tuples(steps[4])
    rows = {r[0]: r for r in before}
    copies, times = Counter(r[0] for r in after), Counter(r[0] for r in before)
    assert all(r == rows[r[0]] for r in after) and all(n <= 2 * times[i] for i, n in copies.items())
    size, got, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows.values():
        n = len((r[1] or "").split())
        size[r[3]] += n * times[r[0]]
        got[r[3]] += n * copies[r[0]]
        most[r[3]] = max(most[r[3]], n)
    from tests.llm.test_mixing import targets

    for source, target in targets(size).items():
        assert abs(got[source] - target) <= most[source]


def test_tokens_are_the_library_s(steps):
    t = Tokenizer.from_file(bpe.default_tokenizer())

    def encoded(text):
        ids = t.encode(text or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert sorted(tuples(steps[5])) == sorted((r[0], *encoded(r[1])) for r in tuples(steps[4]))


def test_run_is_the_stages_in_turn(spark, folder, steps):
    assert sorted(tuples(corpus_pipeline.run(spark, folder))) == sorted(tuples(steps[5]))


def test_empty_table(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), SCHEMA)
    assert stages.tokens(spark, docs, folder).count() == 0
