import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import near_dedup
from tests.llm import cases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(docs, width, percent):
    sets = {d[0]: shingles(d[1], width) for d in docs}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return sorted((d[0], len(sets[d[0]]), find(d[0]), find(d[0]) == d[0]) for d in docs)


def family(n=40):
    """Copies that drift from each other, so links reach further than any pair."""
    rng, out = random.Random(1), []
    words = [f"w{rng.randrange(5000)}" for _ in range(300)]
    for i in range(n):
        words[rng.randrange(300)] = f"new{i}"
        if i % 2:
            words[rng.randrange(300)] = f"other{i}"
        out.append((1000 + i, " ".join(words), *cases.documents()[0][2:]))
    return out


@pytest.mark.parametrize("blocks", [None, (3, 200)])
def test_same_as_brute_force(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(near_dedup, "BUCKET_ROWS", blocks[0])
        monkeypatch.setattr(near_dedup, "CLUSTER_SHINGLES", blocks[1])
    docs = cases.documents() + family()
    for width, percent in ((3, 85), (5, 80)):
        rows = near_dedup.link(cases.table(spark, docs), width, percent).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows) == brute(docs, width, percent)


def test_words_that_a_polynomial_takes_for_equal(spark):
    """A Thue-Morse word and its complement are the same to any polynomial modulo a power of two."""
    one, two = ("".join("ab"[(bin(i).count("1") + k) % 2] for i in range(1024)) for k in (0, 1))
    docs = [(1, f"x y {one} z", *cases.documents()[0][2:]), (2, f"x y {two} z", *cases.documents()[0][2:]), (3, one, *cases.documents()[0][2:]), (4, two, *cases.documents()[0][2:])]
    rows = near_dedup.link(cases.table(spark, docs), 3, 85).collect()
    assert all(r.kept for r in rows) and len(rows) == 4


def test_words_whose_digests_cancel_out_in_a_sum(spark):
    """Three words each, no shingle in common; a linear sum of their digests was the same."""
    rest = cases.documents()[0][2:]
    docs = [(1, "w129a7f w26c5ec same", *rest), (2, "w38d7bf w310163 same", *rest), (3, "w129a7f w26c5ec same", *rest)]
    rows = {r.doc_id: r.component_id for r in near_dedup.link(cases.table(spark, docs), 3, 85).collect()}
    assert rows == {1: 1, 2: 2, 3: 1}


def test_empty_tables(spark):
    assert near_dedup.link(cases.empty(spark)).count() == 0
    bare = [r for r in cases.documents() if not (r[1] or "").strip()]
    assert all(r.component_id == r.doc_id and r.kept for r in near_dedup.link(cases.table(spark, bare)).collect())


def test_estimates_are_near(spark):
    rng = np.random.default_rng(0)
    for share in (0.5, 0.8, 0.95):
        found = []
        for _ in range(40):
            u = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64) * np.uint64(2))
            cut = int(len(u) * (1 - share) / (1 + share))
            a, b = np.sort(u[: len(u) - cut]), np.sort(np.concatenate([u[cut:]]))
            true = (len(u) - 2 * cut) / len(u)
            found.append(near_dedup.estimate(near_dedup.registers(a), near_dedup.registers(b))[0] - true)
        assert abs(np.mean(found)) < 0.03


def test_groups_of_the_same_rows_are_compared_once(spark, monkeypatch):
    """Two near copies share most of their bands; they and their registers are dealt to one group."""
    words = [f"w{i}" for i in range(400)]
    docs = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, " ".join(f"x{i}" for i in range(400)))]
    seen = {}

    def counted(df, name, keep=near_dedup.stored):
        found = keep(df, name)
        seen.setdefault(name, found.count() if name == "near-groups" else 0)
        return found

    monkeypatch.setattr(near_dedup, "stored", counted)
    rows = near_dedup.link(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in rows} == {1: 1, 2: 1, 3: 3}
    assert seen["near-groups"] == 2


@pytest.mark.parametrize("repeated", [False, True])
def test_sets_are_shuffled_only_to_be_compared(spark, monkeypatch, repeated):
    """Stored sets come straight from the texts, unless a row is repeated with its id; then each set is there once."""
    words = [f"w{i}" for i in range(400)]
    docs = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, " ".join(f"x{i}" for i in range(400)))]
    docs += [docs[0]] * 3 if repeated else []
    plans, sets = [], []

    def seen(df, name, keep=near_dedup.stored):
        found = keep(df, name)
        if name == "near-sets":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
            sets.append(found.count())
        return found

    monkeypatch.setattr(near_dedup, "stored", seen)
    rows = near_dedup.link(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == sorted((d[0], 3 if d[0] == 3 else 1) for d in docs)
    assert sets == [2] and plans[0].lstrip().startswith("Aggregate") == repeated


@pytest.mark.parametrize("most", [0, 200_000])
def test_few_rows_are_sent_to_the_sets(spark, monkeypatch, most):
    monkeypatch.setattr(near_dedup, "MOST_BROADCAST", most)
    dealt = spark.createDataFrame([([1, 2], bytearray(b"a"), bytearray(b"a")), ([2], bytearray(b"b"), bytearray(b"b"))], "parts array<long>, fp binary, tree binary")
    payload = spark.createDataFrame([(bytearray(b"a"), 1), (bytearray(b"b"), 2), (bytearray(b"c"), 3)], "fp binary, n int")
    found = near_dedup._compared(dealt, payload, lambda batches: (b.rename_columns(["part", "a", "b", "n"]).select(["a", "b"]) for b in batches))
    assert found.count() == 3
    assert ("strategy=broadcast" in found._jdf.queryExecution().analyzed().toString()) == (most > 0)


def test_what_is_sent_to_be_compared_is_small(spark, monkeypatch):
    """A byte for each register, and texts in place of their sets of 16 bytes a shingle; signatures go once classes are kept."""
    words = [f"w{i}" for i in range(400)]
    docs = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, " ".join(f"x{i}" for i in range(400)))]
    most, gone = [], []

    def seen(dealt, payload, work, keep=near_dedup._compared):
        most.append(max(sum(len(v) for v in r if isinstance(v, (bytes, bytearray, str))) for r in payload.collect()))
        return keep(dealt, payload, work)

    monkeypatch.setattr(near_dedup, "_compared", seen)
    monkeypatch.setattr(near_dedup, "release", lambda *tables, keep=near_dedup.release: (gone.extend(tables), keep(*tables)))
    rows = near_dedup.link(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in rows} == {1: 1, 2: 1, 3: 3}
    assert most == [near_dedup.REGISTERS, 16 + max(len(d[1]) for d in docs[:2])] and len(gone) == 1


def test_texts_in_no_cluster_are_not_shuffled(spark, monkeypatch):
    """Rows of clusters are sent to the documents whatever Spark's own bound on broadcasts is."""
    words = [f"w{i}" for i in range(400)]
    docs = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, " ".join(f"x{i}" for i in range(400)))]
    plans, keep = [], near_dedup.stored
    monkeypatch.setattr(near_dedup, "stored", lambda df, name: (plans.append(df._jdf.queryExecution().analyzed().toString()) if name == "near-sets" else None, keep(df, name))[1])
    assert near_dedup.link(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85).count() == 3
    assert len(plans) == 1 and "strategy=broadcast" in plans[0]


def test_codes_lose_no_link():
    """Equal registers have equal codes and only empty ones have none, so no estimate falls."""
    rng = np.random.default_rng(1)
    u = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64) * np.uint64(2))
    for cut in (0, 1, 20, 299):
        a, b = near_dedup.registers(u), near_dedup.registers(u[cut:])
        x, y = near_dedup.codes(a), near_dedup.codes(b)
        assert ((x == 0) == (a == near_dedup.EMPTY)).all() and (x == y)[a == b].all()
        (one, n), (two, m) = near_dedup.estimate(a, b), near_dedup.estimate(x, y, 0)
        assert n == m and two >= one


def test_another_text_of_the_same_ids_is_left_out():
    """Of rows that cannot be told apart by their ids, the set with the digest is compared."""
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words), "another text", " ".join([*words, "more"])]
    digest = [near_dedup._fingerprint(next(near_dedup.shingle_sets(pa.array([t]), 3))) for t in (texts[0], texts[0], texts[2])]
    batch = pa.record_batch({"part": [1, 1, 1], "fp": [7, 7, 8], "tree": [7, 7, 8], "digest": digest, "text": texts})
    found = [r for b in near_dedup.cluster_links(85, 3)(iter([batch])) for r in b.to_pylist()]
    assert found == [{"a": 7, "b": 8}]
