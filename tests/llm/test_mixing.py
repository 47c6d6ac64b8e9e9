import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def taken(df):
    rows = df.groupBy("source", "part", "n").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("target").alias("target"), F.sum("taken").alias("taken"))
    return rows.collect()


def targets(sizes):
    """The rule as it is worded: share by weight, cap, deal the excess out again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, out, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        out |= {s: 2 * sizes[s] for s in over}
        open_ -= over
    return out


@pytest.mark.parametrize("quantum", [1, 64])
def test_targets_and_takes(spark, quantum):
    df = mixing.mix(cases.table(spark), mixing.five_two_one(), quantum=quantum)
    rows = taken(df)
    size = lambda t: len(WORD.findall(t or ""))
    docs = cases.documents()
    assert len(rows) == len(docs)
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((d[0], size(d[1])) for d in docs)
    sizes = Counter()
    for d in docs:
        sizes[d[3]] += size(d[1])
    want, got = targets(sizes), Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        got[r.source] += r.taken
    assert all(abs(got[s] - want[s]) <= quantum for s in want)
    assert sum(got.values()) == int(1.5 * sum(sizes.values()))
    assert sorted(map(str, rows)) == sorted(map(str, taken(mixing.mix(cases.table(spark), mixing.five_two_one(), quantum=quantum))))


def test_order_is_fair_and_total_is_the_budget(spark):
    rows = [r for r in mixing.mix(cases.table(spark), mixing.five_two_one()).collect() if r.start is not None]
    rows.sort(key=lambda r: r.start)
    assert [r.finish for r in rows] == sorted(r.finish for r in rows)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.taken


def test_the_order_decides_what_is_taken(spark):
    """What lies before the budget by finish time goes in; the piece that crosses it is the only one cut."""
    rows = [r for r in mixing.mix(cases.table(spark), mixing.five_two_one()).collect() if r["size"]]
    rows.sort(key=lambda r: (r.finish, r.source is not None, r.source))
    words = [min((r.piece + 1) * 64, r["size"]) - r.piece * 64 for r in rows]
    last = max(i for i, r in enumerate(rows) if r.taken)
    assert all(r.finish <= rows[last].finish for r in rows if r.taken) and all(r.finish >= rows[last].finish for r in rows if not r.taken)
    assert sum(r.taken < w for r, w in zip(rows, words, strict=True) if r.taken) <= 1
    assert 0 < last < len(rows) - 1


def test_whole_documents(spark):
    rows = mixing.mix(cases.table(spark), mixing.five_two_one(), quantum=None).where("taken > 0").collect()
    assert all(r.taken == r["size"] for r in rows)


def test_no_rows_and_no_words(spark):
    assert mixing.mix(cases.empty(spark), mixing.five_two_one()).count() == 0
    only = cases.table(spark, [r for r in cases.documents() if not r[1]])
    assert all(r.taken == 0 for r in mixing.mix(only, mixing.five_two_one()).collect())
