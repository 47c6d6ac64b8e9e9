import zlib

import numpy as np

from tessera.llm import quality
from tests.llm import cases


def corpus(n=400):
    """Good prose, and junk of three kinds."""
    import random

    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        text = cases.prose(rng, rng.randrange(30, 200)).capitalize() + "."
        junk = i % 4 == 0
        if junk:
            text = (text.upper().replace(" ", "!! "), " ".join(w + "***" for w in text.split()), " ".join([text.split()[0]] * 60))[i // 4 % 3]
        rows.append((i, text, *cases.documents()[0][2:]))
        labels.append((i, 0 if junk else 1, 0))
    return rows, labels


def test_held_out_rows_are_told_apart(spark):
    rows, labels = corpus()
    df = quality.score(cases.table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want = dict((i, q) for i, q, _ in labels)
    got = df.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == want[r.doc_id] for r in held]) >= 0.95


def test_labels_of_held_out_rows_are_not_read(spark):
    rows, labels = corpus()
    schema = "doc_id long, quality int, toxic int"
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    one, other = ({r.doc_id: r.score for r in quality.score(cases.table(spark, rows), spark.createDataFrame(x, schema)).collect()} for x in (labels, flipped))
    assert one == other


def test_odd_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.score(cases.table(spark), none).collect()
    assert len(got) == len(cases.documents()) and all(r.score == 0.5 and r.predicted == 1 for r in got)
    assert quality.score(cases.empty(spark), none).count() == 0
    part = spark.createDataFrame([(1, None, None), (None, 1, 0), (2, 1, 0), (2, 0, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(cases.table(spark), part).count() == len(cases.documents())


def test_flat_trees_walk_as_nodes_do():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 22))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    t = quality.fit(x, y)
    assert ((t.score(x) > 0.5) == y).mean() > 0.97

    def one(row):
        total = t.base
        for at in t.roots:
            while t.feature[at] >= 0:
                at = t.left[at] if row[t.feature[at]] <= t.threshold[at] else t.right[at]
            total += t.value[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([one(r) for r in x[:50]], t.score(x[:50]))


def test_held_out_accuracy_on_the_given_documents(spark):
    """The rows whose labels are not learnt from, of the given tables."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    want = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in quality.score(docs, labels).where("held_out").collect() if want.get(r.doc_id) is not None]
    assert len(held) > 50
    assert np.mean([r.predicted == want[r.doc_id] for r in held]) >= 0.95
    good, bad = ([r.score for r in held if want[r.doc_id] == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) >= 0.98
