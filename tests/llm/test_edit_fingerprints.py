import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import edit_fingerprints as e
from tests.llm import cases


def brute_fingerprint(text):
    """The embedding step by step, and each sample's place by trying them all."""
    bits = np.unpackbits(np.frombuffer(hashlib.shake_256(b"walks").digest(e.KINDS * e.PERIOD // 8), np.uint8)).reshape(e.KINDS, e.PERIOD)
    out, i, j = [], 0, 0
    while i < len(text):
        out.append(i)
        i += int(bits[ord(text[i]) * 0x9E3779B1 % 2**32 >> 26][j % e.PERIOD])
        j += 1
    if not out:
        return bytes(e.SAMPLES)

    def mixed(x):
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * by % 2**64
        return x ^ x >> 31

    found = []
    for row in e.RECORDS.tolist():
        place = max(p for p in row if p < len(out))
        gram = [*map(ord, text[out[place] : out[place] + 3]), 0, 0][:3]
        found.append(mixed(mixed(gram[0] | gram[1] << 21 | gram[2] << 42) ^ place) >> 56)
    return bytes(found)


def brute(docs):
    key = lambda d: (d[0] is not None, d[0] or 0)
    docs, out = sorted(docs, key=key), []
    for d, after in zip(docs, docs[1:] + docs[:1], strict=True):
        a, b = d[1] or "", after[1] or ""
        h = len(a) // 2
        new = a[: len(a) - h] + b[:h]
        x, y, z = (brute_fingerprint(t) for t in (a, new, b))
        same = [max(0.0, (sum(p == q for p, q in zip(x, w, strict=True)) / e.SAMPLES - 1 / 256) / (1 - 1 / 256)) for w in (y, z)]
        out.append((d[0], len(a), hashlib.sha256(new.encode()).hexdigest(), x.hex(), y.hex(), *(round(s, 9) for s in same)))
    return sorted(map(str, out))


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_same_as_brute_force(spark, tmp_path, coalesce):
    docs = [d for d in cases.documents() if len(d[1] or "") < 9000][:-2] + [(None, "without id", *cases.documents()[0][2:])]
    cases.table(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        rows = e.query(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(str((*r[:5], round(r[5], 9), round(r[6], 9))) for r in rows) == brute(docs)


def test_likeness_follows_edits(spark):
    rng = random.Random(3)
    shares = []
    for _ in range(40):
        text, other = cases.prose(rng, 300), cases.prose(rng, 300)
        edited = list(text)
        for _ in range(3):
            k = rng.randrange(len(edited))
            edited[k : k + rng.randrange(2)] = rng.choice(["q", ""])
        prints = [e.fingerprint(t) for t in (text, "".join(edited), text[: len(text) // 2] + other[: len(text) // 2], other)]
        shares.append([e.likeness(prints[0], p) for p in prints])
    same, few, half, none = np.mean(shares, axis=0)
    assert same == 1 and few > 0.7 and 0.4 < half < 0.65 and none < 0.1


def test_empty_and_single(spark):
    assert e.neighbours(cases.empty(spark)).count() == 0 and e.fingerprints(cases.empty(spark)).count() == 0
    (only,) = e.neighbours(cases.table(spark, [(5, "just this text", *cases.documents()[0][2:])])).collect()
    assert only.near_next == 1 and only.n_chars == 14
    (none,) = e.neighbours(cases.table(spark, [(5, None, *cases.documents()[0][2:])])).collect()
    assert (none.n_chars, none.near_edited, none.near_next) == (0, 1, 1)
    rows = e.fingerprints(cases.table(spark)).collect()
    assert len(rows) == len(cases.documents()) and all(len(r.fingerprint) == 2 * e.SAMPLES for r in rows)


def test_edits_within():
    rng = random.Random(1)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(150):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        for most in range(6):
            assert e.edits_within(e.codes(a), e.codes(b), most) == (distance(a, b) <= most), (a, b, most)


@pytest.mark.parametrize("rows", [512, 3])
def test_links_of_near_copies(spark, monkeypatch, rows):
    rng = random.Random(7)
    docs, rest = [], cases.documents()[0][2:]
    for family in range(12):
        text = cases.prose(rng, 250)
        for k in range(5):
            edited = list(text)
            for _ in range(k):
                edited[rng.randrange(len(edited))] = "#"
            docs.append((10 * family + k, "".join(edited), *rest))
    docs += [(500 + i, cases.prose(rng, 200), *rest) for i in range(10)] + [(600, None, *rest), (601, "", *rest), (602, docs[0][1], *rest)]
    spanning = e.spanning
    monkeypatch.setattr(e, "spanning", lambda found, payload, limit, work: spanning(found, payload, rows if limit == 512 else limit, work))
    found = {r.doc_id: r.component_id for r in e.link(cases.table(spark, docs)).collect()}
    want = {d[0]: d[0] // 10 * 10 if d[0] < 500 else d[0] for d in docs} | {602: 0}
    assert found == want
