import hashlib
import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

from tessera.llm import repeats
from tests.llm import cases


def brute(docs, window):
    count, texts = Counter(), [(d[0], (d[1] or "").encode()) for d in docs]
    for _, b in texts:
        count.update(b[k : k + window] for k in range(len(b) - window + 1))
    out = []
    for i, b in texts:
        spans = []
        for k in range(len(b) - window + 1):
            if count[b[k : k + window]] > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + window
                else:
                    spans.append([k, k + window])
        kept, last = b"", 0
        for a, c in spans:
            kept, last = kept + b[last:a], c
        kept += b[last:]
        out.append((i, len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.k, r.sha) for r in df.select("*", F.size("spans").alias("k"), F.sha2("kept", 256).alias("sha")).collect())


@pytest.mark.parametrize("window", [200, 60, 24])
def test_same_as_brute_force(spark, window):
    docs = cases.documents()
    got = result(repeats.dedup(cases.table(spark, docs), window))
    assert got == brute(docs, window)
    assert any(r[2] for r in got) and any(not r[2] for r in got)


def morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("window", [200, 60])
def test_periodic_and_thue_morse_texts(spark, window):
    """Runs without end, words that a polynomial hash takes for equal, and passages whose edges differ in every text."""
    rng = random.Random(2)
    passage = cases.prose(rng, 60)
    texts = ["ab" * 700, "ab" * 650 + "a", "abc" * 400 + "z" + "abc" * 300, morse(1024), morse(1024, "b", "a"), "x" + morse(1024) + "y", "z" * 2000, "".join(rng.choice("ab") for _ in range(3000))]
    texts += [cases.prose(rng, rng.randrange(40)) + passage[k % 7 :] + cases.prose(rng, rng.randrange(40)) for k in range(60)]
    texts += [passage[k : k + window + rng.randrange(20)] + str(k) for k in range(0, 120, 5)]
    docs = [(i, t, *cases.documents()[0][2:]) for i, t in enumerate(texts)]
    assert result(repeats.dedup(cases.table(spark, docs), window)) == brute(docs, window)


def test_long_texts_go_in_pieces(spark):
    docs = [r for r in cases.documents() if r[1] and len(r[1]) > 900]
    df = cases.table(spark, docs).select("doc_id", F.xxhash64("text").alias("text_id"), "text")
    whole, cut = ({(r.doc_id, r.at + k) for r in repeats.sample(df, 200, piece).collect() for k in range(r.size)} for piece in (2_000_000, 777))
    assert whole == cut


def test_empty_table(spark):
    assert repeats.dedup(cases.empty(spark)).count() == 0
