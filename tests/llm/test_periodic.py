import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import periodic
from tests.llm import cases

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=6, exponent=4):
    n, runs = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            size = end + q - i
            if size >= max(least, exponent * q) and not any(all(words[x] == words[x + p] for x in range(i, end + q - p)) for p in range(1, q)):
                runs.append((i, size, q))
            i = end
    dropped = {x for s, size, q in runs for x in range(s + q, s + size)}
    return sorted(runs, key=lambda r: (r[0], r[2])), " ".join(w for i, w in enumerate(words) if i not in dropped)


def repetitive(seed=5, n=120):
    """Texts over few words with runs in runs, at edges, side by side, and of periods around powers of two."""
    rng, out = random.Random(seed), []
    for i in range(n):
        words = []
        while len(words) < rng.choice([5, 30, 90, 200]):
            block = [rng.choice("ab" if i % 3 else "abcdefgh") for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33]))]
            words += (block * rng.choice([1, 1, 3, 4, 5, 8]))[: rng.randrange(1, 200)]
        out.append((100 + i, " ".join(words), *cases.documents()[0][2:]))
    return out


@pytest.mark.parametrize("size", [None, 300])
def test_same_as_brute_force(spark, monkeypatch, size):
    if size:
        monkeypatch.setattr(periodic, "SLICE", size)
    docs = [d for d in cases.documents() if len(d[1] or "") < 9000] + repetitive()
    rows = periodic.periodic_runs(cases.table(spark, docs)).collect()
    want = sorted((d[0], *brute(WORDS.findall(d[1] or ""))) for d in docs)
    assert sorted((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in rows) == want
    assert sum(len(w[1]) > 1 for w in want) > 20 and any(not w[1] for w in want)


def test_other_exponents_and_long_runs(spark):
    docs = repetitive(8, 40) + [(1, "a " * 5000, *cases.documents()[0][2:]), (2, "x " + "a b c " * 3000 + "y", *cases.documents()[0][2:])]
    rows = {r.doc_id: r for r in periodic.periodic_runs(cases.table(spark, docs), 10, 5).collect()}
    for d in docs[:40]:
        assert [tuple(x) for x in rows[d[0]].runs] == brute(d[1].split(), 10, 5)[0]
    assert [tuple(x) for x in rows[1].runs] == [(0, 5000, 1)] and rows[1].collapsed == "a"
    assert [tuple(x) for x in rows[2].runs] == [(1, 9000, 3)] and rows[2].collapsed == "x a b c y"
    with pytest.raises(ValueError):
        periodic.periodic_runs(cases.table(spark, docs), exponent=3)


def test_query(spark, tmp_path):
    docs = [d for d in cases.documents(200) if len(d[1] or "") < 9000] + [(None, "b b b b b b b", *cases.documents()[0][2:])]
    cases.table(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d in docs:
        words = WORDS.findall(d[1] or "")
        h = zlib.crc32(str(d[0]).encode()) if d[0] is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs, text = brute(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        sha = [hashlib.sha256(t.encode()).hexdigest() for t in (lines, text)]
        want.append((d[0], len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *sha))
    rows = periodic.query(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    assert sum(w[1] for w in want) > 10


def test_empty_table_and_bare_texts(spark):
    assert periodic.periodic_runs(cases.empty(spark)).count() == 0
    bare = [r for r in cases.documents() if not (r[1] or "").strip()]
    rows = periodic.periodic_runs(cases.table(spark, bare)).collect()
    assert len(rows) == len(bare) and all(r.n_words == 0 and r.runs == [] and r.collapsed == "" for r in rows)
