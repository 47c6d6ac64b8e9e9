import json
import random
import re

from pyspark.sql import functions as F

from tessera.functions.text import canonical_json
from tessera.operators import splitting


def offset(text, lines):
    if len(text) < 2:
        return None
    ends = [m.end() for m in re.finditer("\n" if lines else r"\n\s*\n|\n|(?<=[。！？!?；;])", text)]
    if not lines:
        ends = [e for e in ends if 0 < e < len(text)]
    mid = len(text) // 2
    return min(ends, key=lambda e: abs(e - mid)) if ends else None if lines else mid


def pieces(text, target, depth, lines):
    at = offset(text, lines) if len(text) > target and depth else None
    return [text] if at is None else pieces(text[:at], target, depth - 1, lines) + pieces(text[at:], target, depth - 1, lines)


def texts():
    rng = random.Random(6)
    marks = ["a", "bc ", "word ", ".", "!", "?", "!\n", "\n", "\n  \n", "\n\n\n", "。", "；", "é", "🙂"]
    return ["", "a", "ab", "\n", "\n\n", "a\n", "!!", None, "x" * 90] + ["".join(rng.choice(marks) for _ in range(rng.randrange(1, 120))) for _ in range(150)]


def test_bisection_follows_the_boundaries(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "i int, text string")
    for lines in (False, True):
        for target, depth in ((20, 3), (5, 2), (50, 1)):
            got = {r.i: r.p for r in df.select("i", splitting.bisected(F.col("text"), target, depth, lines).alias("p")).collect()}
            for i, t in rows:
                assert got[i] == (None if t is None else pieces(t, target, depth, lines)), (t, target, depth, lines)


def test_pieces_fit_their_json(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice('abc"\\\n\t\x01é🙂 ') for _ in range(rng.randrange(0, 80)))) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, text string")
    for room in (6, 13):
        got = {r.i: r.p for r in df.select("i", splitting.fitted(F.col("text"), F.lit(room)).alias("p")).collect()}
        for i, t in rows:
            size = lambda x: len(json.dumps(x, ensure_ascii=False)) - 2
            assert "".join(got[i]) == t and all(size(p) <= room for p in got[i])
            assert all(size(a + b[0]) > room for a, b in zip(got[i], got[i][1:], strict=False))
    assert df.select(splitting.fitted(F.lit("a\x01"), F.lit(5)).alias("p")).first().p is None


def test_canonical_json(spark):
    rows = ['{"b": 1, "A": {"y": [" X ", 1.50, null], "x": true}}', '[3, {"K": "ﬁ"}]', "broken", None, '{"a": 1, "a": 2}', '" Ab "']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = [r.c for r in df.select("i", canonical_json("t").alias("c")).orderBy("i").collect()]
    assert got == ['{"A":{"x":true,"y":["x",1.5,null]},"b":1}', '[3,{"K":"fi"}]', None, None, '{"a":2}', '"ab"']
