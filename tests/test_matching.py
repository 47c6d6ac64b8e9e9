import difflib
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import evidence
from tessera.functions.vector import cosine
from tessera.operators import dedup


def plain_holds(quote, text):
    def bare(t):
        t = unicodedata.normalize("NFKC", t or "").casefold()
        return "".join(c for c in t if not c.isspace() and (c in "./:\\-_" or not unicodedata.category(c).startswith(("P", "Z"))))

    q, s = bare(quote), bare(text)
    if not q or not s or q in s:
        return bool(q and s)
    numbers = lambda t: re.findall(r"\d+(?:[.:/-]\d+)*", t)
    near = lambda w: numbers(q) == numbers(w) and difflib.SequenceMatcher(None, q, w, autojunk=False).ratio() >= 0.8
    if len(q) < 6:
        return False
    if len(q) >= len(s):
        return near(s)
    starts = [*range(0, len(s) - len(q) + 1, max(1, len(q) // 8)), len(s) - len(q)]
    return any(near(s[k : k + len(q)]) for k in starts)


def test_quotes_as_every_window_says(spark):
    rng = random.Random(4)
    words = "the service on port 8080 of node-1 runs v1.2.3 slow cache disk under /etc/app theme dark über 日本 10:30".split()
    rows = [(None, "x"), ("x", None), ("", "abc"), ("...", "abc"), ("abc", "ab"), ("Port 80!", "the port, 80"), ("port 8081", "the port 8080"), ("abcdefgh", "abcdefg")]
    for _ in range(250):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(3, 60)))
        k = rng.randrange(len(text))
        quote = list(text[k : k + rng.randrange(4, 80)])
        for _ in range(rng.randrange(0, 1 + len(quote) // 3)):
            quote[rng.randrange(len(quote))] = rng.choice(["", "q", "x1", "."])
        rows.append(("".join(quote), text))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, quote string, text string")
    got = [r.held for r in df.select("i", evidence.quoted_in("quote", "text").alias("held")).orderBy("i").collect()]
    assert got == [plain_holds(*r) for r in rows] and 40 < sum(got) < 230


def test_near_ends_is_the_edit_table():
    rng = random.Random(1)
    for _ in range(60):
        q, s = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(2))
        row = list(range(len(q) + 1))
        want = []
        for c in s:
            new = [0]
            for i, x in enumerate(q, 1):
                new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != c)))
            row = new
            want.append(row[-1])
        for most in range(4):
            assert evidence.near_ends(q, s, most) == [w <= most for w in want]


def test_folding_takes_copies_with_other_spaces_and_near_copies(spark):
    long = "the cache of every node is written to the same disk before the service starts again after a fault"
    rows = [(1, 1, 10, long), (1, 2, 11, long.replace(" ", "  ")), (1, 3, 12, "something else"), (1, 4, 13, long.replace("fault", "faults")), (1, 5, 14, long + " on 8080"), (1, 6, 15, None), (1, 7, 16, None)]
    rows += [(2, 1, 12, "something else"), (2, 2, 10, long), (2, 3, 20, "something  else")]
    df = spark.createDataFrame(rows, "query_id long, rank long, doc_id long, text string")
    for pairs in (None, spark.createDataFrame([(10, 11), (12, 14), (20, 99)], "left_id long, right_id long")):
        got = sorted((r.query_id, r["rank"], r.doc_id, r.folded, r.members) for r in dedup.fold_near(df, pairs).collect())
        assert got == [(1, 1, 10, 2, [10, 11, 13]), (1, 3, 12, 0, [12]), (1, 5, 14, 0, [14]), (1, 6, 15, 0, [15]), (1, 7, 16, 0, [16]), (2, 1, 12, 1, [12, 20]), (2, 2, 10, 0, [10])]


def test_every_write_has_an_outcome(spark):
    text = "the cache of every node is written to the same disk before it starts"
    v = {"x": [1.0, 0.0], "y": [0.0, 1.0], "xy": [1.0, 0.1]}
    held = [(1, "a", text, v["x"]), (2, "a", text, v["y"]), (3, "a", text + "s", v["x"]), (4, "a", "other", v["xy"]), (5, "b", text, v["x"]), (6, "a", None, v["x"])]
    new = [(10, "a", text, v["y"]), (11, "a", text + "ss", v["xy"]), (12, "a", "fresh", v["x"]), (13, "a", "fresh", [-1.0, 0.0]), (14, "c", text, v["x"]), (15, "a", text + " 1", v["y"])]
    h, n = (spark.createDataFrame(r, "id long, key string, value string, embedding array<double>") for r in (held, new))
    pairs = dedup.similar_pairs(h.unionByName(n), "key", 0.82, 2.0, "id")
    nearest = pairs.select(F.col("right_id").alias("new_id"), F.col("left_id").alias("id"), "score").where("new_id >= 10 and id < 10")
    got = {r.new_id: (r.id, r.outcome) for r in dedup.write_search(n, h, cosine(F.col("n.embedding"), F.col("h.embedding")), nearest).collect()}
    assert got == {10: (1, "exact"), 11: (1, "near_duplicate"), 12: (1, "semantic_candidate"), 13: (None, "new"), 14: (None, "new"), 15: (2, "semantic_candidate")}


@pytest.mark.parametrize("block_rows", [2000, 9])
def test_similar_pairs_as_all_pairs(spark, block_rows):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(120, 4))
    rows = [(i, f"k{i % 3}", [float(x) for x in v[i]]) for i in range(120)] + [(200, "k0", None), (201, "k0", [0.0] * 4), (202, "k1", [float("nan")] * 4), (203, "k2", [float(x) for x in v[2]])]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").repartition(3)
    v = np.vstack([v, v[2]])
    ids = [*range(120), 203]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    for low, high in ((0.9, 2.0), (0.3, 0.7), (-1.0, 0.0)):
        got = sorted((r.left_id, r.right_id) for r in dedup.similar_pairs(df, "label", low, high, block_rows=block_rows).collect())
        label = lambda i: 2 if i == 203 else i % 3
        assert got == [(a, b) for x, a in enumerate(ids) for y, b in enumerate(ids) if a < b and label(a) == label(b) and low <= s[x, y] < high]


FACT = "namespace string, subject string, predicate string, slot string, attribute string, qualifiers map<string,string>, status string, valid_from int, valid_to int, entities array<string>, value string"
TEXT = "the billing service of the user's laptop writes its logs to the shared disk every night"


def fact(**other):
    base = {"namespace": "n", "subject": "User", "predicate": "runs", "slot": None, "attribute": "x", "qualifiers": {"k": "v"}, "status": None, "valid_from": 1, "valid_to": None, "entities": ["billing"], "value": TEXT}
    return tuple((base | other).values())


def test_each_guard_alone_keeps_facts_apart(spark):
    pairs = [
        (fact(), fact(), 0.9, False, True),
        (fact(), fact(value=TEXT.replace("writes", "write"), subject=" user ", qualifiers={"k": "v"}), 0.82, False, True),
        (fact(), fact(), 0.81, False, False),
        (fact(status="disputed"), fact(), 1.0, False, False),
        (fact(), fact(namespace="m"), 1.0, False, False),
        (fact(), fact(subject="other"), 1.0, True, False),
        (fact(), fact(predicate="uses"), 1.0, False, False),
        (fact(slot="s"), fact(), 1.0, False, False),
        (fact(), fact(attribute=None), 1.0, False, False),
        (fact(), fact(qualifiers=None), 1.0, False, False),
        (fact(qualifiers=None), fact(qualifiers={}), 1.0, False, True),
        (fact(valid_to=5), fact(valid_from=5), 1.0, False, False),
        (fact(valid_to=6), fact(valid_from=5), 1.0, False, True),
        (fact(), fact(entities=["laptop"]), 1.0, False, False),
        (fact(entities=["billing", "laptop"]), fact(entities=["Laptop", "billing"], value=TEXT.replace("laptop", "laptops")), 1.0, False, False),
        (fact(), fact(value=TEXT + " on 8080"), 1.0, False, False),
        (fact(), fact(value=TEXT[::-1]), 1.0, False, False),
        (fact(), fact(value=None), 1.0, False, False),
        (fact(), fact(subject="user's laptop"), 1.0, False, False),
        (fact(), fact(subject="user's laptop"), 1.0, True, True),
        (fact(), fact(subject="user's phone"), 1.0, True, False),
        (fact(entities=["user"]), fact(subject="user's laptop", entities=["user's laptop"]), 1.0, True, True),
        (fact(entities=["disk"]), fact(subject="user's laptop", entities=["user's laptop"]), 1.0, True, False),
    ]
    for differ in (False, True):
        rows = [(i, a, b, s) for i, (a, b, s, d, _) in enumerate(pairs) if d == differ]
        df = spark.createDataFrame(rows, f"i int, a struct<{FACT.replace(' ', ': ').replace(',: ', ', ')}>, b struct<{FACT.replace(' ', ': ').replace(',: ', ', ')}>, s double")
        got = {r.i: r.ok for r in df.select("i", dedup.safe_near_duplicate(F.col("s"), differ=differ).alias("ok")).collect()}
        assert got == {i: pairs[i][4] for i, *_ in rows}
    one = df.select(dedup.mutually_exclusive(F.lit("p"), F.lit("p"), F.lit(1), F.lit(2), ("p",)), dedup.mutually_exclusive(F.lit("p"), F.lit("p"), F.lit(1), F.lit(1), ("p",)), dedup.mutually_exclusive(F.lit("q"), F.lit("q"), F.lit(1), F.lit(2), ("p",)), dedup.mutually_exclusive(F.lit(None).cast("string"), F.lit("p"), F.lit(1), F.lit(2), ("p",))).first()
    assert tuple(one) == (True, False, False, False)


def test_strings_count_as_often_as_both_lines_have_them(monkeypatch):
    forms = ["abcde " * 80 + "vwxyz " * 5, "abcde " * 5 + "vwxyz " * 80]
    monkeypatch.setattr(dedup, "common_letters", lambda *_: pytest.fail("compared letter by letter"))
    assert dedup._group_links(["a", "b"], forms, np.zeros(2, int), 0.9) == []
