"""Small tables with the cases every operator must stand: nulls, empties, ties, repeated rows, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score double, keep_id string, part string, node long"


def prose(rng, n, words=None):
    words = words or [a + b for a in ("ba", "ke", "lo", "mi", "nu", "ra", "ste", "vo") for b in ("n", "rt", "sh", "l", "ck", "me", "ti")]
    return " ".join(rng.choice(words) for _ in range(n))


def documents(n=60, seed=3):
    """About ``n`` rows: prose, exact and near copies, shared passages and lines, and the odd cases."""
    rng = random.Random(seed)
    rows, base, passage = [], prose(rng, 120), prose(rng, 70)
    for i in range(n):
        kind = i % 6
        if kind == 0:
            words = base.split(" ")
            words[rng.randrange(len(words))] = f"edit{i}"
            text = " ".join(words)
        elif kind == 1:
            text = base if i % 12 == 1 else base.replace(" ", "\t\n ", 3)
        elif kind == 2:
            text = prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 30)
        elif kind == 3:
            text = "Licensed under CC BY 4.0.\n" + prose(rng, rng.randrange(1, 60)) + "\nAll rights reserved."
        else:
            text = prose(rng, rng.randrange(1, 90))
        rows.append((i, text, "en", f"src{i % 13}" if i % 3 else "src0"))
    rows += [(n, None, None, None), (n + 1, "", "en", None), (n + 2, " \t\n ", "en", "src1"), (n + 3, "one", "en", "src2"), (n + 4, "two words", "en", "src2"), (n + 5, "TWO  Words", "en", "src3")]
    rows += [(n + 6, prose(rng, 20_000), "en", "src4"), (n + 7, "z" * 3000, "en", "src5"), (n + 8, "é日本🙂" * 120, "xx", "src6")]
    rows += [rows[0], rows[4]]
    return [(*r, None if r[1] is None else len(r[1]), 1, 0.5, "x", "y", 9) for r in rows]


def table(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
