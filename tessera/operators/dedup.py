"""Exact, blocked and near-copy duplicates of facts."""

from __future__ import annotations

import difflib
import functools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from tessera.functions.temporal import overlap
from tessera.sources.scratch import stored

# What two near copies have in common for sure.
PROTECTED_WORDS = frozenset(
    """january february march april may june july august september october november december
    today tomorrow yesterday morning afternoon evening night monday tuesday wednesday thursday friday saturday sunday
    not no never without cannot can't couldn't didn't doesn't don't false hadn't hasn't haven't isn't true shouldn't wasn't weren't won't wouldn't""".split()
)
PLAIN_CAPITALS = frozenset("a an i the this that user".split())
_CHINESE = "大前天 前天 昨天 今天 明天 后天 早晨 早上 上午 中午 下午 傍晚 晚上 凌晨 没有 禁止 不 没 未 无 (?:星期|周)[一二三四五六日天]"

_WORD = re.compile(r"\w+(?:[-']\w+)*")
#: Kinds of atoms and how each is found; the text of an atom is its first group that matched.
_ATOMS = {
    "literal": re.compile(r"(?<![A-Za-z0-9_])(v?\d+(?:\.\d+)+|\d+)(?![A-Za-z0-9_])|((?:[A-Za-z]:\\|/)[^\s\"']+)", re.I),
    "quoted": re.compile(r"\"([^\"\r\n]+)\"|\u201c([^\u201d\r\n]+)\u201d|(?<!\w)'([^'\r\n]+)'(?!\w)"),
    "word": re.compile(r"(\w+(?:[-']\w+)*)"),
    "cjk": re.compile(f"({_CHINESE.replace(' ', '|')})"),
    "name": re.compile(r"(?<![A-Za-z0-9_])([A-Z][A-Za-z0-9_-]{2,})(?![A-Za-z0-9_])"),
}


def exact_groups(rows: DataFrame, key: Column, row_id: str) -> DataFrame:
    """``key, keep, copies``: the least row of each key with several rows."""
    return rows.groupBy(key.alias("key")).agg(F.min(row_id).alias("keep"), F.count("*").alias("copies")).where("copies > 1")


def band_pairs(rows: DataFrame, block: list[str], row_id: str, score: Column, low: float, high: float) -> DataFrame:
    """``left_id, right_id, score`` inside a block with a score in [low, high).

    ``score`` is over columns of aliases a and b. Blocks are keys that few rows share; large groups of equal rows are
    to be folded first.
    """
    a, b = rows.alias("a"), rows.alias("b")
    on = F.col(f"a.{row_id}") < F.col(f"b.{row_id}")
    for k in block:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    pairs = a.join(b, on).select(F.col(f"a.{row_id}").alias("left_id"), F.col(f"b.{row_id}").alias("right_id"), score.alias("score"))
    return pairs.where((F.col("score") >= low) & (F.col("score") < high))


def near_copy_form(text: str) -> str:
    """The words of a text, in one case, without a leading article."""
    words = _WORD.findall(unicodedata.normalize("NFKC", text).casefold())
    return " ".join(words[1:] if words[:1] == ["the"] else words)


def atoms(text: str) -> tuple[str, ...]:
    """Numbers, versions, paths, quotes, protected words and names of a text, in order: near copies have the same."""
    text, found = unicodedata.normalize("NFKC", text), []
    absent = {"word"} if PROTECTED_WORDS.isdisjoint(_WORD.findall(text.casefold())) else set()
    for kind, pattern in _ATOMS.items():
        if kind in absent or kind == "cjk" and text.isascii():
            continue
        for m in pattern.finditer(text):
            atom = next(g for g in m.groups() if g is not None).casefold().strip()
            if kind == "word" and atom not in PROTECTED_WORDS or kind == "name" and atom in PROTECTED_WORDS | PLAIN_CAPITALS or not atom:
                continue
            found.append((m.start(), m.end(), f"{kind}:{atom}"))
    return tuple(a for _, _, a in sorted(found))


def is_near_copy(left: str, right: str, least: float = 0.90) -> bool:
    """Alike in wording, with the same atoms."""
    if not left.strip() or not right.strip() or atoms(left) != atoms(right):
        return False
    a, b = near_copy_form(left), near_copy_form(right)
    if a == b:
        return True
    match = difflib.SequenceMatcher(None, a, b, autojunk=False)
    return match.real_quick_ratio() >= least and match.quick_ratio() >= least and match.ratio() >= least


@F.pandas_udf(BooleanType())
def near_copy(left: pd.Series, right: pd.Series) -> pd.Series:
    """The lexical guard of a near copy; cheaper guards on columns come before it."""
    return pd.Series([a is not None and b is not None and is_near_copy(a, b) for a, b in zip(left, right, strict=True)], dtype=bool)


@F.pandas_udf(StructType([StructField("form", StringType()), StructField("atoms", StringType())]))
def near_copy_key(text: pd.Series) -> pd.DataFrame:
    """What two texts have equal for sure to be near copies (``atoms``), and what is compared then (``form``)."""
    return pd.DataFrame({"form": text.map(near_copy_form), "atoms": text.map(lambda t: "\x1f".join(atoms(t)))})


def _strings(form: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a form's strings of n letters, sorted, and which one of its equals each is (from 0)."""
    c = np.frombuffer(form.encode("utf-32-le", "replace"), np.uint32)
    h = np.zeros(max(len(c) - n + 1, 0), np.uint32)
    for k, by in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)[:n]):
        h ^= c[k : k + len(h)] * np.uint32(by)
    h.sort()
    place = np.arange(len(h))
    fresh = np.append(True, h[1:] != h[:-1])[: len(h)]
    return h, place - np.maximum.accumulate(np.where(fresh, place, 0))


def _grams(forms: list[str]) -> np.ndarray:
    """A row per form: which buckets its three-letter strings fall in, equal ones in different buckets; more for longer forms."""
    letters = sum(map(len, forms)) / max(len(forms), 1)
    bits = 11 if letters < 170 else 12 if letters < 340 else 13
    out = np.zeros((len(forms), 1 << bits), np.float32)
    for row, form in zip(out, forms, strict=True):
        h, equal = _strings(form, 3)
        row[(h * np.uint32(0x27D4EB2F) + equal.astype(np.uint32) * np.uint32(0x9E3779B1)) * np.uint32(0x85EBCA77) >> np.uint32(32 - bits)] = 1
    return out


def alike(left: str, right: str, least: float) -> bool:
    """Whether the ratio of two forms is ``least`` in either order; the longest common subsequence bounds it."""
    if 2 * common_letters(left, right) < least * (len(left) + len(right)) - 1e-6:
        return False
    return any(difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= least for a, b in ((left, right), (right, left)))


def share_enough(left: np.ndarray, right: np.ndarray, total: float, least: float) -> bool:
    """Whether two forms have as many strings of four in common as the ratio needs, 7M - 3T - 3; each counts as often as both have it."""
    need = (3.5 * least - 3) * total - 3 - 1e-6
    if need <= 0 or min(len(left), len(right)) < need:
        return need <= 0
    at = np.minimum(np.searchsorted(left, right), len(left) - 1)
    return np.count_nonzero(left[at] == right) >= need


def _group_links(ids: list[str], forms: list[str], side: np.ndarray, least: float) -> list[tuple[str, str]]:
    """Links among the rows of a group: of side 1 with side 2, or of all if there is only side 0."""
    size, root = np.array([len(f) for f in forms], np.float32), list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    @functools.cache
    def fours(k: int) -> np.ndarray:
        h, equal = _strings(forms[k], 4)
        return h.astype(np.uint64) << np.uint64(32) | equal.astype(np.uint64)

    left, right = (np.flatnonzero(side == k) for k in ((0, 0) if (side == 0).any() else (1, 2)))
    same, found = (side == 0).any(), []
    grams = _grams(forms) if len(ids) > 16 else None
    for block in np.array_split(left, max(1, len(left) // 512)):
        total = size[block, None] + size[right]
        fits = 2 * np.minimum(size[block, None], size[right]) >= least * total - 1e-3
        if grams is not None:
            # A ratio r needs M = rT/2 letters in common, in at most T - 2M + 1 runs, so at least 5M - 2T - 2 equal strings of three.
            lost = grams.sum(1) - size
            fits &= grams[block] @ grams[right].T >= np.maximum(lost[block, None], lost[right]) + (2.5 * least - 2) * total - 1e-3
        for i, j in zip(*np.nonzero(fits), strict=True):
            a, b = int(block[i]), int(right[j])
            if same and a >= b:
                continue
            x, y = find(a), find(b)
            if x != y and share_enough(fours(a), fours(b), float(total[i, j]), least) and alike(forms[a], forms[b], least):
                root[max(x, y)] = min(x, y)
                found.append((min(ids[a], ids[b]), max(ids[a], ids[b])))
    return found


def common_letters(left: str, right: str) -> int:
    """Length of the longest common subsequence, by bits; no ratio counts more."""
    places: dict[str, int] = {}
    for i, c in enumerate(left):
        places[c] = places.get(c, 0) | 1 << i
    every = v = (1 << len(left)) - 1
    for c in right:
        u = v & places.get(c, 0)
        v = (v + u | v - u) & every
    return len(left) - v.bit_count()


def meeting(rows: DataFrame, row_id: str, block_rows: int) -> DataFrame:
    """``rows`` (with ``key`` and ``span``) dealt to groups, so that rows of one key and the same or neighbouring spans meet.

    A key's span is cut at random in blocks of about ``block_rows``, and each pair of blocks is a group: of all its rows
    (``side`` 0), or of those of side 1 with those of side 2. Rows that would meet none are left out.
    """
    parts = rows.groupBy("key", "span").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"), F.count("*").alias("n"))
    beside = lambda by, name: parts.select("key", (F.col("span") + by).alias("span"), F.col("parts").alias(name))
    parts = parts.join(beside(1, "under"), ["key", "span"], "left").join(beside(-1, "over"), ["key", "span"], "left")
    parts = parts.where("n > 1 or under is not null or over is not null").select("key", "span", "parts", "under", "over")
    part, upto = F.pmod(F.xxhash64(row_id), F.col("parts")).cast("int"), lambda n: F.filter(F.sequence(F.lit(0), F.coalesce(n, F.lit(0))), lambda i: i < F.coalesce(n, F.lit(0)))
    place = lambda kind, at, lower, upper, side: F.struct(F.lit(kind).alias("kind"), at.alias("at"), lower.alias("lower"), upper.alias("upper"), side.alias("side"))
    own, span = F.col("part"), F.col("span")
    within = F.transform(upto(F.col("parts")), lambda i: place(0, span, F.least(i, own), F.greatest(i, own), F.when(i == own, 0).when(i > own, 1).otherwise(2)))
    above = F.transform(upto(F.col("over")), lambda i: place(1, span, own, i, F.lit(1)))
    below = F.transform(upto(F.col("under")), lambda i: place(1, span - 1, i, own, F.lit(2)))
    dealt = rows.join(parts, ["key", "span"]).withColumn("part", part).select(*rows.columns, F.explode(F.concat(within, above, below)).alias("p"))
    return dealt.select(F.xxhash64("key", "p.kind", "p.at", "p.lower", "p.upper").alias("group"), F.col("p.side").alias("side"), *rows.columns)


def similar_pairs(vectors: DataFrame, key: str, low: float, high: float, row_id: str = "vec_id", vector: str = "embedding", block_rows: int = 2000) -> DataFrame:
    """``left_id, right_id, score`` of rows of one ``key`` whose cosine is in [low, high), left_id the lesser.

    Unit vectors of a cosine of ``low`` or more are at most r = sqrt(2 - 2 low) apart, and so are their distances to any
    pivot: rows are ringed by their distance to the vector of least hash in steps of r, and only the same and
    neighbouring rings meet, block by block. Null vectors and those with a norm of 0 or without one are left out; scores have six places.
    """
    r = float(np.sqrt(max(2 - 2 * low, 1e-9))) + 1e-6
    rows = vectors.select(F.col(key).cast("string").alias("key"), F.col(row_id).alias("row_id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.withColumn("norm", norm).where("norm > 0 and norm < double('infinity')").select("key", "row_id", F.transform("v", lambda x: x / F.col("norm")).alias("v"))
    rows = stored(rows, "unit-vectors")
    pivot = rows.orderBy(F.xxhash64("row_id"), "row_id").limit(1).select(F.col("v").alias("pivot"))
    apart = F.sqrt(F.aggregate(F.zip_with("v", "pivot", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    ringed = rows.join(F.broadcast(pivot), F.lit(True)).withColumn("span", F.floor(apart / r).cast("int")).drop("pivot")

    def work(rows: list[tuple]) -> list[tuple]:
        ids, side = np.array([h[2] for h in rows]), np.array([h[1] for h in rows])
        v, found = np.array([h[3] for h in rows], np.float64), []
        left, right = (np.flatnonzero(side == k) for k in ((0, 0) if (side == 0).any() else (1, 2)))
        for block in np.array_split(left, max(1, len(left) // 512)):
            scores = np.round(v[block] @ v[right].T, 6)
            for i, j in zip(*np.nonzero((scores >= low) & (scores < high)), strict=True):
                a, b = int(ids[block[i]]), int(ids[right[j]])
                if a < b or (side == 1).any() and a != b:
                    found.append((min(a, b), max(a, b), float(scores[i, j])))
        return found

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in grouped(batches, work):
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["left_id", "right_id", "score"])

    dealt = meeting(ringed, "row_id", block_rows).select("group", "side", "row_id", "v")
    return dealt.repartition("group").sortWithinPartitions("group", "row_id").mapInArrow(compare, "left_id long, right_id long, score double")


def grouped(batches: Iterator[pa.RecordBatch], work) -> Iterator[list]:
    """What ``work`` makes of each group of rows, of a stream sorted by its first column; the open group is held."""
    held: list[tuple] = []
    for batch in batches:
        found: list = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][0] != row[0]:
                found += work(held) if len(held) > 1 else []
                held = []
            held.append(row)
        yield found
    yield work(held) if len(held) > 1 else []


def near_copy_links(lines: DataFrame, block_rows: int = 2000, least: float = 0.90) -> DataFrame:
    """``left_id, right_id``: links whose classes are those of all near copies among ``lines`` (``line_id, line``).

    Lines of one form and the same atoms are linked to the least of them. Near copies have the same atoms and their lengths
    differ by (2 - r) / r at most, so the others meet where atoms are equal and lengths fall in one range or two
    neighbouring ones. What meets is cut in blocks of about ``block_rows``, and each pair of blocks is a group of its own, so that a
    frequent key is many tasks; most groups are a few lines, and a task compares many of them. Work grows with the
    square of the lines that share atoms and length.
    """
    keyed = stored(lines.where("trim(line) <> ''").select("line_id", near_copy_key("line").alias("k")).select("line_id", "k.form", "k.atoms"), "near-copy-keys")
    firsts = stored(keyed.groupBy("form", "atoms").agg(F.min("line_id").alias("line_id")), "near-copy-firsts")
    equal = keyed.withColumnRenamed("line_id", "right_id").join(firsts.withColumnRenamed("line_id", "left_id"), ["form", "atoms"]).where("left_id <> right_id").select("left_id", "right_id")

    step = float(np.log((2 - least) / least + 1e-4))
    ranged = firsts.where("form <> ''").select("line_id", "form", F.md5("atoms").alias("key"), F.floor(F.log(F.length("form").cast("double")) / step).cast("int").alias("span"))
    dealt = meeting(ranged, "line_id", block_rows).select("group", "side", "line_id", "form")

    def links(rows: list[tuple]) -> list[tuple[str, str]]:
        return _group_links([h[2] for h in rows], [h[3] for h in rows], np.array([h[1] for h in rows]), least)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in grouped(batches, links):
            yield _pairs(found)

    near = dealt.repartition("group").sortWithinPartitions("group", "line_id").mapInArrow(compare, "left_id string, right_id string")
    return equal.unionByName(near.distinct())


def _pairs(found: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], names=["left_id", "right_id"])


def term_cosine(left: str, right: str) -> float:
    """The cosine of the counts of two texts' words."""
    a, b = (Counter(near_copy_form(t).split()) for t in (left, right))
    norm = math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))
    return sum(n * b[w] for w, n in a.items()) / norm if norm else 0.0


def folded(items: list[tuple], pairs: list[tuple], least: float) -> list[list]:
    """Ranked items (id, text) as lists of ids, the one that stays first.

    Confirmed pairs whose texts are near copies are united; then each item in turn goes to the one that stays of its set, or
    to the first that stays and is a near copy of it. Near copies are alike by the cosine of their words, too.
    """
    texts, root = dict(items), {i: i for i, _ in items}
    near = lambda a, b: term_cosine(texts[a], texts[b]) >= least and (is_near_copy(texts[a], texts[b]) or is_near_copy(texts[b], texts[a]))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in pairs:
        if a in root and b in root and find(a) != find(b) and near(a, b):
            root[find(b)] = find(a)
    stays: dict = {}
    out: dict = {}
    for i, _ in items:
        own = find(i)
        if own not in stays:
            stays[own] = next((k for k in out if near(i, k)), i)
        out.setdefault(stays[own], []).append(i)
    return list(out.values())


def fold_near(rows: DataFrame, pairs: DataFrame | None = None, least: float = 0.82) -> DataFrame:
    """``query_id, rank, doc_id, folded, members`` of ranked results (``query_id, rank, doc_id, text``), a bounded number a query.

    ``pairs`` (``left_id, right_id``) are confirmed; of them, those within a query's results count. Null texts fold with nothing.
    """
    items = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "text"))).alias("items"))
    if pairs is not None:
        both = rows.select("query_id", F.col("doc_id").alias("left_id")).join(pairs, "left_id").join(rows.select("query_id", F.col("doc_id").alias("right_id")), ["query_id", "right_id"])
        known = both.groupBy("query_id").agg(F.sort_array(F.collect_set(F.struct("left_id", "right_id"))).alias("pairs"))
        items = items.join(known, "query_id", "left")
    else:
        items = items.withColumn("pairs", F.array().cast("array<struct<left_id: bigint, right_id: bigint>>"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for q, ranked, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rank = {r["doc_id"]: r["rank"] for r in ranked}
                for ids in folded([(r["doc_id"], r["text"] or "") for r in ranked], [(p["left_id"], p["right_id"]) for p in known or ()], least):
                    out.append((q, rank[ids[0]], ids[0], len(ids) - 1, ids))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["query_id", "rank", "doc_id", "folded", "members"])

    return items.select("query_id", "items", "pairs").mapInArrow(fold, "query_id long, rank long, doc_id long, folded long, members array<long>")


def entity(name: str | None) -> str:
    return " ".join(unicodedata.normalize("NFKC", name or "").casefold().split())


def mentions(value: str, entities: tuple[str, ...]) -> tuple[str, ...]:
    """Which entities a value names, in the order and as often as it does; ASCII names only as whole words."""
    value, found = unicodedata.normalize("NFKC", value).casefold(), set()
    for name in entities:
        plain = unicodedata.normalize("NFKC", name).casefold().strip()
        if plain:
            edge = lambda c, side: side if re.match("[a-z0-9_]", c) else ""
            pattern = edge(plain[0], "(?<![A-Za-z0-9_])") + re.escape(plain) + edge(plain[-1], "(?![A-Za-z0-9_])")
            found |= {(m.start(), m.end(), name) for m in re.finditer(pattern, value)}
    return tuple(name for _, _, name in sorted(found))


def projected(left: str, right: str, left_value: str, right_value: str) -> tuple[str, str] | None:
    """The subjects ``user`` and ``user's X`` as one, if both values name X."""
    user, other = (left, right) if left == "user" else (right, left)
    if user != "user" or not other.startswith("user's "):
        return None
    words = near_copy_form(other.removeprefix("user's ")).split()
    both = set(near_copy_form(left_value).split()) & set(near_copy_form(right_value).split())
    return (user, other) if words and both.issuperset(words) else None


def same_fact(subjects: tuple, values: tuple, entities: tuple, differ: bool, least: float = 0.90) -> bool:
    """Whether two values are near copies that speak of the same: subjects and named entities agree as well.

    With ``differ``, a user's projection may stand for the user. Entities are the same and named alike, or, between such
    subjects, are only these two and hold each its own subject.
    """
    if any(v is None for v in values):
        return False
    a, b = map(entity, subjects)
    pair = None
    if a != b:
        pair = projected(a, b, *values) if differ else None
        if pair is None:
            return False
    x, y = (tuple(sorted({entity(e) for e in es if e is not None})) if es is not None else () for es in entities)
    if x == y:
        if mentions(values[0], x) != mentions(values[1], y):
            return False
    elif pair is None or not x or not y or not {*x, *y} <= {*pair} or a not in x or b not in y:
        return False
    return is_near_copy(*values, least) or is_near_copy(*values[::-1], least)


def safe_near_duplicate(similarity: Column, least: float = 0.82, differ: bool = False) -> Column:
    """Whether rows of aliases a and b are one fact beyond doubt, by cheap signs first.

    Rows have ``status, namespace, subject, predicate, slot, attribute, qualifiers`` (a map), ``valid_from, valid_to, entities`` and
    ``value``. Both are alike by ``similarity``; neither is disputed; what says where and of what they hold is the same, nulls
    included; their times overlap; and ``same_fact`` holds.
    """
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    same = lambda c: a(c).eqNullSafe(b(c))
    listed = lambda q: F.sort_array(F.map_entries(F.coalesce(q, F.create_map().cast("map<string,string>"))))

    @F.pandas_udf(BooleanType())
    def speak_of_one(sa: pd.Series, sb: pd.Series, va: pd.Series, vb: pd.Series, ea: pd.Series, eb: pd.Series) -> pd.Series:
        return pd.Series([same_fact((p, q), (v, w), (x, y), differ) for p, q, v, w, x, y in zip(sa, sb, va, vb, ea, eb, strict=True)], dtype=bool)

    cheap = (similarity >= least) & (F.coalesce(a("status"), F.lit("active")) != "disputed") & (F.coalesce(b("status"), F.lit("active")) != "disputed")
    for c in ("namespace", "predicate", "slot", "attribute"):
        cheap = cheap & same(c)
    cheap = cheap & (listed(a("qualifiers")) == listed(b("qualifiers"))) & overlap(a("valid_from"), a("valid_to"), b("valid_from"), b("valid_to"))
    return cheap & speak_of_one(a("subject"), b("subject"), a("value"), b("value"), a("entities"), b("entities"))


def mutually_exclusive(slot_a: Column, slot_b: Column, value_a: Column, value_b: Column, exclusive: tuple[str, ...]) -> Column:
    """Whether two values cannot both hold: they differ, in one slot that holds one at a time."""
    return F.coalesce((slot_a == slot_b) & slot_a.isin(*exclusive), F.lit(False)) & ~value_a.eqNullSafe(value_b)


def write_search(new: DataFrame, held: DataFrame, cosine: Column, nearest: DataFrame, least: float = 0.82) -> DataFrame:
    """``new_id, id, outcome`` for each row of ``new`` (``id, key, value, embedding``) among those of ``held`` with its key.

    ``exact``: the least id of the same value; else ``near_duplicate``: of near copies with a cosine of ``least`` or more,
    the nearest; else ``semantic_candidate``: the nearest of all (``nearest``: ``new_id, id, score``), if that near; else ``new``.
    ``cosine`` is over the embeddings of aliases n and h.
    """
    value = lambda df: df.withColumn("hash", F.sha2(F.coalesce("value", F.lit("")), 256))
    n, h = value(new), value(held)
    exact = n.join(h.select("key", "hash", F.col("id").alias("of")), ["key", "hash"]).groupBy("id").agg(F.min("of").alias("exact"))
    marked = lambda df: df.where("trim(value) <> ''").withColumn("atoms", near_copy_key("value")["atoms"])
    pairs = marked(new).alias("n").join(marked(held).alias("h"), (F.col("n.key") == F.col("h.key")) & (F.col("n.atoms") == F.col("h.atoms")))
    pairs = pairs.select(F.col("n.id").alias("id"), F.col("h.id").alias("of"), cosine.alias("score"), F.col("n.value").alias("a"), F.col("h.value").alias("b")).where(F.col("score") >= least)
    near = pairs.where(near_copy(F.col("a"), F.col("b"))).groupBy("id").agg(F.min_by("of", F.struct(-F.col("score"), "of")).alias("near"))
    best = nearest.where(F.col("score") >= least).groupBy(F.col("new_id").alias("id")).agg(F.min_by(nearest["id"], F.struct(-F.col("score"), nearest["id"])).alias("semantic"))
    found = new.select("id").join(exact, "id", "left").join(near, "id", "left").join(best, "id", "left")
    outcome = F.when(F.col("exact").isNotNull(), "exact").when(F.col("near").isNotNull(), "near_duplicate").when(F.col("semantic").isNotNull(), "semantic_candidate").otherwise("new")
    return found.select(F.col("id").alias("new_id"), F.coalesce("exact", "near", "semantic").alias("id"), outcome.alias("outcome"))


def resolve(same_value: Column, same_time: Column, newer: Column, exclusive: Column) -> Column:
    """What a new fact is to an existing one of its conflict key."""
    return F.when(same_value, "entails").when(~exclusive, "compatible").when(newer, "state_change").when(same_time, "contradicts").otherwise("uncertain")


def group_outcome(outcome: Column, active: Column) -> Column:
    """One answer for a group: what all members say, unless more than one is active."""
    every = F.collect_set(outcome)
    return F.when((F.size(every) == 1) & (F.count_if(active) <= 1), every[0]).otherwise("uncertain")
