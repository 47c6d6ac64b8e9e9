"""Periodic runs of words by internal pattern matching over suffix arrays and wavelet matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import WORD, table, text_slices
from tessera.llm.shingles import word_spans

#: Bytes of texts whose words share a suffix array; a longer text has one of its own.
SLICE = 250_000
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class Suffixes:
    """The suffix array of a word sequence, and the classes of its factors of 1, 2, 4, ... ``longest`` words.

    ``classes[k][i]`` is the first place in the suffix array of those suffixes that begin with the 2 ** k words at i, so
    it names that factor and, with the next class, its interval. Prefix doubling sorts only what is not yet alone.
    """

    def __init__(self, words: np.ndarray, longest: int):
        n = len(words)
        self.order = np.argsort(words, kind="stable")
        ranked = words[self.order]
        fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        self.classes = [np.empty(n, np.int32)]
        self.classes[0][self.order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        while 2 ** len(self.classes) <= longest:
            half, own = 2 ** (len(self.classes) - 1), self.classes[-1]
            after = np.full(n, -1, np.int32)
            after[: n - half] = own[half:]
            place = np.flatnonzero(np.bincount(own, minlength=n)[own[self.order]] > 1)
            open_ = self.order[place]
            key = own[open_].astype(np.int64) * (n + 1) + after[open_] + 1
            by = np.argsort(key, kind="stable")
            open_, key = open_[by], key[by]
            self.order[place] = open_
            fresh = np.ones(len(key), bool)
            fresh[1:] = key[1:] != key[:-1]
            new = own.copy()
            if len(key):
                new[open_] = place[fresh][np.cumsum(fresh) - 1]
            self.classes.append(new)

    def common(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from a and b on, or before a and b, are the same."""
        n, length = len(self.order), np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.classes))):
            going = np.arange(len(a))
            while len(going):
                step = -(length[going] + 2**k) if back else length[going]
                x, y = a[going] + step, b[going] + step
                inside = (x >= 0) & (y >= 0) & (x < n) & (y < n)
                going, x, y = going[inside], x[inside], y[inside]
                going = going[self.classes[k][x] == self.classes[k][y]]
                length[going] += 2**k
                if k + 1 < len(self.classes):
                    break
        return length


class Wavelet:
    """A wavelet matrix over numbers below their count: order statistics of any interval, for many at a time."""

    def __init__(self, values: np.ndarray):
        self.zeros: list[tuple[int, np.ndarray]] = []
        values = values.astype(np.int32)
        for bit in reversed(range(len(values).bit_length())):
            one = (values >> bit & 1).astype(bool)
            self.zeros.append((bit, np.concatenate([np.zeros(1, np.int32), np.cumsum(~one, dtype=np.int32)])))
            values = np.concatenate([values[~one], values[one]])

    def below(self, left: np.ndarray, right: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many numbers of each interval are less than x."""
        found = np.zeros(len(x), np.int32)
        for bit, zeros in self.zeros:
            a, b, one = zeros[left], zeros[right], (x >> bit & 1).astype(bool)
            found += np.where(one, b - a, 0)
            left, right = np.where(one, zeros[-1] + left - a, a), np.where(one, zeros[-1] + right - b, b)
        return found

    def nth(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th least number of each interval, from 0."""
        value = np.zeros(len(k), np.int32)
        for bit, zeros in self.zeros:
            a, b = zeros[left], zeros[right]
            one = k >= b - a
            value |= one.astype(np.int32) << np.int32(bit)
            k = np.where(one, k - (b - a), k)
            left, right = np.where(one, zeros[-1] + left - a, a), np.where(one, zeros[-1] + right - b, b)
        return value


def nearest_same(words: np.ndarray) -> np.ndarray:
    """How far from each place the same word is next, before or after it. A block in a run has all its words that near."""
    order = np.argsort(words, kind="stable")
    step = np.full(len(words) + 1, len(words), np.int64)
    step[1:-1] = np.where(words[order[1:]] == words[order[:-1]], np.diff(order), len(words))
    gap = np.empty(len(words), np.int64)
    gap[order] = np.minimum(step[1:], step[:-1])
    return gap


def find_runs(words: np.ndarray, longest: int, least: int, exponent: int) -> np.ndarray:
    """Rows (start, length, period) of all runs in ``words``, whose texts end with words of their own.

    A run of period q and length 4 q or more covers a dyadic block: B words from a multiple of B on, for the power of two
    B with q <= B < 2 q, and the block's copy q words before or after it as well. Inside the run a block of B >= q words has
    no nearer copy, or q were not the least period. So the occurrences of each block within B words, which form a
    progression, give their difference as the candidate period, and extending the match both ways gives the run.
    """
    if len(words) < 2:
        return np.zeros((0, 3), np.int64)
    suffixes = Suffixes(words, max(longest // 2, 1))
    tree = Wavelet(suffixes.order)
    found = []
    gap = nearest_same(words)
    for k, classes in enumerate(suffixes.classes):
        block = 2**k
        at = np.arange(0, len(words) - block + 1, block, dtype=np.int32)
        many = np.bincount(classes, minlength=len(words)).astype(np.int32)
        at = at[(gap[at] <= block) & (gap[at + block // 2] <= block) & (gap[at + block - 1] <= block) & (many[classes[at]] > 1)]
        left = classes[at]
        right = left + many[left]
        upto = tree.below(left, right, at + 1)
        for some, nth in ((upto < right - left, upto), (upto > 1, upto - 2)):
            here = at[some]
            other = tree.nth(left[some], right[some], nth[some])
            near = np.abs(other - here) <= block
            found.append(np.stack([np.minimum(here, other)[near], np.abs(other - here)[near]], axis=1))
    pairs = np.unique(np.concatenate(found), axis=0)
    a, period = pairs.astype(np.int64).T
    start = a - suffixes.common(a, a + period, back=True)
    length = a + suffixes.common(a, a + period) + period - start
    runs = np.stack([start, length, period], axis=1)[length >= np.maximum(least, exponent * period)]
    return np.unique(runs, axis=0)


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row of ``docs``.

    A run is a stretch of consecutive words with least period q (words q apart are the same) and at least ``least`` and
    ``exponent`` * q words that no neighbouring word extends; runs are (start, length, period), words numbered from 0, by
    start, then period. ``collapsed`` has the words that no run contains after its first q words, joined by one space.
    Words are told apart as they are. Whole texts are read, a slice of many at a time, each by its own task's memory of
    some 200 bytes a word; nothing is shuffled. Null, empty and blank texts have no words, no runs and collapse to an empty text;
    repeated rows and ids are rows like others; null ids stay; other columns are not read; no rows, no result.
    Exponents below 4 are refused, as a shorter run need not cover a block and its copy.
    """
    if exponent < 4:
        raise ValueError("runs of less than four periods are not looked for")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, ends in text_slices(batch.column(1), SLICE):
                yield _slice(batch.column(0).slice(first, end - first), raw, ends, least, exponent)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(compute, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")


def _slice(ids: pa.Array, raw: np.ndarray, ends: np.ndarray, least: int, exponent: int) -> pa.RecordBatch:
    a, b, words, upto = word_spans(raw, ends)
    n, docs = np.diff(upto), len(ids)
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(docs), n)
    # Each text is followed by a word of its own, so that no match goes on into the next.
    line = np.empty(len(codes) + docs, np.int64)
    line[np.arange(len(codes)) + row] = codes
    line[upto[1:] + np.arange(docs)] = len(codes) + np.arange(docs)
    runs = find_runs(line, int(n.max(initial=0)), least, exponent)
    of = np.searchsorted(upto[1:] + np.arange(docs), runs[:, 0])
    whole = runs[:, 0] - of

    edges = lambda ups, downs, n: np.cumsum(np.bincount(ups, minlength=n) - np.bincount(downs, minlength=n))[: n - 1]
    kept = np.flatnonzero(edges(whole + runs[:, 2], whole + runs[:, 1], len(codes) + 1) == 0)
    last = np.ones(len(kept), bool)
    last[:-1] = row[kept[1:]] != row[kept[:-1]]
    raw = raw.copy()
    raw[b[kept[~last]]] = 32
    cover = edges(a[kept], b[kept] + ~last, len(raw) + 1) > 0
    size = np.bincount(row[kept], weights=b[kept] - a[kept] + ~last, minlength=docs).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    text = pa.Array.from_buffers(pa.string(), docs, [None, pa.py_buffer(at), pa.py_buffer(raw[cover])])

    fields = [pa.array(c) for c in (whole - upto[of], runs[:, 1], runs[:, 2])]
    at = np.searchsorted(of, np.arange(docs + 1)).astype(np.int32)
    listed = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    return pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), listed, text], names=["doc_id", "n_words", "runs", "collapsed"])


def looped(doc_id: Column, text: Column) -> Column:
    """The text that the query reads: where the id's checksum ends in 0, its words from some place on repeat."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def again(w: Column) -> Column:
        a = g % F.size(w)
        p = 1 + F.floor((F.size(w) - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    # An array of one text, so that its words are split once, and only where they are asked for.
    words = F.transform(F.array(text), lambda t: F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
    edited = F.transform(words, again)[0]
    return F.when((h % 10 == 0) & text.isNotNull(), edited).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
