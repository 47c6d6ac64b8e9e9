"""Repeated byte windows by a depth-limited radix sort of suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import row_id, stored, table, text_slices
from tessera.llm.shingles import mixed, powers, prefix_hashes

#: Bytes of the sample string inside a window that is the first digit of the radix sort.
GRAM = 24
#: Places of the anchor in a window that share one digit, pass by pass; the last pass looks at windows.
WIDTHS = (30, 6, 1)
_U = np.uint64
_PLACE = _U((1 << 22) - 1)


def _digest(data: bytes, name: bytes) -> bytes:
    """128 keyed bits that stand for bytes in a place; nothing else is taken for equality."""
    return hashlib.blake2b(data, digest_size=16, key=name).digest()


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, from running minima of blocks."""
    n = len(v) - width + 1
    padded = np.full(-(-len(v) // width) * width, np.uint64(2**64 - 1))
    padded[: len(v)] = v
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(raw: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows with one anchor: row, first start, length, the anchor's offset, digit, signature.

    A window's anchor is the place of the least hash among its GRAM-byte strings, the leftmost of equals, so equal
    windows have equal strings at equal offsets. The digit is that string's hash, which only locates; the signature is
    a digest of all bytes the run's windows cover, under its length and its anchor's offset.
    """
    if len(raw) < window:
        return (*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64)), np.zeros((0, 2), np.uint64))
    s, down = prefix_hashes(raw), powers(len(raw) + 1)[1]
    at = np.arange(len(raw) - GRAM + 1)
    grams = mixed((s[at + GRAM] - s[at]) * down[at])
    anchor = (_least((grams & ~_PLACE) | at.astype(np.uint64), window - GRAM + 1) & _PLACE).astype(np.int64)
    starts = np.arange(len(anchor))
    row = np.searchsorted(ends, starts, side="right") - 1
    inside = starts + window <= ends[row + 1]
    fresh = inside & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
    first = starts[fresh]
    if not len(first):
        return runs(raw[:0], ends, window)
    stop = np.minimum(np.append(first[1:], len(starts)), ends[row[first] + 1] - window + 1)
    length, offset = stop - first, anchor[first] - first
    data = raw.tobytes()
    sig = b"".join(_digest(data[a : a + n - 1 + window], b"run %d %d" % (n, o)) for a, n, o in zip(first.tolist(), length.tolist(), offset.tolist(), strict=True))
    return row[first], first - ends[row[first]], length, offset, grams[anchor[first]], np.frombuffer(sig, np.uint64).reshape(-1, 2)


def collapse(row: np.ndarray, at: np.ndarray, size: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of runs that one row has several times: the first with their number, and where the others are, joined up.

    Periodic texts have the same run at every period; this makes them a run and a span.
    """
    order = np.lexsort((sig[:, 0], sig[:, 1], row))
    ranked = sig[order]
    fresh = np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(axis=1) | (row[order][1:] != row[order][:-1])])
    n = np.diff(np.append(np.flatnonzero(fresh), len(order)))
    first, rest = order[fresh], np.sort(order[~fresh])
    apart = np.ones(len(rest), bool)
    apart[1:] = (row[rest][1:] != row[rest][:-1]) | (at[rest][1:] != at[rest][:-1] + size[rest][:-1])
    head, tail = rest[apart], rest[np.append(apart[1:], True)] if len(rest) else rest
    return first, n, row[head], at[head], at[tail] + size[tail] - at[head]


def sample(docs: DataFrame, window: int, piece: int = 1_000_000) -> DataFrame:
    """``doc_id, text_id, at, size, off, digit, sig, n`` of the runs of every row; long texts go in pieces of starts.

    Starts that repeat a run of their own row have no digit.
    """
    names = ["doc_id", "text_id", "at", "size", "off", "digit", "sig", "n"]

    def batch_of(batch: pa.RecordBatch, rows: np.ndarray, *columns: pa.Array) -> pa.RecordBatch:
        which = pa.array(rows)
        return pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), *columns], names=names)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, raw, ends in text_slices(batch.column(2), piece):
                alone = len(ends) == 2
                for low in range(0, len(raw), piece) if alone else [0]:
                    part = raw[low : low + piece + window - 1] if alone else raw
                    row, at, size, off, digit, sig = runs(part, np.array([0, len(part)]) if alone else ends, window)
                    if len(row):
                        own, n, s_row, s_at, s_size = collapse(row, at, size, sig)
                        long = lambda x: pa.array(x.astype(np.int64))
                        yield batch_of(batch, row[own] + first, long(at[own] + low), long(size[own]), long(off[own]), pa.array(digit[own].view(np.int64)), pa.array([x.tobytes() for x in sig[own]], pa.binary()), long(n))
                        if len(s_row):
                            none = [pa.nulls(len(s_row), t) for t in (pa.int64(), pa.int64(), pa.binary())]
                            yield batch_of(batch, s_row + first, long(s_at + low), long(s_size), *none, long(np.ones(len(s_row))))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(compute, f"doc_id {kind}, text_id long, at long, size long, off long, digit long, sig binary, n long")


def contexts(docs: DataFrame, window: int) -> DataFrame:
    """``doc_id, text_id, base, off, first, upto, alone, bytes`` of each run in ``places``: the bytes its windows cover.

    A window is named by its anchor's offset in it: it starts at ``base`` less that offset, and the run's windows have
    the offsets from ``first`` to before ``upto``. The anchor is byte ``off`` of ``bytes``.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                texts = part.column(2).cast(pa.binary()).to_pylist()
                runs_of = part.column(3)
                which = pa.array(np.repeat(np.arange(len(texts)), runs_of.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
                flat = runs_of.flatten()
                at, size, off = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("at", "size", "off"))
                cut = [texts[r][a : a + n - 1 + window] for r, a, n in zip(which.to_pylist(), at.tolist(), size.tolist(), strict=True)]
                columns = [pa.array(at + off), pa.array(off), pa.array(off - size + 1), pa.array(off + 1), flat.field("alone"), pa.array(cut, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(which), part.column(1).take(which), *columns], names=["doc_id", "text_id", "base", "off", "first", "upto", "alone", "bytes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(compute, f"doc_id {kind}, text_id long, base long, off long, first long, upto long, alone boolean, bytes binary")


def cells(rows: DataFrame, window: int, width: int) -> DataFrame:
    """``context, first, upto, alone, core, full`` for rows ``context, off, bytes, parts`` cut at multiples of ``width``.

    A cell holds the windows whose anchor has one of ``width`` neighbouring offsets. ``core`` stands for the bytes that
    all windows of the whole cell share, which is the digit of the pass; ``full`` for all bytes of those that are here.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["context", "first", "upto", "alone", "core", "full"]
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                found: list[tuple] = []
                for row in batch.slice(start, 1000).to_pylist():
                    off, data = row["off"], row["bytes"]
                    for part in row["parts"]:
                        for low in range(part["first"] // width * width, part["upto"], width):
                            p, q, top = max(low, part["first"]), min(low + width, part["upto"]), min(low + width, window - GRAM + 1)
                            core = _digest(data[off - low : off - top + 1 + window], b"core %d" % low)
                            full = core if width == 1 else _digest(data[off - q + 1 : off - p + window], b"full %d %d" % (p, q))
                            found.append((row["context"], p, q, part["alone"], core, full))
                if found:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], names=names)

    return rows.select("context", "off", "bytes", "parts").mapInArrow(compute, "context long, first long, upto long, alone boolean, core binary, full binary")


def repeated_starts(docs: DataFrame, window: int = 200) -> DataFrame:
    """``doc_id, text_id, at, upto``: stretches of byte places where a window starts that also starts elsewhere.

    A most-significant-digit radix sort over suffixes, no deeper than the window. The first digit of a window is its
    anchor string, at an offset; each pass adds the bytes around it that all windows of ever fewer offsets share, so
    the last digit is the window itself. In each pass groups that end (one text for a digit) are dropped, equal stretches
    are repeated as they are and go on as one, and only the rest goes to the next pass. Every pass is an aggregation
    with sums made before the shuffle, and what goes on is known from files, so no group is a task; equal groups of the last are the repeated windows.
    ``docs`` has ``doc_id, text_id, text``.
    """
    every = stored(sample(docs, window), "repeats-runs")
    found = every.where("digit is not null")
    often = stored(found.groupBy("digit").agg(F.sum("n").alias("n")).where("n > 1").select("digit"), "repeats-often")
    found = stored(found.join(often, "digit"), "repeats-crowded")
    keyed = F.struct("doc_id", "text_id", "at", "size", "off")
    sigs = stored(found.groupBy("digit", "sig").agg(F.sum("n").alias("copies"), F.min(keyed).alias("one")), "repeats-signatures")
    going = stored(sigs.groupBy("digit").agg(F.count("*").alias("n"), F.min("copies").alias("fewest")).where("n > 1 and fewest = 1").select("digit"), "repeats-going")
    run = F.struct(F.col("one.at").alias("at"), F.col("one.size").alias("size"), F.col("one.off").alias("off"), (F.col("copies") == 1).alias("alone"))
    ask = sigs.join(going, "digit").select(F.col("one.doc_id").alias("r_doc"), F.col("one.text_id").alias("r_text"), run.alias("run")).groupBy("r_doc", "r_text").agg(F.collect_list("run").alias("places"))
    texts = docs.join(ask, docs["doc_id"].eqNullSafe(ask["r_doc"]) & (docs["text_id"] == ask["r_text"])).select("doc_id", "text_id", "text", "places")
    cut = stored(contexts(texts, window).withColumn("context", F.monotonically_increasing_id()), "repeats-contexts")

    rows = cut.select("context", "off", "bytes", F.array(F.struct("first", "upto", "alone")).alias("parts"))
    spans = []
    for width in WIDTHS:
        level = stored(cells(rows, window, width), "repeats-cells")
        places = F.sum(F.when(F.col("alone"), 1).otherwise(2)).alias("places")
        fulls = stored(level.groupBy("core", "full").agg(places, F.min(F.struct("context", "first", "upto")).alias("one")), "repeats-fulls")
        twins = stored(fulls.where("places > 1").select("core", "full"), "repeats-twins")
        spans.append(level.where("alone").join(twins, ["core", "full"]).select("context", "first", "upto"))
        if width > 1:
            going = stored(fulls.groupBy("core").agg(F.count("*").alias("n"), F.min("places").alias("fewest")).where("n > 1 and fewest = 1").select("core"), "repeats-going")
            part = F.struct("one.first", "one.upto", (F.col("places") == 1).alias("alone"))
            parts = fulls.join(going, "core").select("one.context", part.alias("part")).groupBy("context").agg(F.collect_list("part").alias("parts"))
            rows = cut.select("context", "off", "bytes").join(parts, "context")
    near = spans[0].unionByName(spans[1]).unionByName(spans[2]).join(cut.select("context", "doc_id", "text_id", "base"), "context")
    near = near.select("doc_id", "text_id", (F.col("base") - F.col("upto") + 1).alias("at"), (F.col("base") - F.col("first")).alias("upto"))
    whole = found.join(sigs.where("copies > 1").select("digit", "sig"), ["digit", "sig"]).select("doc_id", "text_id", "at", "size").unionByName(every.where("digit is null").select("doc_id", "text_id", "at", "size"))
    return whole.select("doc_id", "text_id", "at", (F.col("at") + F.col("size") - 1).alias("upto")).unionByName(near)


def cut_out(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 200):
            part = batch.slice(first, 200)
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "spans", "kept")}
            for text, places in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                text, spans = text or b"", []
                for at, upto in sorted((p["at"], p["upto"] + window) for p in places or ()):
                    if spans and at <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], upto)
                    else:
                        spans.append([at, upto])
                kept, last = [], 0
                for a, b in spans:
                    kept.append(text[last:a])
                    last = b
                kept.append(text[last:])
                out["n_bytes"].append(len(text))
                out["n_removed"].append(sum(b - a for a, b in spans))
                out["spans"].append([{"first": a, "end": b} for a, b in spans])
                out["kept"].append(b"".join(kept))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], names=["doc_id", *out])


def dedup(docs: DataFrame, window: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept`` for every row: texts without the bytes of repeated windows.

    A byte goes if any ``window``-byte string over it also starts at another place of any row, its own included;
    matches never cross rows, and are judged on the input. ``kept`` is binary, as a span may end inside a character.
    Null and empty texts, and those shorter than the window, lose nothing. Repeated rows are places of their own, so
    they lose what they share; no rows, no result; other columns are not read. Bytes count as equal by keyed digests of
    128 bits. Windows have at least GRAM bytes.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), row_id(F.col(text_col)).alias("text_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    starts = repeated_starts(docs, window)
    spans = stored(starts.groupBy(F.col("doc_id").alias("s_doc"), F.col("text_id").alias("s_text")).agg(F.collect_set(F.struct("at", "upto")).alias("places")), "repeats-spans")
    rows = docs.join(spans, docs["doc_id"].eqNullSafe(spans["s_doc"]) & (docs["text_id"] == spans["s_text"]), "left").select("doc_id", "text", "places")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: cut_out(b, window), f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<first:long,end:long>>, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
