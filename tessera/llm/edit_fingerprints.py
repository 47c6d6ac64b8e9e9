"""Fingerprints of texts by randomised edit embedding, and near copies by bands of them."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._shared import row_id, stored, table
from tessera.llm.near_dedup import by_group, forest, spanning
from tessera.llm.periodic import Suffixes
from tessera.llm.shingles import mixed

#: Sampled places of the embedding, a byte each; bands of 4 find texts whose bytes agree by half with all but 2 %.
SAMPLES, BAND = 256, 4
#: Kinds of characters that walk alike, and steps after which their random bits repeat.
KINDS, PERIOD = 64, 4096
_U = np.uint64


def _walks() -> list[bytes]:
    """For each kind and step, how many steps a walk stays on a character: up to the first 1 of the kind's random bits."""
    bits = np.unpackbits(np.frombuffer(hashlib.shake_256(b"walks").digest(KINDS * PERIOD // 8), np.uint8)).reshape(KINDS, PERIOD)
    stay = []
    for own in bits:
        ones = np.flatnonzero(np.concatenate([own, own]))
        stay.append((ones[np.searchsorted(ones, np.arange(PERIOD))] - np.arange(PERIOD) + 1).astype(np.uint8).tobytes())
    return stay


def _records(upto: float = 2.0**45) -> np.ndarray:
    """For each sample, places that are its first choice among all before the next one: a fair draw for every length."""
    rng, rows = np.random.default_rng(1), []
    for _ in range(SAMPLES):
        row = [0]
        while row[-1] < upto:
            row.append(int((row[-1] + 1) / (1 - rng.random())))
            row[-1] += row[-1] == row[-2]
        rows.append(row)
    most = max(map(len, rows))
    return np.array([r + [r[-1]] * (most - len(r)) for r in rows], np.int64)


STAY, RECORDS = _walks(), _records()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def walk(chars: np.ndarray, at: int = 0) -> np.ndarray:
    """The step at which each character is first put out, and the step after the last, from step ``at`` on.

    At each step of the embedding the walk puts out the character it is on, and moves on if that kind's bit of the step is 1.
    So after an edit two walks fall into step again, and texts few edits apart differ in few places of their embeddings.
    """
    out = array("q")
    add, stay, last = out.append, STAY, PERIOD - 1
    for kind in (chars * np.uint32(0x9E3779B1) >> np.uint32(26)).astype(np.uint8).tobytes():
        add(at)
        at += stay[kind][at & last]
    add(at)
    return np.frombuffer(out, np.int64)


def sampled(chars: np.ndarray, steps: np.ndarray) -> bytes:
    """A byte for each sampled place of the embedding: the place, and the character put out there with its next two.

    Each sample has its own place for each length of the embedding; two lengths share it as often as the lesser is a share
    of the greater, so bytes agree as often as embeddings do, whatever their lengths. An empty text has zeros.
    """
    if not len(chars):
        return bytes(SAMPLES)
    end = int(steps[-1])
    place = RECORDS[np.arange(SAMPLES), (RECORDS < end).sum(axis=1) - 1]
    at = np.searchsorted(steps[:-1], place, side="right") - 1
    padded = np.concatenate([chars, np.zeros(2, np.uint32)]).astype(np.uint64)
    symbol = padded[at] | padded[at + 1] << _U(21) | padded[at + 2] << _U(42)
    return (mixed(mixed(symbol) ^ place.astype(np.uint64)) >> _U(56)).astype(np.uint8).tobytes()


def fingerprint(text: str) -> bytes:
    chars = codes(text)
    return sampled(chars, walk(chars))


def likeness(a: bytes, b: bytes) -> float:
    """The share of equal bytes, less what chance gives, from 0 to 1."""
    same = np.mean(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8))
    return float(max(0.0, (same - 1 / 256) / (1 - 1 / 256)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_id, n_chars, fingerprint`` (hex digits) for every row of ``docs``.

    Equal texts have equal fingerprints; null texts are empty ones; repeated rows and null ids are rows like others;
    other columns are not read; no rows, no result. Whole texts are walked, one at a time, and nothing is shuffled.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            columns = [pa.array([len(t) for t in texts], pa.int64()), pa.array([fingerprint(t).hex() for t in texts], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "text_id", "n_chars", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), row_id(F.col(text_col)).alias("text_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(compute, f"doc_id {kind}, text_id long, n_chars long, fingerprint string")


def edits_within(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether at most ``most`` insertions, deletions and substitutions of characters lead from a to b.

    For each number of edits, the furthest place on each diagonal; equal stretches are jumped by the classes of a
    suffix array of both texts.
    """
    if abs(len(a) - len(b)) > most:
        return False
    line = np.concatenate([a.astype(np.int64), [-1], b.astype(np.int64), [-2]])
    suffixes = Suffixes(line, max(len(a), len(b), 1))
    far = np.full(2 * most + 3, -(1 << 60), np.int64)
    far[most + 1] = 0
    diagonal = np.arange(-most - 1, most + 2)
    for edits in range(most + 1):
        if edits:
            step = far + 1
            step[1:] = np.maximum(step[1:], far[:-1])
            step[:-1] = np.maximum(step[:-1], far[1:] + 1)
            far = np.minimum(step, np.minimum(len(a), len(b) - diagonal))
        on = np.flatnonzero((far >= 0) & (far + diagonal >= 0))
        far[on] += suffixes.common(far[on], len(a) + 1 + far[on] + diagonal[on])
        if far[most + 1 + len(b) - len(a)] >= len(a):
            return True
    return False


def _groups(part: pa.Table, at: np.ndarray, linked: Callable[[int, int, np.ndarray], np.ndarray]) -> list[tuple[bytes, bytes]]:
    fps, tree = part["fp"].to_pylist(), part["tree"].combine_chunks().dictionary_encode().indices.to_numpy()
    edges = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        for root, found in forest(tree[a:b], lambda i, rest, a=a: linked(a, i, rest)):
            edges += [(fps[a + root], fps[a + j]) for j in found.tolist()]
    return edges


def alike(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``part, fp, tree, bytes``: edges between trees of each part whose fingerprints are that alike."""

    def work(part: pa.Table, at: np.ndarray) -> list[tuple[bytes, bytes]]:
        rows = np.frombuffer(b"".join(part["bytes"].to_pylist()), np.uint8).reshape(-1, SAMPLES)
        return _groups(part, at, lambda a, i, rest: (rows[a + i] == rows[a + rest]).mean(axis=1) >= least)

    return lambda batches: by_group(batches, work)


def verified(per_mille: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``part, fp, tree, text``: edges between trees of each part within the edits allowed."""

    def work(part: pa.Table, at: np.ndarray) -> list[tuple[bytes, bytes]]:
        texts = [codes(t) for t in part["text"].to_pylist()]
        near = lambda x, y: edits_within(x, y, per_mille * max(len(x), len(y)) // 1000)
        return _groups(part, at, lambda a, i, rest: np.array([near(texts[a + i], texts[a + j]) for j in rest.tolist()], bool))

    return lambda batches: by_group(batches, work, 500)


def link(docs: DataFrame, per_mille: int = 20, least: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_id, n_chars, component_id`` for every row: classes of texts that few edits join.

    Texts are linked if at most ``per_mille`` edits for each 1,000 code points of the longer lead from one to the other.
    Candidates share a band of 4 sampled bytes and agree in at least ``least`` of all; each is verified by its edits.
    Equal texts are one class first; buckets are cut in parts and joined by trees, so no pairs are written. An edit now and then
    throws walks out of step for long, so candidates can be missed, the fewer the less edits there are. Null
    and empty texts have no links; ``component_id`` is the least id reached.
    """
    printed = stored(fingerprints(docs, id_col, text_col), "edit-fingerprints")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text <> ''")
    classes = rows.groupBy("text").agg(F.min("doc_id").alias("least"))
    classes = stored(classes.select(F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("fp"), row_id(F.col("text")).alias("text_id"), "least", "text"), "edit-classes")
    bytes_ = classes.join(printed.select("text_id", F.unhex("fingerprint").alias("bytes"), "n_chars").distinct(), "text_id").select("fp", "bytes", "n_chars")
    bytes_ = stored(bytes_, "edit-bytes")
    bands = F.transform(F.sequence(F.lit(0), F.lit(SAMPLES // BAND - 1)), lambda i: F.xxhash64(i, F.substring("bytes", i * BAND + 1, F.lit(BAND))))
    banded = bytes_.select(F.explode(bands).alias("group"), "fp", F.lit(1).cast("long").alias("weight"))
    clusters = spanning(banded, bytes_.select("fp", "bytes"), 512, alike(least))
    grouped = stored(clusters.join(bytes_.select("fp", "n_chars"), "fp").select(F.col("tree").alias("group"), "fp", F.col("n_chars").alias("weight")), "edit-clusters")
    roots = spanning(grouped, classes.select("fp", "text"), 200_000, verified(per_mille)).withColumnRenamed("tree", "top")
    tops = classes.select("fp", "text_id", "least").join(roots, "fp", "left").withColumn("top", F.coalesce("top", "fp"))
    ids = tops.groupBy("top").agg(F.min("least").alias("component_id")).join(tops.select("top", "text_id"), "top").select("text_id", "component_id")
    found = printed.select("doc_id", "text_id", "n_chars").join(ids, "text_id", "left")
    return found.select("doc_id", "text_id", "n_chars", F.when(F.col("n_chars") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class _Text:
    """A text with its walk, so that an edit of its end walks only that."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.codes = codes(self.text)
        self.steps = walk(self.codes)
        self.print = sampled(self.codes, self.steps)

    def against(self, other: _Text) -> tuple:
        """The columns of the result: this text, it with its last half replaced by the start of the other, and the other."""
        kept = len(self.codes) - len(self.codes) // 2
        put = other.codes[: len(self.codes) - kept]
        new = np.concatenate([self.codes[:kept], put])
        edited = sampled(new, np.concatenate([self.steps[:kept], walk(put, int(self.steps[kept]))]))
        sha = hashlib.sha256((self.text[:kept] + other.text[: len(put)]).encode()).hexdigest()
        return len(self.codes), sha, self.print.hex(), edited.hex(), likeness(self.print, edited), likeness(self.print, other.print)


def _batch(ids: list, rows: list[tuple], kind: pa.DataType, edges: list[tuple] | None = None) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    columns = [pa.array(ids, kind), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))]
    names = ["doc_id", *(c.split()[0] for c in _RESULT.split(", "))]
    if edges is not None:
        columns += [pa.array([e[0] for e in edges], pa.string()), pa.array([e[1] for e in edges], pa.string())]
        names += ["first_text", "last_text"]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows ``doc_id, text``: each against the next; the first brings its text, and the last, which has no next yet, too."""
    held, first, kind = None, None, pa.null()
    for batch in batches:
        kind = batch.schema.field(0).type
        ids, rows, edges = [], [], []
        for i in range(batch.num_rows):
            doc_id, new = batch.column(0)[i].as_py(), _Text(batch.column(1)[i].as_py())
            if held:
                ids.append(held[0])
                rows.append(held[1].against(new))
                edges.append((first, None))
            first = new.text if not held else None
            held = doc_id, new
        yield _batch(ids, rows, kind, edges)
    if held:
        yield _batch([held[0]], [(None,) * 6], kind, [(first, held[1].text)])


def _at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_Text(batch.column(1)[i].as_py()).against(_Text(batch.column(2)[i].as_py())) for i in range(batch.num_rows)]
        yield _batch(batch.column(0).to_pylist(), rows, batch.schema.field(0).type)


def neighbours(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every row of ``docs``.

    The next document is that of the next id (after the last, the first; null ids first; rows of one id by a hash of
    their texts). An edited text has its last half replaced by as much of the next one's start. Texts are
    range-sorted by id once and read in order; where one range ends, its last text meets the next range's first,
    which both brought along: a row for each range. Null texts are empty; a single row is its own next; no rows, no result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", row_id(F.col("text")).alias("text_id"), "text").repartitionByRange("doc_id", "text_id").sortWithinPartitions("doc_id", "text_id")
    done = rows.select("doc_id", "text").mapInArrow(_in_order, f"doc_id {kind}, {_RESULT}, first_text string, last_text string")
    done = stored(done.withColumn("shard", F.spark_partition_id()), "edit-neighbours")
    firsts = done.where("first_text is not null").select(F.col("shard").alias("after"), F.col("first_text").alias("next_text"))
    # One row a range.
    order = firsts.select("after").select(F.col("after").alias("shard"), F.lead("after").over(Window.orderBy("after")).alias("after"), F.min("after").over(Window.orderBy("after")).alias("least"))
    order = order.select("shard", F.coalesce("after", "least").alias("after"))
    lasts = done.where("last_text is not null").join(order, "shard").join(firsts, "after").select("doc_id", "last_text", "next_text")
    names = [c.split()[0] for c in _RESULT.split(", ")]
    return done.where("last_text is null").select("doc_id", *names).unionByName(lasts.mapInArrow(_at_edges, f"doc_id {kind}, {_RESULT}"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "documents"))
