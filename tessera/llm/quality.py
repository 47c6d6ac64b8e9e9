"""Quality scores by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import row_id, stored, table

#: Document statistics, in the order of the feature vector.
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "distinct_words", "repeated_next", "top_word", "upper", "lower", "digit",
    "space", "ascii_mark", "sentence_mark", "bar", "bang", "dollar_hash", "not_ascii", "mark_ended", "log_lines",
    "line_bytes", "distinct_lines", "longest_word", "capital_words",
)
_SPACE = b" \t\n\x0b\x0c\r"


def _share(counts: np.ndarray, chars: bytes) -> float:
    return float(counts[np.frombuffer(chars, np.uint8)].sum())


_UPPER, _LOWER, _DIGIT = (bytes(range(a, b + 1)) for a, b in ((65, 90), (97, 122), (48, 57)))
_MARK = bytes(b for b in range(33, 127) if b not in _UPPER + _LOWER + _DIGIT)


def statistics(text: str) -> list[float]:
    """The statistics of one whole text; all are defined for the empty one."""
    raw = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(len(raw), 1)
    words = raw.split()
    w = max(len(words), 1)
    lines = [x for x in raw.split(b"\n") if x]
    k = max(len(lines), 1)
    often: dict[bytes, int] = {}
    for x in words:
        often[x] = often.get(x, 0) + 1
    return [
        np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / w, len(often) / w, sum(map(eq, words, words[1:])) / w,
        max(often.values(), default=0) / w, _share(counts, _UPPER) / n, _share(counts, _LOWER) / n, _share(counts, _DIGIT) / n,
        _share(counts, _SPACE) / n, _share(counts, _MARK) / n, _share(counts, b".?!,;:") / n, counts[124] / n, counts[33] / n,
        _share(counts, b"$#%&*@") / n, float(counts[128:].sum()) / n, sum(x[-1] in _MARK for x in words) / w, np.log1p(len(lines)),
        sum(map(len, lines)) / k, len(set(lines)) / k, np.log1p(max(map(len, words), default=0)), sum(x[0] in _UPPER for x in words) / w,
    ]


@dataclass
class Trees:
    """Trees flattened into arrays: node i splits on ``feature[i]`` at ``threshold[i]``; leaves have feature -1."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row; every level of a tree is one numpy step over all rows."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                down = np.where(x[rows, f] <= self.threshold[at], self.left[at], self.right[at])
                at = np.where(f < 0, at, down)
            total += self.value[at]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 8, l2: float = 1.0) -> Trees:
    """Boost logistic loss on feature histograms. Without rows the score is 0.5; with one label, nearly that label."""
    p = (y.sum() + 0.5) / (len(y) + 1.0)
    cols: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []

    def node(value: float) -> int:
        for k, v in (("feature", -1), ("threshold", 0.0), ("left", 0), ("right", 0), ("value", value)):
            cols[k].append(v)
        return len(cols["feature"]) - 1

    base = float(np.log(p / (1 - p)))
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        flat = binned + np.arange(x.shape[1]) * bins
        total = np.full(len(y), base)
        for _ in range(rounds):
            prob = 1.0 / (1.0 + np.exp(-total))
            grad, hess = y - prob, np.maximum(prob * (1 - prob), 1e-9)
            roots.append(node(0.0))
            grow = [(roots[-1], np.arange(len(y)), 0)]
            while grow:
                at, rows, level = grow.pop()
                g, h = grad[rows].sum(), hess[rows].sum()
                best = (1e-6, -1, 0)
                if level < depth and len(rows) >= 2 * least:
                    width = x.shape[1] * bins
                    idx = flat[rows].ravel()
                    hist = [np.bincount(idx, np.repeat(v, x.shape[1]), width).reshape(-1, bins).cumsum(1)[:, :-1] for v in (grad[rows], hess[rows], np.ones(len(rows)))]
                    gain = hist[0] ** 2 / (hist[1] + l2) + (g - hist[0]) ** 2 / (h - hist[1] + l2) - g * g / (h + l2)
                    gain[(hist[2] < least) | (len(rows) - hist[2] < least)] = 0
                    j, b = divmod(int(gain.argmax()), bins - 1)
                    if gain[j, b] > best[0] and b < len(edges[j]):
                        best = (gain[j, b], j, b)
                if best[1] < 0:
                    cols["value"][at] = step = rate * g / (h + l2)
                    total[rows] += step
                    continue
                _, j, b = best
                low = binned[rows, j] <= b
                cols["feature"][at], cols["threshold"][at] = j, edges[j][b]
                cols["left"][at], cols["right"][at] = node(0.0), node(0.0)
                grow += [(cols["left"][at], rows[low], level + 1), (cols["right"][at], rows[~low], level + 1)]
    kinds = {"feature": np.int32, "threshold": np.float64, "left": np.int32, "right": np.int32, "value": np.float64}
    return Trees(base, np.array(roots, np.int32), *(np.array(cols[k], kinds[k]) for k in kinds), depth=depth)


def featurise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_id, x`` for every document, in one pass over whole texts without a shuffle."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t or "") for t in batch.column(2).to_pylist()], np.float32).reshape(-1, len(FEATURES))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["doc_id", "text_id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), row_id(F.col(text_col)).alias("text_id"), F.col(text_col).alias("text")).mapInArrow(compute, f"doc_id {kind}, text_id long, x array<float>")


def held_out(doc_id) -> "F.Column":
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(features: DataFrame, labels: DataFrame, label_col: str = "quality", most_rows: int = 20_000) -> Trees:
    """Fit on labelled rows whose crc32(doc_id) mod 5 is not 0.

    The fit is on at most ``most_rows`` of them, those with the smallest hash of their id: only their statistics
    reach the driver. Null labels and ids without a document take no part; an id labelled twice counts with its
    larger label.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).alias("label"))
    known = known.where(~held_out(F.col("doc_id")))
    rows = features.join(known, "doc_id").select("x", "label", F.xxhash64("doc_id").alias("draw"), "doc_id", "text_id").orderBy("draw", "doc_id", "text_id").limit(most_rows).toPandas()
    x = np.array(rows["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, (rows["label"].to_numpy() >= 1).astype(np.float64))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_rows: int = 20_000) -> DataFrame:
    """``doc_id, text_id, held_out, score, predicted`` for every row of ``docs``.

    Statistics are computed once and kept in the shared folder; fitting and scoring read only them. Null and empty
    texts have the statistics of the empty text. Repeated rows score alike; no documents, no rows; no labels, 0.5.
    A null id is never held out. Only ids and texts are read, so other columns can have any name.
    """
    features = stored(featurise(docs), "quality-features")
    trees = train(features, labels, most_rows=most_rows)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(trees.score(x), pa.float64())], names=["doc_id", "text_id", "held_out", "score"])

    kind = features.schema["doc_id"].dataType.simpleString()
    scored = features.select("doc_id", "text_id", held_out(F.col("doc_id")).alias("held_out"), "x").mapInArrow(predict, f"doc_id {kind}, text_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_id")
