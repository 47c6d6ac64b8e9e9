"""Near-duplicate documents by HyperMinHash registers, banding and exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import row_id, stored, table
from tessera.llm.components import components
from tessera.llm.shingles import shingle_sets
from tessera.sources.scratch import release

#: 2 ** 7 registers in 32 bands of 4. A pair of similarity 0.8 shares no band with probability below 1e-7.
BITS, BAND = 7, 4
REGISTERS = 1 << BITS
MANTISSA = 10
EMPTY = 0xFFFF
_U = np.uint64
#: What one task compares at a time: rows of a bucket, and shingles of a cluster, where a row counts as ROW more.
BUCKET_ROWS, CLUSTER_SHINGLES, ROW = 2048, 100_000, 100
#: Rows to compare that are sent to where registers and sets are, rather than shuffled with all of those: at most this many.
MOST_BROADCAST = 200_000


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash of a sorted hash set: per bucket, the least value's leading zeros and ten bits that follow.

    The first bits of a hash name its bucket. A double's exponent and mantissa are just that pair, so the register is
    cut from the least value's bits as a double. Buckets without a hash are EMPTY.
    """
    at = np.append(np.searchsorted(hashes, np.arange(REGISTERS, dtype=np.uint64) << _U(64 - BITS)), len(hashes))
    used = at[:-1] < at[1:]
    out = np.full(REGISTERS, EMPTY, np.uint16)
    least = (hashes[at[:-1][used]] << _U(BITS)) >> _U(11)
    bits = (least.astype(np.float64).view(np.uint64) >> _U(52 - MANTISSA)).astype(np.int64)
    out[used] = np.maximum(bits - (1023 << MANTISSA), 0).astype(np.uint16)
    return out


def codes(regs: np.ndarray) -> np.ndarray:
    """A byte for each register, 0 for an EMPTY one: equal registers stay equal, and one in 255 of the others becomes so."""
    return np.where(regs == EMPTY, 0, regs % 255 + 1).astype(np.uint8)


def estimate(left: np.ndarray, right: np.ndarray, empty: int = EMPTY) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimate of register rows, less the collisions expected by chance, and the registers it rests on."""
    used = (left != empty) | (right != empty)
    same = (left == right) & used
    n = used.sum(axis=-1)
    by_chance = 0.169919487159739 * 2.0 ** (BITS - MANTISSA + 1)
    return (same.sum(axis=-1) - by_chance) / np.maximum(n, 1), n


def plausible(left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Whether a similarity of ``percent`` is within six standard errors of the estimate by ``codes``."""
    s = percent / 100
    found, n = estimate(left, right, 0)
    return found >= s - 6 * np.sqrt(s * (1 - s) / np.maximum(n, 1)) - 1 / np.maximum(n, 1)


def forest(tree: np.ndarray, linked: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Edges (row, others) that join the rows of each component of the link graph.

    Rows of one ``tree`` are joined already. Every row is compared with all rows that are not yet joined to it.
    """
    rest = np.arange(len(tree))
    while len(rest) > 1:
        own = tree[rest] == tree[rest[0]]
        front, rest = rest[own].tolist(), rest[~own]
        while front and len(rest):
            i = front.pop()
            hit = linked(i, rest)
            if hit.any():
                yield i, rest[hit]
                met = np.isin(tree[rest], tree[rest[hit]])
                front += rest[met].tolist()
                rest = rest[~met]


def by_group(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table, np.ndarray], list[tuple[bytes, bytes]]], most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Call ``work`` on whole groups of a stream that is sorted by its first column, many small groups at a time."""

    def done(part: pa.Table) -> pa.RecordBatch:
        key, kind = part.column(0).to_numpy(), part.column(1).type
        edges = work(part, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])))
        return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], kind), pa.array([e[1] for e in edges], kind)], names=["a", "b"])

    held: list[pa.Table] = []
    for batch in batches:
        for first in range(0, batch.num_rows, most):
            held.append(pa.Table.from_batches([batch.slice(first, most)]))
            key = held[-1].column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut or (len(held) > 1 and held[-2].column(0)[-1].as_py() != key[-1]):
                whole = pa.concat_tables([*held[:-1], held[-1].slice(0, cut)])
                held = [held[-1].slice(cut)]
                if whole.num_rows:
                    yield done(whole)
    if held and (whole := pa.concat_tables(held)).num_rows:
        yield done(whole)


def _codes(names: pa.ChunkedArray) -> np.ndarray:
    return names.combine_chunks().dictionary_encode().indices.to_numpy()


def bucket_links(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``part, fp, tree, codes``: edges between trees of each part whose registers allow a link."""

    def work(part: pa.Table, at: np.ndarray) -> list[tuple[bytes, bytes]]:
        fps, tree = part["fp"].to_pylist(), _codes(part["tree"])
        regs = np.frombuffer(b"".join(part["codes"].to_pylist()), np.uint8).reshape(-1, REGISTERS)
        edges = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            own = regs[a:b]
            for root, found in forest(tree[a:b], lambda i, rest, own=own: plausible(own[i], own[rest], percent)):
                edges += [(fps[a + root], fps[a + j]) for j in found.tolist()]
        return edges

    return lambda batches: by_group(batches, work)


def cluster_links(percent: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``part, fp, tree, digest, text``: edges between trees of each part that are linked by their texts' full sets.

    A text whose set has not the digest shares no more than its row's ids with the one that is meant, and is left out.
    """

    def work(part: pa.Table, at: np.ndarray) -> list[tuple[bytes, bytes]]:
        sets = list(shingle_sets(part["text"], width))
        meant = np.array([_fingerprint(s) == d for s, d in zip(sets, part["digest"].to_pylist(), strict=True)], bool)
        part, at = part.filter(pa.array(meant)), np.concatenate([[0], np.cumsum(meant)])[at]
        sets = [np.ascontiguousarray(s.T) for s, m in zip(sets, meant, strict=True) if m]
        fps, tree = part["fp"].to_pylist(), _codes(part["tree"])
        edges = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            own = sets[a:b]
            lens = np.array([s.shape[1] for s in own])

            def linked(i: int, rest: np.ndarray, own: list[np.ndarray] = own, lens: np.ndarray = lens) -> np.ndarray:
                u, n, size = own[i], lens[rest], int(lens[i])
                near = np.flatnonzero(100 * np.minimum(n, size) >= percent * np.maximum(n, size))
                hit = np.zeros(len(rest), bool)
                if len(near):
                    flat = np.concatenate([own[j] for j in rest[near]], axis=1)
                    both = (u[:, np.minimum(np.searchsorted(u[0], flat[0]), size - 1)] == flat).all(axis=0)
                    common = np.add.reduceat(both, np.concatenate([[0], np.cumsum(n[near])[:-1]]), dtype=np.int64)
                    hit[near] = 100 * common >= percent * (n[near] + size - common)
                return hit

            for root, found in forest(tree[a:b], linked):
                edges += [(fps[a + root], fps[a + j]) for j in found.tolist()]
        return edges

    return lambda batches: by_group(batches, work, 500)


def _fingerprint(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_id, n_shingles, fp, bands`` for each row: a digest of the whole set, and registers band by band."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fps, regs = [], [], []
            for s in shingle_sets(batch.column(2), width):
                n.append(len(s))
                fps.append(_fingerprint(s))
                regs.append(registers(np.ascontiguousarray(s[:, 0])))
            flat = np.concatenate(regs).view(np.int64) if regs else np.zeros(0, np.int64)
            per = REGISTERS // BAND
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * per), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(fps, pa.binary()), bands], names=["doc_id", "text_id", "n_shingles", "fp", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), row_id(F.col(text_col)).alias("text_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(compute, f"doc_id {kind}, text_id long, n_shingles long, fp binary, bands array<long>")


def coded(classes: DataFrame) -> DataFrame:
    """``fp, codes`` of rows ``fp, bands``: what is sent to be compared, half of the registers' bytes."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = codes(batch.column(1).flatten().to_numpy().view(np.uint16)).tobytes()
            rows = [flat[k : k + REGISTERS] for k in range(0, len(flat), REGISTERS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["fp", "codes"])

    return classes.select("fp", "bands").mapInArrow(compute, f"fp {classes.schema['fp'].dataType.simpleString()}, codes binary")


Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _sent(few: DataFrame) -> DataFrame:
    """``few`` with a hint to broadcast it, where it is MOST_BROADCAST rows at most."""
    return F.broadcast(few) if few.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else few


def _compared(dealt: DataFrame, payload: DataFrame, work: Work) -> DataFrame:
    """Edges that ``work`` finds between trees of one part; ``dealt`` has ``parts, fp, tree``, ``payload`` a row for each fp.

    Few rows are broadcast, so that only their own registers or texts are shuffled and not all that are stored.
    """
    rows = _sent(dealt).join(payload, "fp").select(F.explode("parts").alias("part"), "fp", "tree", *(c for c in payload.columns if c != "fp"))
    kind = dealt.schema["fp"].dataType.simpleString()
    return rows.repartition("part").sortWithinPartitions("part", "fp").mapInArrow(work, f"a {kind}, b {kind}")


def _relabel(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``fp, tree`` with trees that ``edges`` (between rows) connect made one."""
    of = labels.select(F.col("fp").alias("a"), F.col("tree").alias("ta")), labels.select(F.col("fp").alias("b"), F.col("tree").alias("tb"))
    tops = components(edges.join(of[0], "a").join(of[1], "b").select("ta", "tb"), "ta", "tb").select(F.col("node").alias("tree"), "root")
    return stored(labels.join(tops, "tree", "left").select("fp", F.coalesce("root", "tree").alias("tree")), "near-trees")


def _parts(weight: Column, limit: int) -> Column:
    """Into how many parts of at most about ``limit`` a group is cut: a power of two, so that the parts of one family are
    the same in most of its groups, and so are the edges found in them."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.ceil(weight / limit).cast("double")))).cast("long")


def _members() -> list[Column]:
    """What tells the set of a group's rows from other sets: two hashes of 64 bits over rows in any order."""
    return [F.bit_xor(F.xxhash64(F.lit(k), "fp")).alias(f"set{k}") for k in (1, 2)]


def spanning(rows: DataFrame, payload: DataFrame, limit: int, work: Work) -> DataFrame:
    """``fp, tree`` of every fp of ``rows`` (``group, fp, weight``): its component by links within groups.

    Of groups that have the same rows, as the bands of near copies do, one stands for all: it finds the same links.
    Groups are cut at random into parts of about ``limit`` weight, each compared in full. Where a group had several
    parts, one row of each tree found meets those of the other trees, which joins families of copies whatever their size.
    Only where a group still has several trees are rows of different trees compared: all others with the heaviest, in
    pairs of parts, and among each other. So no group is a task and no link is missed. The work grows with the rows of a
    family of copies; rows of one group that nothing links are compared part by part, which grows with their square.
    """
    # Most groups are one row, so rows are counted before anything else is known of a group.
    many = stored(rows.groupBy("group").count().where("count > 1").select("group"), "near-many")
    rows = stored(rows.join(many, "group"), "near-several")
    sizes = rows.groupBy("group").agg(_parts(F.sum("weight"), limit).alias("parts"), F.count("*").alias("n"), *_members())
    sizes = stored(sizes.groupBy("n", "parts", "set1", "set2").agg(F.min("group").alias("group")).select("group", "parts"), "near-parts")
    own = stored(rows.join(sizes, "group"), "near-groups")
    dealt = own.select(F.xxhash64("group", F.pmod(F.xxhash64("fp"), F.col("parts"))).alias("part"), "fp", F.col("fp").alias("tree"))
    dealt = dealt.select(F.array("part").alias("parts"), "fp", "tree")
    edges = stored(_compared(dealt, payload, work), "near-edges")
    labels = components(edges).select(F.col("node").alias("fp"), F.col("root").alias("tree"))
    large = own.where("parts > 1").select("group", "fp", "weight")
    if large.isEmpty():
        return labels
    labels = stored(large.select("fp").distinct().join(labels, "fp", "full").select("fp", F.coalesce("tree", "fp").alias("tree")), "near-trees")

    trees = large.join(labels, "fp").groupBy("group", "tree").agg(F.min(F.struct("fp", "weight")).alias("one")).select("group", "tree", "one.*")
    sizes = stored(trees.groupBy("group").agg(_parts(F.sum("weight"), limit).alias("parts"), F.count("*").alias("n")).where("n > 1").select("group", "parts"), "near-parts")
    if sizes.isEmpty():
        return labels
    dealt = trees.join(sizes, "group").select(F.xxhash64("group", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")), F.lit(1)).alias("part"), "fp", "tree")
    dealt = stored(dealt.select(F.array("part").alias("parts"), "fp", "tree"), "near-dealt")
    labels = _relabel(labels, stored(_compared(dealt, payload, work), "near-edges"))

    rows = stored(large.join(labels, "fp"), "near-split")
    trees = rows.groupBy("group", "tree").agg(F.sum("weight").alias("weight"))
    trees = trees.groupBy("group").agg(F.max_by("tree", F.struct("weight", "tree")).alias("top"), F.max("weight").alias("most"), F.sum("weight").alias("every"), F.count("*").alias("n")).where("n > 1")
    trees = trees.select("group", "top", F.ceil(F.col("most") / limit).alias("tops"), F.ceil((F.col("every") - F.col("most")) / limit).alias("others"))
    trees = stored(trees, "near-parts")
    if trees.isEmpty():
        return labels
    among = F.col("tops") * F.col("others")
    place = F.pmod(F.xxhash64("fp", F.lit(2)), F.when(F.col("tree") == F.col("top"), F.col("tops")).otherwise(F.col("others")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    with_others = F.transform(upto("others"), lambda j: F.col("place") * F.col("others") + j)
    with_top = F.transform(upto("tops"), lambda i: i * F.col("others") + F.col("place"))
    each_other = F.transform(upto("others"), lambda j: among + F.least("place", j) * F.col("others") + F.greatest("place", j))
    parts = F.when(F.col("tree") == F.col("top"), with_others).otherwise(F.concat(with_top, each_other))
    parts = F.transform(parts, lambda pair: F.xxhash64("group", pair, F.lit(2)))
    dealt = stored(rows.join(trees, "group").withColumn("place", place).select(parts.alias("parts"), "fp", "tree"), "near-dealt")
    return _relabel(labels, stored(_compared(dealt, payload, work), "near-edges"))


def link(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_id, n_shingles, component_id, kept`` for every row of ``docs``.

    A document's set is its distinct ``width``-word shingles, A-Z lower-cased; shorter texts are one shingle; texts
    without words (null and empty too) have an empty set and link with nothing. Documents are linked if their sets'
    intersection is at least ``percent`` per cent of the union; ``component_id`` is the smallest id that links reach,
    and ``kept`` marks the document that has it (repeated rows of that id are all kept).

    Equal sets are one class, grouped before anything else, so exact copies cost a row each. Classes are banded by
    HyperMinHash registers. Inside a bucket, rows whose registers allow a link form trees, and the trees form
    clusters; inside a cluster every row is held against every row of another tree on full sets, with 128 bits for each
    shingle. No step writes pairs: trees have fewer edges than rows. Large groups are spread over tasks (``spanning``).
    The only chance of a missed link is in the bands and the six-sigma bound. Null ids never are the smallest; a component without ids has a null ``component_id`` and its rows are
    kept. No rows, no result; other columns are not read.
    """
    whole = stored(signatures(docs, width, id_col, text_col), "near-signatures")
    classes = whole.where("n_shingles > 0").groupBy(F.col("fp").alias("digest")).agg(F.min(F.struct("doc_id", "text_id")).alias("row"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    # From here on a number stands for the digest of a class, and the registers are kept once.
    classes = stored(classes.withColumn("fp", F.monotonically_increasing_id()), "near-classes")
    signed = stored(whole.select("doc_id", "text_id", "n_shingles", F.col("fp").alias("digest")), "near-digests")
    release(whole)

    banded = classes.select("fp", F.posexplode("bands").alias("band", "value")).where("value <> -1")
    banded = banded.select(F.xxhash64("band", "value").alias("group"), "fp", F.lit(1).cast("long").alias("weight"))
    clusters = spanning(banded, coded(classes), BUCKET_ROWS, bucket_links(percent))

    grouped = stored(clusters.join(classes.select("fp", "digest", "n", "row"), "fp").select(F.col("tree").alias("group"), "fp", "digest", (F.col("n") + ROW).alias("weight"), "row"), "near-clusters")
    # Few rows are sent to the documents, so that no text is shuffled that is in no cluster.
    rows = _sent(grouped.select("fp", "digest", F.col("row.doc_id").alias("r_doc"), F.col("row.text_id").alias("r_text")))
    # The texts of the sets: a set has 16 bytes for each word, which no codec makes less.
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sets = texts.join(rows, texts["doc_id"].eqNullSafe(rows["r_doc"]) & (row_id(F.col("text")) == rows["r_text"])).select("fp", "digest", "text")
    # Only where a row of a cluster is repeated with its id has its text to be found once more by a shuffle of texts.
    found = signed.join(rows, signed["doc_id"].eqNullSafe(rows["r_doc"]) & (signed["text_id"] == rows["r_text"]), "left_semi")
    sets = stored(sets.distinct() if found.count() > grouped.count() else sets, "near-sets")
    roots = spanning(grouped.select("group", "fp", "weight"), sets, CLUSTER_SHINGLES, cluster_links(percent, width)).withColumnRenamed("tree", "top")

    tops = classes.select("fp", "digest", "least").join(roots, "fp", "left").withColumn("top", F.coalesce("top", "fp"))
    ids = stored(tops.groupBy("top").agg(F.min("least").alias("component_id")).join(tops.select("digest", "top"), "top").select("digest", "component_id"), "near-components")
    found = signed.join(ids, "digest", "left")
    found = found.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return found.select("doc_id", "text_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"), width=3, percent=85).drop("text_id")
