import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import exact_dedup
from tests.llm import cases


def brute(docs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for d in docs:
        groups[norm(d[1])].append(d[0])
    return sorted((d[0], min(groups[norm(d[1])]), len(groups[norm(d[1])]), d[0] == min(groups[norm(d[1])]), hashlib.sha256(norm(d[1]).encode()).hexdigest()) for d in docs)


@pytest.mark.parametrize("capacity", [4096, 3])
def test_same_as_brute_force(spark, capacity):
    rows = exact_dedup.dedup(cases.table(spark), capacity=capacity).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.sha.hex()) for r in rows) == brute(cases.documents())


def test_null_ids_come_last_and_empty_table(spark):
    rows = [(None, "same") + cases.documents()[0][2:], (5, "same") + cases.documents()[0][2:], (None, "alone") + cases.documents()[0][2:]]
    got = {(r.doc_id, r.group_size): (r.keep_id, r.kept) for r in exact_dedup.dedup(cases.table(spark, rows)).collect()}
    assert got == {(None, 2): (5, False), (5, 2): (5, True), (None, 1): (None, True)}
    assert exact_dedup.dedup(cases.empty(spark)).count() == 0


def weigher(counts):
    """Weights of 64-bit keys by prefix, as the operator gathers them."""

    def weigh(bits, over):
        found = defaultdict(lambda: [0, 0])
        for k, n in counts.items():
            if bits == exact_dedup.FIRST_BITS or k >> (64 - bits + exact_dedup.MORE_BITS) in over:
                found[k >> (64 - bits)][0] += n
                found[k >> (64 - bits)][1] += 1
        return {p: (n, min(2, k)) for p, (n, k) in found.items()}

    return weigh


@pytest.mark.parametrize("shift", [56, 40, 36])
def test_directory_splits_and_doubles(shift):
    """Keys that differ in their first bits only, and some that differ only after 16 or 20 bits."""
    counts = {k << shift: 10 for k in range(256)}
    made = exact_dedup.Directory.build(weigher(counts), 100)
    assert len(made.entries) == 1 << made.depth
    assert made.depth > {56: 3, 40: 19, 36: 23}[shift]
    load = [0] * len(made.local)
    for b, n in zip(made.bucket(np.array(list(counts), np.uint64).view(np.int64)).tolist(), counts.values(), strict=True):
        load[b] += n
    assert max(load) <= 100 and sum(load) == 2560
    assert exact_dedup.Directory.build(weigher({7 << 48: 10_000}), 100).depth == 0


def test_collisions_chain():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 1, 2]), pa.array([10, 11, 12, 13]), pa.array([b"a", b"b", b"a", b"a"])], names=["key", "rep", "text"])
    assert [x for b in exact_dedup.chains(iter([batch])) for x in b.column(2).to_pylist()] == [0, 1, 0, 0]
