import hashlib
import random
import zlib

import duckdb
import pytest

from tessera.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth int, n double"


def turns(n=250, seed=4):
    """Conversations that share first turns in many ways, copies, null and equal turn numbers, gaps among the bases."""
    rng, rows = random.Random(seed), []
    said = ["", None, "yes", "no", "é日🙂", "again?", "x" * 40]
    for i in range(n):
        if i in (100, 203):
            continue
        for t in range(rng.choice([1, 2, 3, 5, 8])):
            text = "hello" if t == 0 and i % 3 else rng.choice(said) if i % 5 else "common"
            rows.append((i, t, rng.choice(["user", "assistant", None]) if i % 5 else "user", text))
    rows += [(7, None, "user", "first of all"), (8, 0, "user", "tie"), (8, 0, "user", "tie"), (8, 0, "a", "tie"), (None, 0, "user", "lost"), (-5, 0, "user", "below"), (70_000, 0, "user", "hello")]
    rows += [(1000, t, "user", "long" if t % 7 else f"t{t}") for t in range(900)]
    rng.shuffle(rows)
    return [(*r, "other", 1, 0.5) for r in rows]


def brute(rows, shared=True):
    own = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append(((t is not None, t or 0), key, (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    if shared:
        sized = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
        own = {c: own.get(int(c / 100) * 100, [])[: sized[c]] + v[sized[c] :] for c, v in own.items()}
    members, kids = {}, {}
    for c, v in own.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
            if d:
                kids.setdefault(tuple(v[: d - 1]), set()).add(tuple(v[:d]))
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids.get(k, ())) or 1
        saved[k] = sum(saved[x] for x in kids.get(k, ())) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(own[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, ())), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("sizes", [None, (60, 7), (3, 2)])
def test_same_as_brute_force(spark, monkeypatch, sizes):
    if sizes:
        monkeypatch.setattr(prefix_trie, "SHARD_TURNS", sizes[0])
        monkeypatch.setattr(prefix_trie, "ID_SPAN", sizes[1])
    rows = turns()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(str(tuple(r)) for r in prefix_trie.conversation_trie(df).collect()) == brute(rows, False)
    got = prefix_trie.trie(prefix_trie.with_shared_heads(prefix_trie.turn_lists(df))).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)


def test_query_is_its_sql(spark, tmp_path):
    rows = [r for r in turns() if r[0] != 1000]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = prefix_trie.query(spark, str(tmp_path))
    want = con.sql(prefix_trie.ORACLE_SQL)
    assert got.columns == want.columns
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, want.fetchall())) == brute(rows)


def test_no_conversations(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, 1, "user", "x", "", 1, 1.0)]
    assert prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).count() == 0
    only = [(4, 0, None, None, "", 1, 1.0)]
    assert sorted(str(tuple(r)) for r in prefix_trie.conversation_trie(spark.createDataFrame(only, SCHEMA)).collect()) == brute(only, False)


def test_medians_and_shared_turns():
    assert sorted(prefix_trie.medians(10)) == list(range(10)) and list(prefix_trie.medians(3)) == [1, 0, 2]
    a, b, c = (bytes([x]) * prefix_trie.KEY for x in (1, 2, 3))
    assert [prefix_trie.shared_turns(*p) for p in ((None, a), (b"", a), (a + b, a + c), (a + b, a + b + c), (a, b))] == [-1, 0, 1, 2, 0]
