"""The trie of conversations' prefixes: ternary search trees over range shards, merged at the shards' edges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._shared import stored, table

#: Turns of one shard, and ids of one row of a sequence's members.
SHARD_TURNS, ID_SPAN = 100_000, 65_536
#: Bytes of a turn's key in a path, and the most nodes of shards' edges that are broadcast.
KEY, MOST_EDGES = 16, 100_000

NODE = "node binary, depth long, conv_id long, parent binary, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turn_lists(turns: DataFrame) -> DataFrame:
    """``base, conv_id, turns`` for each conversation: 128-bit keys of its turns and their code points, by turn (null first).

    Turns of one number are ordered by key. A key digests role and text, null ones as empty. All conversations of
    one hundred ids are in one partition, so that what they share is joined where it is. A conversation's keys are one
    row; its texts are not shuffled.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY))
    rows = turns.where("conv_id is not null").select((F.col("conv_id") - F.col("conv_id") % 100).alias("base"), "conv_id", F.struct("turn", key.alias("key"), F.length(text).alias("chars")).alias("t"))
    return rows.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def with_shared_heads(lists: DataFrame, most: int = 6) -> DataFrame:
    """Conversations rebuilt: the first h turns of the first conversation of their hundred, then their own after h."""
    heads = lists.where("conv_id = base").select("base", F.slice("turns", 1, most - 1).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most)).cast("int")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return lists.join(heads, "base", "left").select("conv_id", F.concat(F.slice(F.coalesce("head", F.array().cast(lists.schema["turns"].dataType)), F.lit(1), h), own).alias("turns"))


def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows ``path, sizes, span, n, least, ids``: one row for each path, with a digest of all its ids in order."""
    path = held = digest = None
    total = first = 0
    for batch in batches:
        rows = {c: [] for c in ("path", "sizes", "n", "least", "ends_sha256")}
        for new, sizes, _, n, least, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if new == path:
                digest.update(b"," + ids.encode())
                total += n
                continue
            if path is not None:
                for c, v in zip(rows, (path, held, total, first, digest.hexdigest()), strict=True):
                    rows[c].append(v)
            path, held, total, first, digest = new, sizes, n, least, hashlib.sha256(ids.encode())
        yield _paths(rows)
    if path is not None:
        yield _paths({"path": [path], "sizes": [held], "n": [total], "least": [first], "ends_sha256": [digest.hexdigest()]})


def _paths(rows: dict) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows))


class Tree:
    """A ternary search tree over turn codes. Each of its nodes is a prefix; node 0 is the empty one."""

    def __init__(self):
        self.code, self.low, self.equal, self.high, self.parent = [-1], [-1], [-1], [-1], [-1]

    def _add(self, code: int, parent: int) -> int:
        for values, v in ((self.code, code), (self.low, -1), (self.equal, -1), (self.high, -1), (self.parent, parent)):
            values.append(v)
        return len(self.code) - 1

    def insert(self, codes: list[int]) -> list[int]:
        """The nodes of a sequence's prefixes, the root first."""
        code, low, equal, high = self.code, self.low, self.equal, self.high
        node, nodes = 0, [0]
        for c in codes:
            at, side, last = equal[node], equal, node
            while at >= 0 and code[at] != c:
                side, last = (low, at) if c < code[at] else (high, at)
                at = side[at]
            if at < 0:
                at = side[last] = self._add(c, node)
            node = at
            nodes.append(at)
        return nodes


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, each range's median before its halves."""
    ranges = [(0, n)]
    while ranges:
        a, b = ranges.pop()
        if a < b:
            m = (a + b) // 2
            yield m
            ranges += [(m + 1, b), (a, m)]


def shared_turns(a: bytes | None, b: bytes | None) -> int:
    """How many first turns two paths share; -1 without a path."""
    if a is None or b is None:
        return -1
    x, y = (np.frombuffer(p[: min(len(a), len(b)) // KEY * KEY], np.uint8).reshape(-1, KEY) for p in (a, b))
    same = (x == y).all(axis=1)
    return len(same) if same.all() else int(np.argmin(same))


def shard_nodes(rows: pa.Table, edges: pa.Table) -> pa.Table:
    """Nodes of one shard's paths. Those that other shards may have too carry a key and what this shard adds to them.

    Such nodes are prefixes of the first path that the path before it has, or of the last that the next has. A node is
    counted, as a child and with its text, by the first shard that has it; a path that the next one continues is no leaf.
    """
    rows = rows.sort_by("path")
    paths = rows["path"].to_pylist()
    before, after = (shared_turns(p, q) for p, q in ((edges["before"][0].as_py(), paths[0]), (edges["after"][0].as_py(), paths[-1])))
    _, codes = np.unique(np.frombuffer(b"".join(paths), f"S{KEY}"), return_inverse=True)
    ends = np.cumsum([0, *(len(p) // KEY for p in paths)]).tolist()
    codes, sizes = codes.tolist(), rows["sizes"].combine_chunks().flatten().to_pylist()

    tree, end_of = Tree(), [0] * len(paths)
    chars, at = [0], {}
    for j in medians(len(paths)):
        nodes = tree.insert(codes[ends[j] : ends[j + 1]])
        new = len(tree.code) - len(chars)
        chars += sizes[ends[j + 1] - new : ends[j + 1]]
        end_of[j] = nodes[-1]
        if j in (0, len(paths) - 1):
            at[j] = nodes

    n, parent = len(tree.code), tree.parent
    foreign = set(at[0][: before + 1])
    open_ = foreign | set(at[len(paths) - 1][: after + 1])
    convs, least, leaves, children, saved, depth = [0] * n, [None] * n, [0] * n, [0] * n, [0] * n, [0] * n
    sha: list[str | None] = [None] * n
    for x, k, first, digest in zip(end_of, rows["n"].to_pylist(), rows["least"].to_pylist(), rows["ends_sha256"].to_pylist(), strict=True):
        convs[x], least[x], sha[x] = k, first, digest
    continued = after * KEY == len(paths[-1])
    for x in range(n - 1, -1, -1):
        if tree.equal[x] < 0 and not (continued and x == end_of[-1]):
            leaves[x] = 1
        saved[x] += convs[x] * chars[x] - (0 if x in foreign else chars[x])
        p = parent[x]
        if p >= 0:
            convs[p] += convs[x]
            leaves[p] += leaves[x]
            saved[p] += saved[x]
            children[p] += x not in foreign
            if least[p] is None or least[x] < least[p]:
                least[p] = least[x]
    for x in range(1, n):
        depth[x] = depth[parent[x]] + 1

    keys: dict[int, bytes] = {}
    for j, nodes in at.items():
        digest = hashlib.blake2b(digest_size=KEY, key=b"prefix")
        for d, x in enumerate(nodes):
            if d:
                digest.update(paths[j][(d - 1) * KEY : d * KEY])
            if x not in open_:
                break
            keys[x] = digest.copy().digest()
    own = [None if p < 0 or p in open_ else least[p] for p in parent]
    columns = ([keys.get(x) for x in range(n)], depth, least, [keys.get(p) for p in parent], own, convs, children, leaves, saved, sha)
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5, pa.string())
    return pa.table({f.split()[0]: pa.array(c, k) for f, c, k in zip(NODE.split(", "), columns, kinds, strict=True)})


def trie(lists: DataFrame) -> DataFrame:
    """Nodes of the trie of ``lists`` (``conv_id, turns`` of ``key`` and ``chars``); a node is a sequence of first turns.

    ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs`` (members), ``n_children``, ``n_leaves`` (of its
    subtree), ``saved_tokens`` (of its subtree: each node's members less one, times its last text's code points) and
    ``ends_sha256`` (of the members' ids that end there, ascending, comma-joined).

    Equal conversations are one path with a number, aggregated in spans of ids before they meet. Paths are range-sorted
    to shards of about SHARD_TURNS turns, however many share a first turn; a shard is a ternary search tree in one task, built median first. Nodes that
    several shards have, at most a path at each edge, are added up. Conversations without turns are members of the root
    only; no conversations, no nodes.
    """
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t.key)), ""))
    rows = lists.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t.chars).alias("sizes"))
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")), ",")
    rows = rows.groupBy("path", F.floor(F.col("conv_id") / ID_SPAN).alias("span")).agg(F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("least"), ids.alias("ids"))
    rows = stored(rows.select("path", "sizes", "span", "n", "least", "ids"), "trie-paths")
    turns = rows.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    ranged = rows.repartitionByRange(int(turns // SHARD_TURNS) + 1, "path").sortWithinPartitions("path", "span")
    ranged = ranged.mapInArrow(ended, "path binary, sizes array<int>, n long, least long, ends_sha256 string")
    ranged = stored(ranged.withColumn("shard", F.spark_partition_id()), "trie-shards")

    # One row a shard, so the window is over as many rows as there are shards.
    edges, by = ranged.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last")), Window.orderBy("shard")
    edges = edges.select("shard", F.lag("last").over(by).alias("before"), F.lead("first").over(by).alias("after"))
    nodes = ranged.groupBy("shard").cogroup(edges.groupBy("shard")).applyInArrow(shard_nodes, NODE)
    nodes = stored(nodes, "trie-nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = nodes.where("node is not null").groupBy("node").agg(F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.first("parent").alias("parent"), *sums, F.max("ends_sha256").alias("ends_sha256"))
    merged = stored(merged.withColumn("parent_conv_id", F.lit(None).cast("long")).select(nodes.columns), "trie-merged")

    above = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    above = F.broadcast(above) if merged.count() <= MOST_EDGES else above
    found = nodes.where("node is null").unionByName(merged).join(above, "parent", "left")
    none = hashlib.sha256(b"").hexdigest()
    return found.select("conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of a table of turns (``conv_id, turn, role, text``); rows without a conv_id belong to no conversation.

    Null roles and texts are empty ones; repeated rows are turns of their own; other columns are not read.
    """
    return trie(turn_lists(turns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(with_shared_heads(turn_lists(table(spark, sf_dir, "conversations"))))


ORACLE_SQL = """
with own as (
    select conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} order by turn nulls first,
        sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) as turns
    from conversations where conv_id is not null group by conv_id
), hashed as (
    select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda ch: ascii(ch)::bigint)),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295) % 6 as h
    from own
), rebuilt as (
    select a.conv_id, coalesce(b.turns, [])[1:a.h] || a.turns[a.h + 1:] as turns
    from hashed a left join own b on b.conv_id = a.conv_id - a.conv_id % 100
), prefixes as (
    select conv_id, d, turns[1:d] as prefix, len(turns) = d as ends from rebuilt, unnest(range(0, len(turns) + 1)) as r(d)
), nodes as (
    select prefix, d, min(conv_id) as conv_id, count(*) as n_convs, case when d > 0 then length(prefix[d].text) else 0 end as chars,
        coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '') as ends
    from prefixes group by prefix, d
), grown as (
    select u.*, v.conv_id as parent_conv_id, count(*) over (partition by u.prefix[1:u.d - 1], u.d) as siblings
    from nodes u left join nodes v on u.d > 0 and v.prefix = u.prefix[1:u.d - 1]
), counted as (
    select p.prefix, coalesce(max(c.siblings), 0) as n_children
    from grown p left join grown c on c.d = p.d + 1 and c.prefix[1:c.d - 1] = p.prefix group by p.prefix
), sums as (
    select u.prefix[1:j] as prefix, sum((u.n_convs - 1) * u.chars) as saved, count(*) filter (k.n_children = 0) as leaves
    from nodes u join counted k on k.prefix = u.prefix, unnest(range(0, u.d + 1)) as r(j) group by 1
)
select g.conv_id, g.d as depth, g.parent_conv_id, g.n_convs, k.n_children, s.leaves as n_leaves, s.saved::bigint as saved_tokens, sha256(g.ends) as ends_sha256
from grown g join counted k on k.prefix = g.prefix join sums s on s.prefix = g.prefix
"""
