"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import table

# Fixed value: the pre-token pattern of the public byte-level vocabularies, with the white space of Unicode spelt out.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# Fixed value: the same pattern where every letter, digit and space of a text is one of these ranges.
_LETTER, _BLANK = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"\t-\r "
LATIN_PATTERN = rf" ?[{_LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^{_BLANK}{_LETTER}0-9]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
NOT_LATIN = rf"[^\x00-\x1b\x20-\x7f{_LETTER}]"
_NONE = 1 << 62


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """A tokenizer file as plain lookups: byte to id, pair of ids to rank, rank to merged id, id to bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab = file["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.first = [vocab[c] for c in letters]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(file["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[left] << 20 | vocab[right]] = rank
            self.made.append(vocab[left + right])
        self.special = {x["content"]: x["id"] for x in file.get("added_tokens", [])}
        self.bytes: dict[int, bytes] = {i: bytes(back[c] for c in t) for t, i in vocab.items() if i not in self.special.values()}
        self.bytes.update({i: t.encode() for t, i in self.special.items()})


def merge(word: bytes, merges: Merges) -> list[int]:
    """Token ids of one pre-token, by a segment tree over the ranks of its adjacent pairs.

    A leaf holds ``rank << 32 | place`` of the pair that begins at its place, an inner node the lesser of its two, so
    the root is the leftmost pair of lowest rank. A merge changes at most three leaves, and each change climbs only
    while it alters a node.
    """
    ids = [merges.first[b] for b in word]
    n = len(ids)
    if n < 2:
        return ids
    rank, made, none = merges.rank.get, merges.made, _NONE
    base = 1 << (n - 2).bit_length()
    tree = [none] * (2 * base)
    for i in range(n - 1):
        if (r := rank(ids[i] << 20 | ids[i + 1])) is not None:
            tree[base + i] = r << 32 | i
    for i in range(base - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (least := tree[1]) != none:
        i = least & 0xFFFFFFFF
        j = after[i]
        k = after[i] = after[j]
        h = before[i]
        new = ids[i] = made[least >> 32]
        ids[j] = -1
        places = [i]
        if k < n:
            before[k] = i
            places = [i, j]
        if h >= 0:
            places.append(h)
        for at in places:
            r = rank(ids[at] << 20 | ids[after[at]]) if at != j and after[at] < n else None
            value = none if r is None else r << 32 | at
            at += base
            if tree[at] == value:
                continue
            tree[at] = value
            while at > 1:
                other = tree[at ^ 1]
                at >>= 1
                if other < value:
                    value = other
                if tree[at] == value:
                    break
                tree[at] = value
    return [x for x in ids if x >= 0]


class Encoder(dict):
    """Packed ids by pre-token. At most ``most`` short pre-tokens are remembered, so that memory is bounded."""

    def __init__(self, path: str, most: int = 400_000):
        super().__init__()
        self.merges, self.most = Merges(path), most
        self.any, self.latin, self.odd = regex.compile(PATTERN), re.compile(LATIN_PATTERN), re.compile(NOT_LATIN)
        special = sorted(self.merges.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def __missing__(self, word: str) -> bytes:
        ids = merge(word.encode(), self.merges)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = packed
        return packed

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text; the plainer pattern, which is faster, where it means the same."""
        return (self.any if self.odd.search(text) else self.latin).findall(text)

    def encode(self, text: str) -> bytes:
        parts = self.cut.split(text) if self.cut else [text]
        if len(parts) == 1:
            return b"".join(map(self.__getitem__, self.words(text)))
        out = []
        for part in parts:
            if part in self.merges.special:
                out.append(np.array([self.merges.special[part]], dtype="<u4").tobytes())
            elif part:
                out.extend(map(self.__getitem__, self.words(part)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.merges.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a Python worker, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text and decode its ids again.

    Returns ``doc_id``, ``n_tokens``, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded``. There is no
    shuffle: a task reads its rows in Arrow batches and keeps a bounded memory of pre-tokens. A special token's
    string in a text is that token, as in the public library. Null and empty texts have no tokens and decode to the
    empty string; a long text without a break is one pre-token, merged in logarithmic steps. Repeated rows and rows
    without an id each give a row; extra columns are not read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                ids = [coder.encode(t) if t else b"" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(coder.decode, ids), pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, f"doc_id {kind}, n_tokens long, ids binary, decoded string")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(table(spark, sf_dir, "documents"), default_tokenizer()))
