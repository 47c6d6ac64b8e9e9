"""Word and shingle hashes of whole texts, a slice of many texts at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tessera.llm._shared import text_slices

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.frombuffer(hashlib.shake_256(b"byte values").digest(2048), np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2 ** 64, kept between calls."""
    if len(_POWERS[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(n + n // 4, b, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return [_POWERS[0][:n], _POWERS[1][:n]]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each 64-bit number over all of it."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """``s`` such that ``(s[b] - s[a]) * inverse ** a`` depends on the bytes from a to b only."""
    up, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=out[1:])
    return out


def word_spans(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Where words start and end, the words as binary strings, and their number before each row's end (with a leading 0)."""
    solid = ~_IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[ends] = True
    a = np.flatnonzero(solid & (edge[:-1] | ~np.concatenate([[False], solid[:-1]])))
    b = np.flatnonzero(solid & (edge[1:] | ~np.concatenate([solid[1:], [False]]))) + 1
    at = np.concatenate([[0], np.cumsum(b - a)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer(at), pa.py_buffer(raw[solid])])
    return a, b, words, np.searchsorted(a, ends)


#: Digests of words met before, by task.
_KNOWN: dict[bytes, bytes] = {}


def word_digests(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each word, A-Z lower-cased, as two columns, and the number of words before each row's end (with a leading 0).

    Words are told apart as they are, and each different one is digested once with a key, so no two words are built to
    have the same bits.
    """
    _, _, words, upto = word_spans(_LOWER[raw], ends)
    words = words.dictionary_encode()
    if len(_KNOWN) > 200_000:
        _KNOWN.clear()
    digests = []
    for w in words.dictionary.to_pylist():
        if w not in _KNOWN:
            _KNOWN[w] = hashlib.blake2b(w, digest_size=16, key=b"words").digest()
        digests.append(_KNOWN[w])
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)[words.indices.to_numpy()], upto


def joined(words: np.ndarray, width: int) -> np.ndarray:
    """128 bits for each ``width`` neighbouring words from their own 128.

    Both lanes are mixed between words, each with the other, so that no words are found to cancel out as they do in a sum.
    """
    n = len(words) - width + 1
    one, two = np.full(n, width, np.uint64), np.zeros(n, np.uint64)
    for k in range(width):
        one = mixed(one + words[k : n + k, 0])
        two = mixed(two + words[k : n + k, 1] ^ one)
        one ^= two
    return np.stack([one, two], axis=1)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Each row's distinct shingles, 128 bits in two columns, in order of the first.

    Fewer words than ``width`` make one shingle; no words, none.
    """
    for first, end, raw, ends in text_slices(column):
        words, upto = word_digests(raw, ends)
        every = joined(words, width) if len(words) >= width else None
        for r in range(end - first):
            a, b = int(upto[r]), int(upto[r + 1])
            if b - a >= width:
                own = every[a : b - width + 1]
                own = own[np.argsort(own[:, 0], kind="stable")]
                same, other = own[1:, 0] == own[:-1, 0], own[1:, 1] != own[:-1, 1]
                if (same & other).any():
                    own = own[np.lexsort((own[:, 1], own[:, 0]))]
                    same, other = own[1:, 0] == own[:-1, 0], own[1:, 1] != own[:-1, 1]
                fresh = np.concatenate([[True], ~same | other])
                yield own[fresh]
            elif b > a:
                yield joined(words[a:b], b - a)
            else:
                yield np.zeros((0, 2), np.uint64)
