"""Whether a text holds a quote, exactly or nearly."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

# Marks that count in a quote, numbers that must be the same, the least ratio and the least length for it.
MARKS = frozenset("./:\\-_")
NUMBER = re.compile(r"\d+(?:[.:/-]\d+)*")
LEAST, SHORTEST = 0.80, 6


class _Kept(dict):
    """Which characters count, as they are met."""

    def __missing__(self, code: int) -> int | None:
        c = chr(code)
        self[code] = None if c.isspace() or c not in MARKS and unicodedata.category(c)[0] in "PZ" else code
        return self[code]


_KEPT = _Kept()


def bare(text: str) -> str:
    """A text in one case without spaces and punctuation."""
    return unicodedata.normalize("NFKC", text).casefold().translate(_KEPT)


def near_ends(quote: str, source: str, most: int) -> list[bool]:
    """For each place of ``source``, whether a stretch that ends there is at most ``most`` edits from the quote.

    All rows of the edit table's column are one number, whose bits go up and down together.
    """
    top, every = 1 << len(quote) - 1, (1 << len(quote)) - 1
    places: dict[str, int] = {}
    for i, c in enumerate(quote):
        places[c] = places.get(c, 0) | 1 << i
    up, down, score, near = every, 0, len(quote), []
    for c in source:
        same = places.get(c, 0)
        across = ((same & up) + up ^ up) | same
        plus, minus = down | ~(across | up) & every, up & across
        score += (plus & top > 0) - (minus & top > 0)
        plus, minus, same = plus << 1 & every, minus << 1 & every, same | down
        up, down = minus | ~(same | plus) & every, plus & same
        near.append(score <= most)
    return near


def holds(quote: str | None, text: str | None) -> bool:
    """Whether the bare quote is in the bare text, or near to one of the windows of its length, an eighth of it apart.

    Near is a ratio of 0.80 with the same numbers in order; two strings of length m that near are at most 0.4 m edits
    apart, so windows that end where no stretch is that near are not compared.
    """
    quote, source = bare(quote or ""), bare(text or "")
    if not quote or not source:
        return False
    if quote in source:
        return True
    if len(quote) < SHORTEST:
        return False
    numbers = NUMBER.findall(quote)
    near = lambda w: NUMBER.findall(w) == numbers and difflib.SequenceMatcher(None, quote, w, autojunk=False).ratio() >= LEAST
    if len(quote) >= len(source):
        return near(source)
    size, last = len(quote), len(source) - len(quote)
    ends = near_ends(quote, source, int(0.4 * size + 1e-9))
    starts = [*range(0, last + 1, max(1, size // 8)), last]
    return any(ends[s + size - 1] and near(source[s : s + size]) for s in starts)


@F.pandas_udf(BooleanType())
def quoted_in(quote: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([holds(q, t) for q, t in zip(quote, text, strict=True)], dtype=bool)
