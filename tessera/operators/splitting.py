"""Texts cut to a size at their own boundaries, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What ends a piece of prose (a blank line, a line, a mark with or without them), and of lines.
PROSE = "(?s).*?(?:[。！？!?；;]\\n\\s*\\n|[。！？!?；;]\\n|[。！？!?；;]|\\n\\s*\\n|\\n|$)"
LINES = "(?s).*?(?:\\n|$)"


def boundary(text: Column, lines: bool = False) -> Column:
    """Where to cut a text in two: at the end of a piece nearest the middle, the first of equals.

    Prose without an end inside is cut in the middle; lines without a line's end are not cut, which is null, and neither
    is a text of less than two characters.
    """
    n = F.length(text)
    middle = F.floor(n / 2)
    best = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("best"))

    def further(state: Column, piece: Column) -> Column:
        at = state["at"] + F.length(piece)
        fits = (F.length(piece) > 0) & (F.lit(True) if lines else at < n)
        if lines:
            fits = fits & F.endswith(piece, F.lit("\n"))
        nearer = state["best"].isNull() | (F.abs(at - middle) < F.abs(state["best"] - middle))
        return F.struct(at.alias("at"), F.when(fits & nearer, at).otherwise(state["best"]).alias("best"))

    found = F.aggregate(F.regexp_extract_all(text, F.lit(LINES if lines else PROSE), F.lit(0)), best, further)["best"]
    return F.when(n >= 2, found if lines else F.coalesce(found, middle.cast("int")))


def bisected(text: Column, target: int, depth: int = 3, lines: bool = False) -> Column:
    """The text as an array of pieces: those longer than ``target`` are cut in two, and again, at most ``depth`` times deep."""

    def halves(piece: Column) -> Column:
        at = F.transform(F.array(boundary(piece, lines)), lambda o: F.when(o.isNull(), F.array(piece)).otherwise(F.array(F.substring(piece, F.lit(1), o), F.substring(piece, o + 1, F.length(piece)))))
        return F.when(F.length(piece) > target, at[0]).otherwise(F.array(piece))

    pieces = F.array(text)
    for _ in range(depth):
        pieces = F.flatten(F.transform(pieces, halves))
    return F.when(text.isNotNull(), pieces)


def escaped_length(char: Column) -> Column:
    """How many characters JSON needs for one: two for quotes, backslashes and common controls, six for other controls."""
    two = char.isin('"', "\\", "\b", "\f", "\n", "\r", "\t")
    return F.when(two, 2).when(char < " ", 6).otherwise(1)


def fitted(text: Column, room: Column) -> Column:
    """The text as the longest pieces, from the front, whose JSON strings take at most ``room`` characters each.

    Null where a single character would not fit; an empty text is one piece.
    """
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("used"), F.lit(0).alias("at"))

    def further(state: Column, char: Column) -> Column:
        size = escaped_length(char)
        full = state["used"] + size > room
        ends = F.when(full, F.concat(state["ends"], F.array(state["at"]))).otherwise(state["ends"])
        return F.struct(ends.alias("ends"), F.when(full, size).otherwise(state["used"] + size).alias("used"), (state["at"] + 1).alias("at"))

    ends = F.aggregate(chars, start, further, lambda s: F.concat(F.array(F.lit(0)), s["ends"], F.array(s["at"])))
    cut = lambda e: F.transform(F.slice(e, F.lit(2), F.size(e) - 1), lambda end, i: F.substring(text, F.get(e, i) + 1, end - F.get(e, i)))
    pieces = F.transform(F.array(ends), cut)[0]
    return F.when(F.exists(chars, lambda c: escaped_length(c) > room) | (room < 0), None).otherwise(pieces)
