"""Expressions and batch helpers for the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.sources.scratch import stored
from tessera.sources.tables import table

__all__ = ["SPACE", "WORD", "row_id", "stored", "table", "text_slices", "word_count"]

#: Words are separated by these six code points and nothing else.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_id(text: Column) -> Column:
    """Tells rows that share a doc_id but not a text apart; equal rows stay equal."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def text_slices(column: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into slices of about ``most`` bytes (one row at least).

    Yields first row, end row, the slice's bytes, and its row offsets into those bytes; null counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, at, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    ends = np.frombuffer(at, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(ends, ends[first] + most, side="right")) - 1)
        end = min(end, len(column))
        yield first, end, raw[ends[first] : ends[end]], ends[first : end + 1] - ends[first]
        first = end
