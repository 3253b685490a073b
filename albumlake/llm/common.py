"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, delete, materialize, shared_dir  # noqa: F401  shared with the rest

#: Fixed value: characters that separate words (space and U+0009 to U+000D).
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-separators, as long."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column of an Arrow batch; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b or b"" for b in column.cast(kind).to_pylist()]


def slices(batch: pa.RecordBatch, rows: int = 2000):
    """The batch in pieces of at most ``rows`` rows, which bounds a worker's working memory."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def bitmap(keys: DataFrame, position: Column, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` bits with those set that ``position`` gives for the rows.

    Positions are gathered as 64-bit words, so at most bits / 64 rows reach the driver.
    """
    word = keys.select(position.alias("p")).groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[word["w"].to_numpy(np.int64)] = word["b"].to_numpy(np.int64).view(np.uint64)
    return out


def bitmap_bits(n: int, most: int) -> int:
    """A power of two of about 16 bits for each of ``n`` keys, within a bound."""
    bits = 1 << 12
    while bits < min(16 * n, most):
        bits *= 2
    return bits


def in_bitmap(bits: np.ndarray, at: int) -> bool:
    return bool(bits[at >> 6] >> np.uint64(at & 63) & np.uint64(1))


def runs(values: np.ndarray) -> np.ndarray:
    """Start of every run of equal values in a sorted array."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)


def pieces(batch: pa.RecordBatch, column: str = "text", size: int = 4 << 20, rows: int = 2000):
    """The batch in pieces of at most ``rows`` rows and about ``size`` bytes of text; a longer text is alone in its piece."""
    length = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(length.tolist()):
        if i > start and (total + n > size or i - start >= rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)
