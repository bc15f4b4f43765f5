"""Bit filters of the values of a column, made by a distributed aggregate and broadcast to Arrow batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each value, and bits at least and at most (16 MB): beyond those more values pass by mistake, which costs time and changes nothing.
BITS_EACH, LEAST, MOST = 16, 1 << 16, 1 << 27


def bit_filter(df: DataFrame, column: str) -> np.ndarray:
    """A bit for each non-null 64-bit value of column, modulo a size that follows their count. What passes by mistake must be joined away later."""
    size, wanted = LEAST, BITS_EACH * df.count()
    while size < min(MOST, wanted):
        size *= 2
    value = F.col(column)
    words = df.filter(value.isNotNull()).select(F.shiftright(value.bitwiseAND(F.lit(size - 1)), 6).alias("word"), F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value may be one of the filter's."""
    slot = values & np.int64(64 * len(bits) - 1)
    return (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) != 0
