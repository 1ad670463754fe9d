"""A bit map of keys that leaves most other rows out before they are shuffled to a join.

The map has a bounded size, whatever the number of keys. It only saves work: rows that it lets through by chance, all of
them where it is full, find no partner in the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 8 MB.
MOST_BITS = 1 << 26


def text_key(text_column: str) -> Column:
    """128 bits that tell texts apart; a null text counts as an empty one. Rows of one id are the same text if these are equal."""
    return F.unhex(F.md5(F.coalesce(F.col(text_column), F.lit(""))))


def slot(bits: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits))


def bit_map(table: DataFrame, *keys: str) -> np.ndarray:
    """The map of the keys of ``table``: 32 bits a row up to ``MOST_BITS``, as 64-bit words."""
    bits = min(MOST_BITS, max(1024, 1 << (32 * table.count()).bit_length()))
    place = table.select(slot(bits, *keys).alias("b"))
    words = place.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b & 63 AS INT))")).alias("v")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("v").to_numpy().view(np.uint64)
    return out


def bits_of(bitmap: np.ndarray) -> int:
    return len(bitmap) * 64


def among(bitmap: np.ndarray, slots: pa.Array) -> np.ndarray:
    """Which rows may have a key in the map."""
    at = slots.to_numpy()
    return (bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
