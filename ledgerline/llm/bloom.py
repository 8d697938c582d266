"""Bloom filters of a fixed size over 64-bit hashes, built by Spark and probed in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter: 2 MB whatever the data. A fuller filter lets more through to the exact join behind it.
BITS = 1 << 24
MIX = 0x9E3779B97F4A7C15


def bloom(hashes: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """The filter's 64-bit words; at most bits / 64 rows reach the driver, whatever the number of hashes."""
    place = F.explode(F.array(F.col(column).bitwiseAND(bits - 1), F.shiftrightunsigned(column, 32).bitwiseAND(bits - 1)))
    words = hashes.where(F.col(column).isNotNull()).select(place.alias("at")) \
        .groupBy(F.shiftright("at", 6).alias("word")) \
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    out = np.zeros(bits >> 6, np.int64)
    for r in words.toLocalIterator():
        out[r.word] = r.bits
    return out.view(np.uint64)


def maybe_in(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each uint64 hash may be in the filter; false means it is not."""
    mask = np.uint64((len(words) << 6) - 1)
    found = np.ones(len(hashes), bool)
    for at in (hashes & mask, (hashes >> np.uint64(32)) & mask):
        found &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return found
