"""Bitmaps that Spark builds, for filters of a bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_BITS = 32_768  # of Spark's bitmap functions


def bitmap(rows: DataFrame, positions: list[Column], size: int) -> bytes:
    """A bitmap of ``size`` bits, the lowest of each byte first, with the bits at all positions of all rows set.

    Buckets of 4 KB are aggregated and collected, so the driver gets ``size`` bits.
    """
    at = rows.select(F.explode(F.array(*[p + 1 for p in positions])).alias("at"))  # Spark's bitmaps count from 1
    found = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    whole = bytearray(-(-size // BUCKET_BITS) * BUCKET_BITS // 8)
    for r in found:
        start = (r["bucket"] - 1) * BUCKET_BITS // 8
        whole[start : start + len(r["bits"])] = r["bits"]
    return bytes(whole[: -(-size // 8)])


#: Bits of a filter for each key, and at most.
FILTER_BITS_A_KEY, FILTER_BITS = 8, 1 << 28


def key_filter(keys: DataFrame, key: Column) -> np.ndarray:
    """A bitmap with two bits for each key, a uniform hash: 8 bits a key, and 32 MB at most.

    Beyond that size it lets more through, which costs time and no result.
    """
    size = min(FILTER_BITS, 1 << max(16, (keys.count() * FILTER_BITS_A_KEY - 1).bit_length()))
    places = [part.bitwiseAND(F.lit(size - 1)) for part in (key, F.shiftrightunsigned(key, 32))]
    return np.frombuffer(bitmap(keys, places, size), np.uint8)


def maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter has each key; one that it lacks is none of its keys."""
    size = np.uint64(len(bits) * 8 - 1)
    out = np.ones(len(keys), bool)
    for part in (keys, keys >> np.uint64(32)):
        at = part & size
        out &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out
