"""Bit maps of 64-bit keys, for tasks to tell what cannot be among them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each key, as a power of two.
ROOM = 4
LEAST_BITS = 16


def bits_for(n: int) -> int:
    return max(LEAST_BITS, int(max(n, 1) - 1).bit_length() + ROOM)


class Filter:
    """The leading bits of each key of a column `key`. A few other keys pass too."""

    def __init__(self, keys: DataFrame, most: int, n: int | None = None):
        """most: bits at most, as a power of two."""
        self.bits = min(most, bits_for(keys.count() if n is None else n))
        place = F.shiftrightunsigned("key", 64 - self.bits) + 1
        found = keys.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m"))
        self.map = np.zeros((1 << self.bits) // 8, np.uint8)
        for r in found.toLocalIterator():
            self.map[(r.b - 1) * 4096 : r.b * 4096] |= np.frombuffer(bytes(r.m), np.uint8)[: len(self.map) - (r.b - 1) * 4096]

    @staticmethod
    def fits(keys: DataFrame, most: int) -> bool:
        return bits_for(keys.count()) <= most

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint64(64 - self.bits)
        return (self.map[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def passing(self, keys: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.has(keys))


class Levels:
    """How many cells a key's rows are dealt into, by their number in a column `n`: enough that a cell has at most `spread`."""

    STEP = 16

    def __init__(self, keys: DataFrame, spread: int, most: int):
        self.levels: list[Filter] = []
        top = spread
        while (n := (large := keys.filter(F.col("n") > top)).count()):
            self.levels.append(Filter(large, most, n))
            top *= self.STEP

    def of(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), np.int64)
        for k, level in enumerate(self.levels):
            out[level.has(keys)] = self.STEP ** (k + 1)
        return out
