"""Deterministic hashes: the same row always lands in the same split or salt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = 4294967296
MULTIPLIER = 2654435761
HIGH_MULTIPLIER = 2246822519


def spread(key: Column, dtype: T.DataType, seed: int = 42) -> Column:
    """BIGINT in [0, 2^32), near uniform over keys.

    Integer keys use a multiplicative hash of both halves in plain arithmetic, so any SQL engine can
    check the split; other keys use xxhash64. The high bits are the well mixed ones: take parts with
    `part_of`, not with a remainder.
    """
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        whole = key.cast("bigint")
        # the seed is added to the low half and carried, so keys at either end of BIGINT don't overflow
        moved = F.pmod(whole, F.lit(SPAN)) + F.lit(seed)
        top = F.pmod(F.shiftright(whole, 32) + F.shiftright(moved, 32), F.lit(SPAN >> 1))
        low = F.pmod(F.pmod(moved, F.lit(SPAN)) + F.pmod(top * HIGH_MULTIPLIER, F.lit(SPAN)), F.lit(SPAN))
        # two 16-bit halves keep the product inside BIGINT for every key
        high, rest = F.floor(low / 65536).cast("bigint"), F.pmod(low, F.lit(65536))
        part = F.pmod(high * MULTIPLIER, F.lit(SPAN)) * 65536 + rest * MULTIPLIER
        return F.pmod(part, F.lit(SPAN))
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(SPAN))


def part_of(h: Column, parts: int) -> Column:
    """Part 0 to parts - 1 of a hash in [0, 2^32), from its high bits."""
    return F.shiftright(h * F.lit(parts), 32).cast("int")
