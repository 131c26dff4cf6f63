"""Filters over 64-bit keys: a bounded number of bits that say which keys may be in a distributed table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits for each key, and the most bits of a filter (16 MB). A fuller filter only lets more keys pass.
BITS_PER_KEY, MOST_BITS = 16, 1 << 27


def key_filter(keys: DataFrame, count: int) -> np.ndarray:
    """The filter over keys (key long; count rows): two bits of one word a key. It is put together by an aggregate over
    words, so that what reaches the driver is MOST_BITS at most."""
    words = 1 << 10
    while words * 64 < min(MOST_BITS, BITS_PER_KEY * count):
        words *= 2
    bits = F.expr("shiftleft(1L, cast(shiftrightunsigned(key, 40) & 63 as int)) | shiftleft(1L, cast(shiftrightunsigned(key, 46) & 63 as int))")
    got = keys.groupBy(F.pmod("key", F.lit(words)).alias("word")).agg(F.bit_or(bits).alias("bits")).toArrow()
    out = np.zeros(words, np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


def may_hold(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (64-bit integers of either sign) the filter may hold; it never says no to one of its own."""
    k = keys.view(np.uint64)
    six = np.uint64(63)
    word = filter_[(k & np.uint64(len(filter_) - 1)).astype(np.int64)]
    return (word >> (k >> np.uint64(40) & six) & (word >> (k >> np.uint64(46) & six)) & np.uint64(1)).astype(bool)


def maybe(held: Broadcast, key: Column) -> Column:
    """may_hold() of a column of keys, without nulls, for a broadcast filter."""

    @F.arrow_udf(T.BooleanType())
    def run(keys: pa.Array) -> pa.Array:
        return pa.array(may_hold(held.value, keys.to_numpy()))

    return run(key)
