"""A Bloom filter of 64-bit keys that is built in the cluster and tested in Arrow batches."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and 64-bit words of a filter at most (256 MB). With more keys than those are for, more keys that
#: aren't in it pass; none that is in it fails, so what passes is joined by key afterwards.
BITS, MOST_WORDS = 16, 1 << 25
#: Places of the 64-bit key from which the three bits within a word are taken.
_PLACES = (40, 46, 52)


def bloom(keys: DataFrame, bits: int = BITS, most_words: int = MOST_WORDS) -> np.ndarray:
    """The words of a filter of keys(key bigint); all three bits of a key lie in one word.

    The words are aggregated before and after one shuffle; at most most_words of them come to the driver.
    """
    n = keys.agg(F.approx_count_distinct("key")).first()[0]
    size = 64
    while size < most_words and size * 64 < n * bits:
        size *= 2
    mask = F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned(key, {p}) & 63L as int))" for p in _PLACES))
    found = keys.select(F.col("key").bitwiseAND(size - 1).alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(size, np.uint64)
    words[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return words


def passing(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Positions of the keys (uint64) that may be in the filter."""
    at = np.arange(len(keys))
    own = words[keys & np.uint64(len(words) - 1)]
    for p in _PLACES:
        bit = (own >> ((keys >> np.uint64(p)) & np.uint64(63))) & np.uint64(1)
        hit = np.flatnonzero(bit)
        at, own, keys = at[hit], own[hit], keys[hit]
    return at
