"""Exact membership tests against long lists, with a Bloom filter before the shuffle."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD_BITS = 64


def _positions(key: Column, bits: int, hashes: int) -> list[Column]:
    """The bit positions of a key: hashes of its hash, so that the text is read once."""
    return [F.xxhash64(F.xxhash64(key), F.lit(i)).bitwiseAND(F.lit(bits - 1)) for i in range(hashes)]


def bloom_filter(keys: DataFrame, key: str, bits: int, hashes: int = 5) -> DataFrame:
    """One row ``words``: the filter as ``bits / 64`` longs, whatever the number of keys.

    Each task reduces its keys to at most that many words before the shuffle, and words of different
    tasks are combined by or. ``bits`` is a power of two of at least 64.
    """
    if bits < _WORD_BITS or bits & (bits - 1):
        raise ValueError("bits must be a power of two of at least 64")
    spark = keys.sparkSession
    at = keys.where(F.col(key).isNotNull()).select(F.explode(F.array(*_positions(F.col(key), bits, hashes))).alias("p"))
    own = at.select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
    # Every word once, so that a word's place in the list is its number.
    every = spark.range(bits // _WORD_BITS).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    words = own.union(every).groupBy("w").agg(F.bit_or("b").alias("b"))
    listed = F.array_sort(F.collect_list(F.struct("w", "b")))
    return words.agg(F.transform(listed, lambda x: x["b"]).alias("words"))


def might_hold(words: DataFrame, key: Column, bits: int, hashes: int = 5) -> Column:
    """False only for keys that are surely not in the filter; null for a null key.

    The filter reaches the tasks as the value of a scalar subquery.
    """
    value = words.scalar()
    tests = [F.getbit(F.get(value, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1
             for p in _positions(key, bits, hashes)]
    return F.when(key.isNotNull(), reduce(Column.__and__, tests))


def drop_denied_large(
    df: DataFrame, deny: DataFrame, on: str = "sentence", max_bytes: int = 8 << 20,
    bits_per_key: int = 10,
) -> DataFrame:
    """Rows whose exact text is not denied, for lists too long to broadcast. Rows without text stay.

    Rows that the filter clears are kept where they lie; only possible hits, the denied rows and
    about one in a hundred others, go through the exact anti join, so the shuffle grows with the
    hits. The filter's size follows from the distinct keys; above ``max_bytes`` it is not built and
    all rows are joined. ``df`` is read twice, so it should be stored if it is costly.
    """
    keys = deny.select(on).where(F.col(on).isNotNull()).distinct()
    bits = filter_bits(keys.count(), bits_per_key)
    if bits // 8 > max_bytes:
        return df.join(keys, on, "left_anti").select(*df.columns)
    maybe = F.coalesce(might_hold(bloom_filter(keys, on, bits), F.col(on), bits), F.lit(False))
    hits = df.where(maybe).join(keys, on, "left_anti").select(*df.columns)
    return df.where(~maybe).unionAll(hits)


def filter_bits(n: int, bits_per_key: int = 10) -> int:
    """The next power of two of at least ``bits_per_key`` bits for each of ``n`` keys."""
    return 1 << max(6, math.ceil(math.log2(max(1, n * bits_per_key))))
