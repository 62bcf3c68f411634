"""Keeping only the rows whose key is in a set of ids, before an expensive step over them.

Without a shuffle of the rows at any size: a small set is broadcast, a larger one as a Bloom filter (a single row
that holds the bits as an array of longs). Above the largest filter the rows are left as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_IDS = 1_000_000  # keys of some 20 characters: at most about 100 MB in a task
BLOOM_IDS = 16_000_000  # at 8 bits an id, 16 MB
BITS_PER_ID, HASHES = 8, 3


def _places(key: str, words: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(64 * words)) for i in range(HASHES)]


def words_for(size: int) -> int:
    """64-bit words of a filter for so many ids: a power of two."""
    return 1 << (-(-max(1, size) * BITS_PER_ID // 64) - 1).bit_length()


def bloom_filter(ids: DataFrame, key: str, size: int) -> DataFrame:
    """One row with the array ``words``: the bits that the ids set."""
    words = words_for(size)
    places = ids.select(F.explode(F.array(*_places(key, words))).alias("place"))
    bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
    held = places.groupBy(F.expr("place div 64").alias("id")).agg(F.bit_or(bit).alias("word"))
    every = ids.sparkSession.range(words).join(held, "id", "left")
    pairs = F.sort_array(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0).cast("long")).alias("word"))))
    return every.agg(F.transform(pairs, lambda pair: pair["word"]).alias("words"))


def may_contain(key: str, words: Column, count: int) -> Column:
    """Whether the key may be among the ids of a filter of so many words: always true if it is."""
    bits = [F.getbit(F.get(words, F.floor(place / 64).cast("int")), F.pmod(place, F.lit(64)).cast("int")) for place in _places(key, count)]
    return reduce(Column.__and__, [bit == 1 for bit in bits])


def keep_candidates(
    rows: DataFrame,
    ids: DataFrame,
    key: str,
    size: int,
    broadcast_ids: int = BROADCAST_IDS,
    bloom_ids: int = BLOOM_IDS,
) -> DataFrame:
    """The rows whose ``key`` is among the ``size`` distinct ids, and maybe others, which an exact join must drop."""
    if size <= broadcast_ids:
        return rows.join(F.broadcast(ids.select(key)), key, "left_semi")
    if size <= bloom_ids:
        possible = may_contain(key, F.col("words"), words_for(size))
        return rows.join(F.broadcast(bloom_filter(ids, key, size)), possible, "left_semi")
    return rows
