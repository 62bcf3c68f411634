"""First-row-per-key and position-in-group, written so that one hot key cannot fill a task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row of every key in the given order.

    ``order`` should be total (name NULLS FIRST/LAST yourself), or the kept row is arbitrary.
    Spark turns ``row_number() = 1`` into a WindowGroupLimit that already runs before the
    shuffle, so every map task sends at most one row per key, however hot the key is.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(window))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def number_in_levels(
    rows: DataFrame,
    keys: Sequence[str],
    levels: Sequence[Sequence[str]],
    within: Sequence[Column],
    name: str,
) -> DataFrame:
    """1-based position of each row in its ``keys`` group, without sorting a group in one task.

    The group order is ``levels[0]``, then ``levels[1]``, ..., then ``within``, each level
    ascending with NULLs last. Rows are counted per cell (map-side combined), running sums of the
    counts give each cell its offset, and only the rows of one cell are ever sorted together.
    """
    cell = [*keys, *(c for level in levels for c in level)]
    counts = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    offsets = _offsets(counts, list(keys), [list(level) for level in levels])
    window = Window.partitionBy(*cell).orderBy(*(within or [F.lit(1)]))
    numbered = rows.withColumn("_place", F.row_number().over(window))
    joined = _join_null_safe(numbered, offsets, cell)
    return joined.withColumn(name, F.col("_offset") + F.col("_place")).drop("_offset", "_place")


def _offsets(counts: DataFrame, keys: list[str], levels: list[list[str]]) -> DataFrame:
    """Rows that come before each cell of ``levels`` within its ``keys`` group."""
    head, rest = levels[0], levels[1:]
    order = [F.col(c).asc_nulls_last() for c in head]
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0))
    if not rest:
        return counts.select(*keys, *head, offset.alias("_offset"))
    outer_counts = counts.groupBy(*keys, *head).agg(F.sum("_n").alias("_n"))
    outer = outer_counts.select(*keys, *head, offset.alias("_outer"))
    inner = _offsets(counts, keys + head, rest)
    joined = _join_null_safe(inner, outer, keys + head)
    return joined.withColumn("_offset", F.col("_offset") + F.col("_outer")).drop("_outer")


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which NULL equals NULL; the right side's keys are dropped."""
    renamed = right.select(*(F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns))
    condition = reduce(
        lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys)
    )
    return left.join(renamed, condition).drop(*(f"_r_{c}" for c in keys))
