"""Column expressions for coded, blank-padded text fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_blanks(col: Column, n: int) -> Column:
    """True where the text holds a run of at least ``n`` blanks; NULL stays NULL."""
    return F.contains(col, F.lit(" " * n))


def blank_to_null(col: Column, n: int) -> Column:
    """The text itself, or NULL where a run of ``n`` blanks marks it as missing."""
    return F.when(~has_blanks(col, n), col)


def flag(condition: Column) -> Column:
    """A two-valued flag: an unknown condition counts as false."""
    return F.coalesce(condition, F.lit(False))


def fixed(col: Column, width: int) -> Column:
    """Cut to the width of a fixed-width code (Spark's CHAR cast does not cut)."""
    return F.substring(col, 1, width)


def count_or_zero(col: Column) -> Column:
    """A small count; missing or unreadable text is 0."""
    number = F.when(~has_blanks(col, 1), col.try_cast("smallint"))
    return F.coalesce(number, F.lit(0).cast("smallint"))
