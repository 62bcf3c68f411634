"""The stacked person records and one-row-per-person tables derived from them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.functions.ordering import distinct_on

ADULT_ROLES = ["1", "2"]
CHILD_ROLES = ["3"]


def master_census(extracts: Sequence[DataFrame]) -> DataFrame:
    """Regional extracts stacked into one set of linked person records.

    One ``distinct`` over the stack: chaining pairwise unions would shuffle the records once per
    extract. The key test is pushed into every branch's scan.
    """
    stacked = reduce(DataFrame.unionByName, extracts)
    return stacked.filter(F.col("hik").isNotNull()).distinct()


def unique_persons(master: DataFrame) -> DataFrame:
    """Each person once, with the sex of the record that sorts first by sex, year and record."""
    order = [F.col(c).asc_nulls_last() for c in ("sex", "cenyear", "personcode")]
    return distinct_on(master.select("hik", "sex", "cenyear", "personcode"), ["hik"], order).select(
        "hik", "sex"
    )


def person_sexes(master: DataFrame) -> DataFrame:
    """The same (hik, sex) pairs as ``unique_persons``: sex leads its order, so it is the least sex."""
    return master.groupBy("hik").agg(F.min("sex").alias("sex"))


def adult_hiks(master: DataFrame) -> DataFrame:
    """Everyone ever recorded as an adult, with their least recorded adult sex."""
    return person_sexes(master.filter(F.col("rolecode").isin(ADULT_ROLES)))


def child_hiks(master: DataFrame) -> DataFrame:
    """People only ever recorded as children, as of their latest census."""
    order = [
        F.col("rolecode").asc_nulls_last(),
        F.col("cenyear").desc_nulls_first(),
        F.col("sex").asc_nulls_last(),
    ]
    first = distinct_on(master.select("hik", "rolecode", "cenyear", "sex"), ["hik"], order)
    return first.filter(F.col("rolecode").isin(CHILD_ROLES))


def person_attributes(master: DataFrame) -> DataFrame:
    """One row of attributes per person: the record with the earliest birth year.

    Both populations read this table. Keeping one row per person before any join means that the
    joins by person meet unique keys on every side.
    """
    columns = ["hik", "sex", "race", "birthyr", "bpl", "farm"]
    order = [F.col(c).asc_nulls_last() for c in ("birthyr", "farm", "sex", "race", "bpl")]
    return distinct_on(master.select(*columns), ["hik"], order)
