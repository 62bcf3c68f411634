"""Row-wise derivation of the census person record: one projection, no shuffle, all code-generated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.functions.codes import blank_to_null, count_or_zero, fixed, flag, has_blanks

NONE = "00"  # "no such person" in the spouse, mother and father pointers
MAN, WOMAN = "1", "2"
PASSED_THROUGH = [
    "sex", "race", "bpl", "labforce", "sploc", "poploc", "momloc", "steppop", "stepmom", "histid",
    "gq", "hhtype", "relate", "famunit", "farm", "stateicp", "countyicp", "enumdist",
]


def _has_parent() -> Column:
    return (F.col("momloc") != NONE) | (F.col("poploc") != NONE)


def _single() -> Column:
    return F.col("sploc") == NONE


def _unmarried_child() -> Column:
    return _single() & _has_parent()


def _principal(sex: str) -> Column:
    """Married, or single without a parent at home: the people a family unit is built around."""
    parentless = (F.col("momloc") == NONE) & (F.col("poploc") == NONE)
    return ((F.col("sploc") != NONE) | (_single() & parentless)) & (F.col("sex") == sex)


def family_code() -> Column:
    """Household plus the man's and the woman's slot; a couple and its unmarried children share it."""
    own, spouse = F.substring("pernum", -2, 2), F.col("sploc")
    slots = (
        F.when(_principal(MAN), F.concat(own, spouse))
        .when(_principal(WOMAN), F.concat(spouse, own))
        .when(_unmarried_child(), F.concat("poploc", "momloc"))
    )
    return fixed(F.concat("year", "serial", slots), 16)


def role_code() -> Column:
    role = F.when(_principal(MAN), "1").when(_principal(WOMAN), "2").when(_unmarried_child(), "3")
    return F.coalesce(role, F.lit("0"))


def birth_year() -> Column:
    given = F.when(F.col("birthyr") != "9999", F.col("birthyr").cast("smallint"))
    derived = F.col("year").cast("smallint") - F.col("age").cast("smallint")
    return F.coalesce(given, derived.cast("smallint"))


def slaveholder_category() -> Column:
    held = count_or_zero(F.col("slavenum"))
    category = F.when(held >= 20, "3").when(held >= 6, "2").when(held >= 1, "1")
    return category.otherwise("0")


def person_records(census: DataFrame, private_households_only: bool = False) -> DataFrame:
    """Derive codes, flags and typed values from raw census text, one row per person."""
    if private_households_only:
        private = F.col("hhtype").isin("1", "2", "3") & F.col("gq").isin("1", "2")
        census = census.filter(private)
    young = F.col("age").cast("smallint") < 18
    return census.select(
        family_code().alias("famcode"),
        role_code().alias("rolecode"),
        F.col("year").cast("smallint").alias("cenyear"),
        birth_year().alias("birthyr"),
        F.col("age").cast("smallint").alias("age"),
        *PASSED_THROUGH,
        blank_to_null(F.col("nativity"), 1).alias("nativity"),
        blank_to_null(F.col("marst"), 1).alias("marst"),
        blank_to_null(F.col("multgen"), 1).alias("multgen"),
        blank_to_null(F.col("hik"), 5).alias("hik"),
        flag(~has_blanks(F.col("hik"), 5)).alias("hiklink"),
        flag(F.col("relate") == "01").alias("hhead"),
        flag(_single()).alias("unmarried"),
        flag(_has_parent()).alias("child"),
        flag(_unmarried_child()).alias("unmc"),
        flag(young & _single() & (F.col("labforce") != "2")).alias("minor"),
        F.concat("stateicp", "countyicp").alias("countycode"),
        fixed(F.concat("year", "serial"), 12).alias("household"),
        fixed(F.concat("year", "serial", "pernum"), 16).alias("personcode"),
        count_or_zero(F.col("slavenum")).alias("slavenum"),
        count_or_zero(F.col("slaveown")).alias("slaveown"),
        slaveholder_category().alias("slvhcat"),
    )
