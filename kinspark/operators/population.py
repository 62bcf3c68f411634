"""Base population (by place and year) and study population (the lineage with attributes)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.functions.membership import keep_candidates
from kinspark.operators.people import ADULT_ROLES, person_attributes

NO_SLAVES = "0"


def resident_ids(
    master: DataFrame,
    counties: DataFrame,
    years: Sequence[int] = (1870,),
    zones: Sequence[str] = ("KB",),
    roles: Sequence[str] | None = None,
) -> DataFrame:
    """Persons recorded in the given zones and years (and roles), each once.

    The county list is matched as a semi join, so a county listed twice adds nothing; Spark
    broadcasts it by itself while its known size is under the broadcast threshold.
    """
    chosen = master.filter(F.col("cenyear").isin(*years))
    if roles is not None:
        chosen = chosen.filter(F.col("rolecode").isin(*roles))
    here = counties.filter(F.col("zone").isin(*zones)).select("countycode")
    return chosen.join(here, "countycode", "left_semi").select("hik").distinct()


def with_slaveholding(people: DataFrame, slaveholders: DataFrame) -> DataFrame:
    """Attach the slaveholder category, '0' where a person is not listed or listed without one.

    Of several rows of a person the lowest category counts; the default comes after that.
    """
    listed = slaveholders.groupBy("hik").agg(F.min("slvhcat").alias("slvhcat"))
    category = F.coalesce("slvhcat", F.lit(NO_SLAVES))
    return people.join(listed, "hik", "left").withColumn("slvhcat", category)


def base_population(
    master: DataFrame,
    counties: DataFrame,
    slaveholders: DataFrame,
    years: Sequence[int] = (1870,),
    zones: Sequence[str] = ("KB",),
    roles: Sequence[str] | None = None,
    people: DataFrame | None = None,
    ids: DataFrame | None = None,
) -> DataFrame:
    """Everyone recorded in the zones and years, with the attributes of their earliest record.

    ``people`` is the ``person_attributes`` table of these persons at least, and ``ids`` the ``resident_ids``, where
    they already exist. Without ``people``, only the records of the residents are looked through for it.
    """
    if ids is None:
        ids = resident_ids(master, counties, years, zones, roles)
    if people is None:
        people = person_attributes(master.join(ids, "hik", "left_semi"))
    else:
        people = people.join(ids, "hik", "left_semi")
    return with_slaveholding(people, slaveholders)


def base_population_adults(
    master: DataFrame,
    counties: DataFrame,
    slaveholders: DataFrame,
    people: DataFrame | None = None,
    ids: DataFrame | None = None,
) -> DataFrame:
    """The alternative base: adults of 1870 and 1880."""
    return base_population(
        master, counties, slaveholders, years=(1870, 1880), roles=ADULT_ROLES, people=people, ids=ids
    )


def study_ids(lineage_graph: DataFrame) -> DataFrame:
    """Both ends of every edge, each person once, in one pass over the edges."""
    ends = F.explode(F.array("src", "tgt")).alias("hik")
    return lineage_graph.select(ends).distinct()


def attributes_of(master: DataFrame, ids: DataFrame, size: int, **limits: int) -> DataFrame:
    """``person_attributes`` of the ``size`` persons ``ids`` (a ``hik`` column, each once), and maybe of some others.

    The records of other persons are left out before the window that finds each person's earliest record.
    """
    return person_attributes(keep_candidates(master, ids, "hik", size, **limits))


def study_population(
    people: DataFrame, ids: DataFrame, slaveholders: DataFrame, adults: DataFrame
) -> DataFrame:
    """The persons of the lineage graph with attributes, slaveholding and an adult flag.

    ``people`` is one row per person, so every join here is between unique keys.
    """
    known_adults = adults.filter(F.col("sex").isNotNull()).select("hik").distinct()
    known_adults = known_adults.withColumn("adult", F.lit("1"))
    chosen = with_slaveholding(people.join(ids, "hik", "left_semi"), slaveholders)
    return chosen.join(known_adults, "hik", "left").withColumn("adult", F.coalesce("adult", F.lit("0")))
