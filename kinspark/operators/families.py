"""Family units: counting, validity, member order, family flags and the census extract.

Hot groups. Three groups can be far larger than a task: people without a family code (all NULL),
one junk family code, and one county-year. The first never needs a shuffle (only its adult count
matters), the second is taken out by ``special_families`` and numbered in levels, and the third
is numbered in levels over its distinct families.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Row, Window
from pyspark.sql import functions as F

from kinspark.functions.codes import blank_to_null, flag
from kinspark.functions.ordering import number_in_levels
from kinspark.sources.schemas import EXTRACT_COLUMNS
from kinspark.sources.stage import Stage

# A family above LARGE_FAMILY members that also holds more than 1/LISTED_FAMILIES of all coded rows leaves the
# one-task-per-family path. There are fewer than LISTED_FAMILIES of these, whatever the input's size, and a smaller
# one is for one task to hold wherever the whole can be processed.
LARGE_FAMILY = 100_000
LISTED_FAMILIES = 5_000
SKETCH_WIDTH = 4  # counters of a sketch row, as a multiple of LISTED_FAMILIES

MEMBER_ORDER = ["rolecode", "birthyr", "personcode"]

MEMBERS_PER_PARTITION = 250_000  # rows of some 400 bytes that one task sorts


@dataclass(frozen=True)
class Sizes:
    """What is known of the families before they are gathered: the special ones, and how many records are coded."""

    special: list[Row]
    coded: int

    @property
    def ordinary(self) -> bool:
        """Whether all members go the one way, of a task per family."""
        return not any(row.famcode is not None or row.adults == 2 for row in self.special)


def partitions_for(coded: int) -> int:
    return max(1, -(-coded // MEMBERS_PER_PARTITION))


def family_sizes(persons: DataFrame, large: int = LARGE_FAMILY, listed: int = LISTED_FAMILIES) -> Sizes:
    """The special families and the number of coded records, in one pass."""
    coded = Observation()
    observed = persons.select("famcode", "unmc").observe(coded, F.count("famcode").alias("n"))
    special = special_families(persons, large, listed, observed)
    return Sizes(special, coded.get["n"])


def family_counts(persons: DataFrame) -> DataFrame:
    """Adults and unmarried children per family code, for families with an adult.

    ``children`` is NULL when there is none, and for the NULL family code, whose adults and
    children never match each other.
    """
    counts = persons.groupBy("famcode").agg(
        F.count_if(~F.col("unmc")).alias("adults"), F.count_if("unmc").alias("children")
    )
    known = F.col("famcode").isNotNull() & (F.col("children") > 0)
    return counts.filter(F.col("adults") > 0).withColumn("children", F.when(known, F.col("children")))


def is_valid(adults: Column, children: Column) -> Column:
    """One adult with children, or two adults."""
    return ((adults == 1) & (children > 0)) | (adults == 2)


def valid_families(counts: DataFrame) -> DataFrame:
    return counts.filter(is_valid(F.col("adults"), F.col("children")))


def special_families(
    persons: DataFrame, large: int = LARGE_FAMILY, listed: int = LISTED_FAMILIES, first: DataFrame | None = None
) -> list[Row]:
    """Counts of the NULL family and of the largest families: a short list, by construction.

    ``first`` takes the place of the persons in the first pass, to observe it.

    A count-min sketch goes first: records are counted under a hash of their family code. Fewer than ``listed``
    counters can be large, and a large family's is. Where there are such counters, their records are counted under a
    second hash, and only families that are large by both are counted exactly.
    """
    counts = (F.count_if(~F.col("unmc")).alias("adults"), F.count_if("unmc").alias("children"))
    size = F.col("adults") + F.col("children")
    candidates, special, least = persons.select("famcode", "unmc"), [], None
    for row in range(2):
        counter = F.pmod(F.xxhash64("famcode", F.lit(row)), F.lit(SKETCH_WIDTH * listed))
        counter = F.when(F.col("famcode").isNotNull(), counter)
        counted = first if first is not None and least is None else candidates
        sketch = counted.groupBy(counter.alias("counter")).agg(*counts)
        if least is None:
            known = Window.partitionBy(F.col("counter").isNull())  # at most as many rows as there are counters
            sketch = sketch.withColumn("least", F.greatest(F.lit(large), F.sum(size).over(known) / F.lit(listed)))
        else:
            sketch = sketch.withColumn("least", F.lit(least))
        found = sketch.filter(F.col("counter").isNull() | (size > F.col("least"))).collect()
        special += [Row(famcode=None, adults=r.adults, children=r.children) for r in found if r.counter is None]
        heavy = [(r.counter,) for r in found if r.counter is not None]
        if not heavy:
            return special
        least = next(r.least for r in found if r.counter is not None)
        names = persons.sparkSession.createDataFrame(heavy, "held long")
        candidates = candidates.join(F.broadcast(names), counter == F.col("held"), "left_semi")
    families = candidates.groupBy("famcode").agg(*counts).filter(size > F.lit(least))
    return special + families.collect()


def with_family(
    persons: DataFrame,
    stage: Stage,
    large: int = LARGE_FAMILY,
    listed: int = LISTED_FAMILIES,
    sizes: Sizes | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Members of valid families, with ``famadults``, ``famchildren`` and ``famseq``.

    The last two are long: a 16-bit number would end the job at a family of 32,768.

    ``sizes`` are the ``family_sizes`` where they are known. Members of ordinary families only come out hashed by
    family code, into as many partitions as ``partitions`` says, if it is given.
    """
    sizes = family_sizes(persons, large, listed) if sizes is None else sizes
    special = sizes.special
    large_ones = [row for row in special if row.famcode is not None]
    coded = persons.filter(F.col("famcode").isNotNull())
    if not large_ones:
        members = _ordinary_members(coded.repartition(partitions, "famcode") if partitions else coded)
    else:
        names = persons.sparkSession.createDataFrame(
            [(row.famcode, row.adults, row.children) for row in large_ones],
            "famcode string, famadults long, famchildren long",
        )
        ordinary = coded.join(F.broadcast(names), "famcode", "left_anti")
        members = _ordinary_members(ordinary).unionByName(_large_members(coded, names, stage))
    members = members.select(
        *persons.columns,
        F.col("famadults").cast("smallint").alias("famadults"),
        F.nullif(F.col("famchildren"), F.lit(0)).cast("long").alias("famchildren"),
        F.col("famseq").cast("long").alias("famseq"),
    )
    if any(row.famcode is None and row.adults == 2 for row in special):
        members = members.unionByName(_unmatched_family(members))
    return members


def _ordinary_members(coded: DataFrame) -> DataFrame:
    """One shuffle and one sort: both counts and the sequence share the same window."""
    order = [F.col(c).asc_nulls_last() for c in MEMBER_ORDER]
    family = Window.partitionBy("famcode").orderBy(*order)
    whole = family.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = coded.select(
        "*",
        F.count_if(~F.col("unmc")).over(whole).alias("famadults"),
        F.count_if("unmc").over(whole).alias("famchildren"),
        F.row_number().over(family).alias("famseq"),
    )
    return counted.filter(is_valid(F.col("famadults"), F.col("famchildren")))


def _large_members(coded: DataFrame, names: DataFrame, stage: Stage) -> DataFrame:
    """Members of the listed families, numbered without gathering a family in one task.

    Records that agree in the whole order key are told apart by the task that read them; writing
    the rows first makes that choice final.
    """
    valid = names.filter(is_valid(F.col("famadults"), F.col("famchildren")))
    rows = coded.join(F.broadcast(valid), "famcode").withColumn("_slot", F.spark_partition_id())
    rows = stage.save("large_family_members", rows)
    levels = [MEMBER_ORDER[:2], MEMBER_ORDER[2:], ["_slot"]]
    return number_in_levels(rows, ["famcode"], levels, [], "famseq").drop("_slot")


def _unmatched_family(members: DataFrame) -> DataFrame:
    """The row a left join leaves when exactly two adults have no family code: counts, no person."""
    known = {"famadults": 2, "famseq": 1}
    values = [F.lit(known.get(f.name)).cast(f.dataType).alias(f.name) for f in members.schema]
    return members.sparkSession.range(1).select(*values)


def family_members(members: DataFrame) -> DataFrame:
    """Add the flags that depend on the family's composition."""
    adult = ~F.col("unmc")
    two, one = F.col("famadults") == 2, F.col("famadults") == 1
    heads = (two & (F.col("rolecode") == "1")) | (one & F.col("rolecode").isin("1", "2"))
    return members.select(
        "*",
        flag(heads & adult).alias("famhead"),
        flag(F.col("famchildren").isNotNull() & adult).alias("parent"),
        flag(two & adult).alias("couple"),
        flag((F.col("steppop") != "0") & (F.col("stepmom") != "0")).alias("stepfam"),
        F.lit(True).alias("cfu"),
    )


def family_numbers(members: DataFrame) -> DataFrame:
    """Rank of each family code within its county and census year (ties share, no gaps).

    Ranking the distinct families is the dense rank of their members. A county-year is split by
    the leading characters of the family code, which sort like the code itself.
    """
    families = members.select("cenyear", "countycode", "famcode").distinct()
    families = families.withColumn("_lead", F.substring("famcode", 1, 8))
    order = [F.col("famcode").asc_nulls_last()]
    numbered = number_in_levels(families, ["cenyear", "countycode"], [["_lead"]], order, "famno")
    return numbered.select("cenyear", "countycode", "famcode", F.col("famno").cast("long"))


def with_family_number(members: DataFrame) -> DataFrame:
    """Attach ``famno`` to each member."""
    numbers = family_numbers(members).select(
        F.col("cenyear").alias("_y"), F.col("countycode").alias("_c"), F.col("famcode").alias("_f"), "famno"
    )
    same = (
        F.col("cenyear").eqNullSafe(F.col("_y"))
        & F.col("countycode").eqNullSafe(F.col("_c"))
        & F.col("famcode").eqNullSafe(F.col("_f"))
    )
    return members.join(numbers, same, "left").drop("_y", "_c", "_f")


def latest_batch(batches: DataFrame) -> DataFrame:
    """The highest batch as one row; a NULL batch sorts above every number."""
    return batches.select("batch").orderBy(F.col("batch").desc_nulls_first()).limit(1)


def with_batch(members: DataFrame, batches: DataFrame) -> DataFrame:
    return members.withColumn("batch", latest_batch(batches).scalar().cast("int"))


def census_extract(
    persons: DataFrame,
    batches: DataFrame,
    stage: Stage,
    large: int = LARGE_FAMILY,
    sizes: Sizes | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """The 33-column table of family members; ``sizes`` and ``partitions`` as for ``with_family``."""
    members = family_members(with_family(_narrow(persons), stage, large, sizes=sizes, partitions=partitions))
    members = with_batch(members, batches)
    finished = members.withColumns(
        {"hik": blank_to_null(F.col("hik"), 4), "enumdist": blank_to_null(F.col("enumdist"), 2)}
    )
    return finished.select(*EXTRACT_COLUMNS)


def _narrow(persons: DataFrame) -> DataFrame:
    """Drop what the extract does not show before the shuffle by family."""
    needed = {*EXTRACT_COLUMNS, "unmc", "steppop", "stepmom"}
    return persons.select(*(c for c in persons.columns if c in needed))


def census_extract_wide(
    persons: DataFrame, batches: DataFrame, stage: Stage, large: int = LARGE_FAMILY
) -> DataFrame:
    """As ``census_extract``, with the working columns that the narrow form projects away."""
    members = stage.save("wide_members", family_members(with_family(persons, stage, large)))
    members = with_batch(with_family_number(members), batches)
    finished = members.withColumns(
        {"hik": blank_to_null(F.col("hik"), 4), "enumdist": blank_to_null(F.col("enumdist"), 2)}
    )
    extra = ["famno", "unmc", "famadults", "famchildren", "household", "histid", "gq", "cfu"]
    return finished.select(*EXTRACT_COLUMNS, *extra)
