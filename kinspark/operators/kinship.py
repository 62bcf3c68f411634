"""The kinship graph: child -> parent and husband -> wife edges between persons.

``edg`` is '0' for marriage and the parent's sex for descent. Members are made distinct before
they are paired, so copies of a family (re-extracted in a later batch) do not multiply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.functions.ordering import distinct_on
from kinspark.operators.people import ADULT_ROLES, CHILD_ROLES, person_sexes
from kinspark.sources.schemas import EDGE_COLUMNS


def parent_child_pairs(master: DataFrame) -> DataFrame:
    """Every adult of a family with every unmarried child of it."""
    linked = master.filter(F.col("hik").isNotNull() & F.col("famcode").isNotNull())
    adults = linked.filter(F.col("rolecode").isin(ADULT_ROLES))
    adults = adults.select("famcode", F.col("hik").alias("phik"), F.col("sex").alias("bsx")).distinct()
    children = linked.filter(F.col("rolecode").isin(CHILD_ROLES))
    children = children.select("famcode", F.col("hik").alias("chik"), F.col("sex").alias("csx")).distinct()
    return adults.join(children, "famcode")


def descent_links(master: DataFrame) -> DataFrame:
    """One child -> parent edge per pair of persons. A person linked to itself is kept."""
    return _first_edges(parent_child_pairs(master))


def _zero_coded_descent(master: DataFrame) -> DataFrame:
    """``marriage_edges(descent_links(master))`` from few pairs: no sex above '0' comes before '0'."""
    return marriage_edges(_first_edges(parent_child_pairs(master).filter("bsx <= '0'")))


def _first_edges(pairs: DataFrame) -> DataFrame:
    order = [F.col("bsx").asc_nulls_last(), F.col("csx").asc_nulls_last()]
    pairs = pairs.select("phik", "chik", "bsx", "csx")
    first = distinct_on(pairs, ["phik", "chik"], order)
    return first.select(
        F.col("chik").alias("src"),
        F.col("phik").alias("tgt"),
        F.col("bsx").alias("edg"),
        F.col("csx").alias("sxs"),
        F.col("bsx").alias("sxt"),
        F.lit(1.0).alias("weight"),
    )


def marriage_links(master: DataFrame, sexes: DataFrame | None = None) -> DataFrame:
    """One husband -> wife edge per couple, with each person's own sex across all records.

    ``sexes`` is the ``person_sexes`` table of ``master`` where it already exists. It is one row per person, and
    compresses so well that Spark would broadcast millions of them; sorted, they may spill.
    """
    linked = master.filter(F.col("hik").isNotNull() & F.col("famcode").isNotNull())
    husbands = linked.filter(F.col("rolecode") == "1").select("famcode", F.col("hik").alias("src"))
    wives = linked.filter(F.col("rolecode") == "2").select("famcode", F.col("hik").alias("tgt"))
    couples = husbands.distinct().join(wives.distinct(), "famcode").filter("src <> tgt")
    couples = couples.select("src", "tgt").distinct()
    sexes = (person_sexes(master) if sexes is None else sexes).hint("merge")
    return (
        couples.join(sexes.select(F.col("hik").alias("src"), F.col("sex").alias("sxs")), "src")
        .join(sexes.select(F.col("hik").alias("tgt"), F.col("sex").alias("sxt")), "tgt")
        .withColumns({"edg": F.lit("0"), "weight": F.lit(1.0)})
        .select(*EDGE_COLUMNS)
    )


def kinship_links(master: DataFrame, sexes: DataFrame | None = None) -> DataFrame:
    """Descent and marriage together. They can only coincide if a parent's sex is coded '0'.

    So the other descent edges, one a pair by themselves, are not compared with anything.
    """
    zero_coded = marriage_links(master, sexes).unionByName(_zero_coded_descent(master)).distinct()
    return other_descent(descent_links(master)).unionByName(zero_coded)


def marriages_with_zero_coded(descent: DataFrame, marriages: DataFrame) -> DataFrame:
    """All edges coded '0': the marriages, and descent edges of a parent whose sex is coded '0'.

    With ``descent`` already written, this and ``other_descent`` are ``kinship_links`` in two
    disjoint parts, without shuffling the descent edges once more.
    """
    return marriages.unionByName(marriage_edges(descent)).distinct()


def other_descent(descent: DataFrame) -> DataFrame:
    return descent.filter(~F.coalesce(F.col("edg") == "0", F.lit(False)))


def descent_edges(links: DataFrame) -> DataFrame:
    return links.filter(F.col("edg").isin("1", "2"))


def marriage_edges(links: DataFrame) -> DataFrame:
    return links.filter(F.col("edg") == "0")
