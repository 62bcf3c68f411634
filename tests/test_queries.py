"""Every named query against the check database, and properties of the whole chain."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from kinspark.operators.kinship import kinship_links
from kinspark.plans import check_sql
from kinspark.plans import queries as named
from kinspark.plans.study import study_of

EXPECTED_ROWS = {  # at the smallest scale
    "census_person": 7131, "census_extract": 6680, "master_census": 6639, "unique_persons": 4592,
    "adult_hiks": 2713, "child_hiks": 1879, "descent_links": 7483, "marriage_links": 1295,
    "kinship_links": 8778, "base_population": 28, "lineage_members": 862, "lineage_links": 1381,
    "lineage_marriages": 248, "linked_families": 1629, "study_population": 890,
}

QUERIES, SQL = named.queries(), check_sql.check_sql()


@pytest.fixture(scope="module")
def check_db(sf_dir):
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def rows_by_column(table):
    names = sorted(table.column_names)
    types = [str(table.schema.field(n).type) for n in names]
    return names, types, Counter(zip(*(table.column(n).to_pylist() for n in names)))


def test_every_query_has_a_check():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_check(spark, sf_dir, check_db, name):
    got = rows_by_column(QUERIES[name](spark, sf_dir).toArrow())
    expected = rows_by_column(check_db.execute(SQL[name]).to_arrow_table())
    assert got == expected
    if name in EXPECTED_ROWS:
        assert got[2].total() == EXPECTED_ROWS[name]


def test_entry(spark):
    assert driver.entry(spark).count() == EXPECTED_ROWS["census_extract"]


def test_chain_properties(spark, sf_dir):
    study = study_of(spark, sf_dir)
    families = study.extract.groupBy("famcode").agg(
        F.count_if(F.col("rolecode") != "3").alias("adults"),
        F.count_if(F.col("rolecode") == "3").alias("children"),
        F.count(F.lit(1)).alias("n"),
        F.min("famseq").alias("lo"),
        F.max("famseq").alias("hi"),
        F.count_distinct("famseq").alias("places"),
    )
    wrong = ~((F.col("adults") == 2) | ((F.col("adults") == 1) & (F.col("children") > 0)))
    wrong |= (F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("places") != F.col("n"))
    assert families.filter(wrong).isEmpty()
    assert study.master.groupBy("personcode").count().filter("count > 1").isEmpty()
    assert study.links.exceptAll(kinship_links(study.master)).isEmpty()
    kind = F.col("edg") == "0"
    assert study.links.groupBy("src", "tgt", kind).count().filter("count > 1").isEmpty()
    assert study.graph.join(study.links, ["src", "tgt", "edg", "sxs", "sxt", "weight"], "left_anti").isEmpty()


def test_more_rounds_reach_more(spark, sf_dir):
    study = study_of(spark, sf_dir)
    sizes = [study.build_lineage(rounds=r).members.count() for r in (1, 2, 3)]
    assert sizes == [229, 594, 862]


def test_row_order_of_the_input_does_not_matter(spark, sf_dir, stage):
    from kinspark.operators import families, people
    from kinspark.operators.person_records import person_records

    study = study_of(spark, sf_dir)
    shuffled = study.census.repartition(5).sortWithinPartitions(F.hash("histid"))
    again = families.census_extract(person_records(shuffled), study.batches, stage)
    assert sorted(map(str, again.collect())) == sorted(map(str, study.extract.collect()))
    first = people.unique_persons(study.master)
    assert sorted(first.collect()) == sorted(people.person_sexes(study.master).collect())
