"""Stacking, first-row-per-person tables, kinship edges and populations."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinspark.functions.ordering import distinct_on, number_in_levels
from kinspark.operators import kinship, people, population

from tests.conftest import plan_of


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def couple_with_child(fam="F1", **child):
    return [
        {"famcode": fam, "hik": f"{fam}h", "rolecode": "1", "sex": "1", "personcode": f"{fam}1"},
        {"famcode": fam, "hik": f"{fam}w", "rolecode": "2", "sex": "2", "personcode": f"{fam}2"},
        {"famcode": fam, "hik": f"{fam}c", "rolecode": "3", "sex": "2", "personcode": f"{fam}3", **child},
    ]


def test_stack_drops_copies_and_unlinked_records(records):
    first = records({"personcode": "p1"}, {"personcode": "p2"}).withColumn("batch", F.lit(13))
    second = records({"personcode": "p2"}, {"personcode": "p3", "hik": None}).withColumn("batch", F.lit(13))
    other_batch = records({"personcode": "p2"}).withColumn("batch", F.lit(14))
    stacked = people.master_census([first, second, other_batch.select(*reversed(other_batch.columns))])
    assert sorted((r.personcode, r.batch) for r in stacked.collect()) == [("p1", 13), ("p2", 13), ("p2", 14)]


def test_one_sex_per_person(records):
    rows = records({"sex": "2", "cenyear": 1850}, {"sex": "1", "cenyear": 1880}, {"hik": "b", "sex": None})
    assert as_set(people.unique_persons(rows), "hik", "sex") == {("a", "1"), ("b", None)}
    assert as_set(people.person_sexes(rows), "hik", "sex") == {("a", "1"), ("b", None)}


def test_adults_and_never_adults(records):
    rows = records(
        {"hik": "a", "rolecode": "3", "cenyear": 1850},
        {"hik": "a", "rolecode": "1", "cenyear": 1870},
        {"hik": "b", "rolecode": "3", "cenyear": 1850, "sex": "2"},
        {"hik": "b", "rolecode": "3", "cenyear": 1860, "sex": "1"},
        {"hik": "c", "rolecode": "2", "sex": None},
        {"hik": "d", "rolecode": "3", "cenyear": 1860},
        {"hik": "d", "rolecode": "3", "cenyear": None},
    )
    assert as_set(people.adult_hiks(rows), "hik", "sex") == {("a", "1"), ("c", None)}
    got = as_set(people.child_hiks(rows), "hik", "cenyear", "sex")
    assert got == {("b", 1860, "1"), ("d", None, "1")}


def test_attributes_come_from_the_earliest_known_birth_year(records):
    rows = records({"birthyr": None}, {"birthyr": 1850}, {"birthyr": 1840, "bpl": "2"}, {"birthyr": 1840, "bpl": "1"})
    assert as_set(people.person_attributes(rows), "hik", "birthyr", "bpl") == {("a", 1840, "1")}


def test_distinct_on_limits_rows_before_the_shuffle(spark):
    rows = spark.range(1000).selectExpr("id % 3 as k", "id as v")
    first = distinct_on(rows, ["k"], [F.col("v").desc()])
    assert as_set(first, "k", "v") == {(0, 999), (1, 997), (2, 998)}
    plan = plan_of(first)
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")
    assert "Partial" in plan[plan.rindex("WindowGroupLimit"):]


def test_number_in_levels_is_a_row_number(spark):
    rows = spark.range(2000).selectExpr(
        "id % 2 as g", "nullif(id % 7, 3) as a", "id % 11 as b", "id % 5 as c", "id"
    )
    numbered = number_in_levels(rows, ["g"], [["a"], ["b", "c"]], [F.col("id")], "n")
    for group in (0, 1):
        got = [r.id for r in numbered.filter(F.col("g") == group).orderBy("n").collect()]
        ordered = rows.filter(F.col("g") == group).orderBy(F.col("a").asc_nulls_last(), "b", "c", "id")
        assert got == [r.id for r in ordered.collect()]
        assert sorted(r.n for r in numbered.filter(F.col("g") == group).collect()) == list(range(1, 1001))


def test_descent_and_marriage_edges(records):
    rows = records(*couple_with_child())
    assert as_set(kinship.descent_links(rows), "src", "tgt", "edg", "sxs", "sxt", "weight") == {
        ("F1c", "F1h", "1", "2", "1", 1.0),
        ("F1c", "F1w", "2", "2", "2", 1.0),
    }
    assert as_set(kinship.marriage_links(rows), "src", "tgt", "edg", "sxs", "sxt", "weight") == {
        ("F1h", "F1w", "0", "1", "2", 1.0)
    }
    assert kinship.kinship_links(rows).count() == 3


def test_self_links(records):
    child_is_father = couple_with_child("F1", hik="F1h")
    one_key_couple = couple_with_child("F2")
    one_key_couple[1]["hik"] = "F2h"
    links = kinship.kinship_links(records(*child_is_father, *one_key_couple))
    same = links.filter("src = tgt")
    assert as_set(same, "src", "edg") == {("F1h", "1")}
    assert links.filter("edg = '0'").count() == 1  # the first couple only


def test_edge_sexes(records):
    earlier = {"hik": "F1h", "sex": "0", "cenyear": 1850, "famcode": "F0", "rolecode": "3"}
    links = kinship.kinship_links(records(*couple_with_child(), earlier))
    assert as_set(links.filter("edg = '0'"), "sxs", "sxt") == {("0", "2")}
    assert as_set(links.filter("edg = '1'"), "sxs", "sxt") == {("2", "1")}


def test_pair_seen_twice_keeps_the_least_sexes(records):
    again = couple_with_child(sex="1")
    links = kinship.descent_links(records(*couple_with_child(), *again))
    assert as_set(links, "tgt", "edg", "sxs") == {("F1h", "1", "1"), ("F1w", "2", "1")}


def test_copies_do_not_multiply_pairs(records):
    copies = [dict(r, personcode=f"{r['personcode']}-{i}") for i in range(6) for r in couple_with_child()]
    assert kinship.parent_child_pairs(records(*copies)).count() == 2


def test_records_without_family_code_do_not_pair(records):
    rows = couple_with_child()
    assert kinship.kinship_links(records(*(dict(r, famcode=None) for r in rows))).count() == 0


def test_parent_coded_zero_meets_marriage(records):
    """A descent edge of a parent with sex '0' equals a marriage edge: the union keeps one."""
    rows = [
        {"famcode": "F1", "hik": "x", "rolecode": "1", "sex": "1"},
        {"famcode": "F1", "hik": "y", "rolecode": "2", "sex": "0"},
        {"famcode": "F2", "hik": "y", "rolecode": "2", "sex": "0"},
        {"famcode": "F2", "hik": "x", "rolecode": "3", "sex": "1"},
    ]
    links = kinship.kinship_links(records(*rows))
    assert as_set(links, "src", "tgt", "edg") == {("x", "y", "0")}
    assert links.count() == 1
    descent, marriages = kinship.descent_links(records(*rows)), kinship.marriage_links(records(*rows))
    coded_zero = kinship.marriages_with_zero_coded(descent, marriages)
    parts = kinship.other_descent(descent).unionByName(coded_zero)
    assert sorted(parts.collect()) == sorted(links.collect())


def county_map(spark, *rows):
    return spark.createDataFrame(rows, "countycode string, zone string")


def slave_map(spark, *rows):
    return spark.createDataFrame(list(rows), "hik string, slvhcat string")


def test_base_population(spark, records):
    rows = records(
        {"hik": "a", "birthyr": 1840},
        {"hik": "a", "birthyr": 1835, "cenyear": 1880, "countycode": "999999", "sex": "2"},
        {"hik": "b", "rolecode": "3"},
        {"hik": "c", "cenyear": 1880},
        {"hik": "d", "countycode": "999999"},
    )
    counties = county_map(spark, ("510010", "KB"), ("510010", "KB"), ("999999", "OH"))
    held = slave_map(spark, ("a", "2"))
    base = population.base_population(rows, counties, held)
    assert as_set(base, "hik", "sex", "birthyr", "slvhcat") == {("a", "2", 1835, "2"), ("b", "1", 1840, "0")}
    assert base.count() == 2
    assert base.columns == ["hik", "sex", "race", "birthyr", "bpl", "farm", "slvhcat"]
    adults = population.base_population_adults(rows, counties, held)
    assert as_set(adults, "hik") == {("a",), ("c",)}
    ready = population.base_population(rows, counties, held, people=people.person_attributes(rows))
    assert sorted(ready.collect()) == sorted(base.collect())


def test_base_population_reads_its_years_only(spark, stage, records):
    table = stage.save("master", records({"cenyear": 1870}, {"cenyear": 1880}), partition_by=["cenyear"])
    assert table.schema == records({}).schema
    plan = plan_of(population.resident_ids(table, county_map(spark, ("510010", "KB"))))
    assert "PartitionFilters: [isnotnull(cenyear" in plan and "= 1870)" in plan


def test_study_population(spark, records):
    rows = records({"hik": "a"}, {"hik": "b", "birthyr": 1850}, {"hik": "b", "birthyr": 1849}, {"hik": "c"}, {"hik": "z"})
    graph = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c"), ("q", "a")], "src string, tgt string")
    adults = spark.createDataFrame([("a", "1"), ("c", None)], "hik string, sex string")
    ids = population.study_ids(graph)
    assert as_set(ids, "hik") == {("a",), ("b",), ("c",), ("q",)}
    study = population.study_population(
        people.person_attributes(rows), ids, slave_map(spark, ("b", "3")), adults
    )
    assert as_set(study, "hik", "birthyr", "slvhcat", "adult") == {
        ("a", 1840, "0", "1"),
        ("b", 1849, "3", "0"),
        ("c", 1840, "0", "0"),
    }


def test_other_descent_edges_are_compared_with_nothing(records):
    """Only edges coded '0' are made distinct; parents whose sex is blank, '0', null or repeated stay as they were."""
    rows = couple_with_child("F1") + couple_with_child("F1")
    for i, sexes in enumerate([("0", "1"), (" ", "0"), ("0", None), (None, None), ("9", "0")]):
        rows += [r | {"sex": s} if s != "1" else r for r, s in zip(couple_with_child(f"G{i}"), (*sexes, "1"))]
        rows += [{"famcode": f"H{i}", "hik": f"G{i}{p}", "rolecode": r, "sex": s} for p, r, s in zip("hc", "13", (sexes[1], "2"))]
    frame = records(*rows)
    links = kinship.kinship_links(frame)
    plain = kinship.descent_links(frame).unionByName(kinship.marriage_links(frame)).distinct()
    assert sorted(map(str, links.collect())) == sorted(map(str, plain.collect()))
    assert links._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_sexes_of_couples_are_not_broadcast(records):
    plan = kinship.marriage_links(records(*couple_with_child()))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") == 2
