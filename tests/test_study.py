"""The chain run over regional tables of its own, without the driver's inputs."""

from __future__ import annotations

import pytest

from kinspark.plans.study import Design, Region, Study

from tests.conftest import family, plan_of


def person(household, number):
    return f"P{household:018d}{number:02d}"


def three_generations(state: str) -> list[dict]:
    """A couple of 1870 in the base county, their son's family of 1880, his son's family of 1900."""
    county = {"stateicp": state, "countyicp": "0010"}
    first = family("00000001", year="1870", **county)
    second = family("00000002", year="1880", stateicp="99", countyicp="0010")
    third = family("00000003", year="1900", stateicp="99", countyicp="0010")
    rows = []
    for n, fam in enumerate((first, second, third), start=1):
        for i, row in enumerate(fam, start=1):
            row["hik"] = person(n, i)
        rows += fam
    second[0]["hik"] = person(1, 3)
    third[0]["hik"] = person(2, 3)
    return rows


@pytest.fixture
def run(spark, census, batches):
    made = []

    def build(design=Design(), **kwargs):
        rows = three_generations("51")
        regions = [
            Region(census(*rows), batches(13)),
            Region(census(*rows[:6]), batches(13)),
            Region(census(*rows[6:]), batches(13, 14)),
        ]
        counties = spark.createDataFrame([("510010", "KB")], "countycode string, zone string")
        held = spark.createDataFrame([(person(1, 1), "3")], "hik string, slvhcat string")
        made.append(Study(spark, regions, counties, held, design=design, **kwargs))
        return made[-1]

    yield build
    for study in made:
        study.stage.release()


def test_whole_chain(spark, run, tmp_path):
    study = run()
    assert study.master.count() == 9 + 3  # the third family is in two batches
    assert study.links.filter("edg = '0'").count() == 3
    assert study.links.filter("edg <> '0'").count() == 6
    assert study.base.count() == 3
    study.write_tables(str(tmp_path))
    written = spark.read.parquet(str(tmp_path / "study_population"))
    got = {r.hik: (r.slvhcat, r.adult) for r in written.collect()}
    everyone = {person(n, i) for n in (1, 2, 3) for i in (1, 2, 3)} - {person(2, 1), person(3, 1)}
    assert set(got) == everyone
    assert got[person(1, 1)] == ("3", "1") and got[person(3, 3)] == ("0", "0")
    assert spark.read.parquet(str(tmp_path / "linked_families")).count() == 9
    study.write_tables(str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "master")).count() == 12


def test_design(run):
    nobody = run(Design(zones=("OH",)))
    assert nobody.base.count() == 0 and nobody.build_study_population().count() == 0
    trimmed = run(Design(adult_links_only=True))
    assert {r.src for r in trimmed.lineage.links.collect()} == {person(1, 3), person(2, 3)}
    short = run(Design(rounds=1, hops=1))
    assert {(r.src, r.tgt) for r in short.lineage.links.collect()} == {
        (person(1, 3), person(1, 1)),
        (person(1, 3), person(1, 2)),
        (person(2, 3), person(1, 3)),
    }
    assert run(Design(private_households_only=True)).master.count() == 12


def test_large_keys_keep_households_apart(spark):
    from kinspark.plans import census_inputs as inputs

    keys = [1, 35, 36, 123456780, 123456788, 36**8 - 1]
    df = spark.createDataFrame([(k,) for k in keys], "o_orderkey long")
    serials = [r[0] for r in df.selectExpr(inputs.SERIAL).collect()]
    assert len(set(serials)) == len(keys) and all(len(x) == 8 for x in serials)
    assert [int(x, 36) for x in serials] == keys
    with pytest.raises(Exception):
        spark.createDataFrame([(36**8,)], "o_orderkey long").selectExpr(inputs.SERIAL).collect()


def test_every_record_has_two_regions(spark):
    from kinspark.plans import census_inputs as inputs

    rows = spark.createDataFrame([("000010",), ("250010",), ("990010",), ("XX0010",), (None,)], "countycode string")
    tables = inputs.extracts(rows)
    assert sum(t.count() for t in tables) == 2 * rows.count()


def test_category_of_a_person_listed_twice(spark):
    from kinspark.operators.population import with_slaveholding

    people = spark.createDataFrame([("a",), ("b",), ("c",)], "hik string")
    listed = spark.createDataFrame([("a", None), ("a", "2"), ("a", "3"), ("b", None)], "hik string, slvhcat string")
    assert {tuple(r) for r in with_slaveholding(people, listed).collect()} == {("a", "2"), ("b", "0"), ("c", "0")}


@pytest.fixture
def shared(monkeypatch, tmp_path):
    """A checkpoint folder that several studies of a session see."""
    from kinspark.sources import stage

    folder = str(tmp_path / "checkpoints")
    monkeypatch.setattr(stage, "checkpoint_root", lambda spark: folder)
    return folder


@pytest.fixture
def stored(spark, census, batches, tmp_path):
    """Studies of one run over stored inputs, as after a restart of the driver."""
    rows = three_generations("51")
    inputs = {
        "census": census(*rows), "more": census(*rows[6:]), "batches": batches(13),
        "counties": spark.createDataFrame([("510010", "KB")], "countycode string, zone string"),
        "held": spark.createDataFrame([(person(1, 1), "3")], "hik string, slvhcat string"),
    }
    for name, table in inputs.items():
        table.write.parquet(str(tmp_path / name))

    def start(design=Design(), run="trial"):
        read = {name: spark.read.parquet(str(tmp_path / name)) for name in inputs}
        regions = [Region(read["census"], read["batches"]), Region(read["more"], read["batches"])]
        return Study(spark, regions, read["counties"], read["held"], design=design, run=run)

    return start


def test_a_stopped_study_goes_on(spark, shared, stored, tmp_path):
    first = stored()
    assert first.base.count() == 3 and first.ids.count() == 7
    made = first.stage.written
    assert {"extract_00", "extract_01", "master", "lineage_links", "base"} <= set(made) and len(set(made)) == len(made)

    second = stored()
    again = {tuple(r) for r in second.build_study_population().collect()}
    assert second.stage.written == ["adults"]
    assert "Bucketed: true" in plan_of(second.build_master()) and "Exchange" not in plan_of(second.build_master())
    assert again == {tuple(r) for r in first.build_study_population().collect()}
    assert sorted(second.lineage.members.collect()) == sorted(first.lineage.members.collect())

    third = stored()
    assert third.build_study_population().count() == 7 and third.base.count() == 3 and third.stage.written == []
    # Another design, other inputs or another run share nothing; what they write replaces the run's entries.
    assert stored(run="other").stage.root != third.stage.root
    wider = stored(Design(rounds=1, hops=1))
    assert wider.graph.count() < 9 and "master" in wider.stage.written
    spark.createDataFrame([(person(1, 2), "1")], "hik string, slvhcat string").write.mode("append").parquet(str(tmp_path / "held"))
    changed = stored()
    assert {r.slvhcat for r in changed.base.collect()} == {"0", "1", "3"} and "extract_00" in changed.stage.written


def test_a_half_written_step_is_made_again(spark, shared, stored):
    first = stored()
    with pytest.raises(Exception, match="stopped"):
        first.stage.step("sexes", lambda: first.master.selectExpr("hik", "raise_error('stopped') as sex"))
    second = stored()
    assert second.sexes.count() == 7 and second.stage.written == ["sexes"]


def test_runs_need_stored_inputs(run):
    with pytest.raises(ValueError):
        run(run="memory")


def test_stale_folders_expire(spark, shared):
    import os
    import time

    from kinspark.sources.stage import Stage, expire

    old, fresh, resumed = Stage(spark), Stage(spark), Stage(spark, run="r")
    for made in (old, fresh, resumed):
        made.step("t", lambda: spark.range(3))
    long_ago = time.time() - 9 * 86_400
    for made in (old, resumed):
        for place, _, _ in os.walk(made.root):
            os.utime(place, (long_ago, long_ago))
    (entry,) = os.listdir(f"{resumed.root}/manifest")[:1] or [None]
    os.utime(f"{resumed.root}/manifest/{entry}")  # this run has just finished a step
    assert [path.rsplit("/", 1)[1] for path in expire(spark, days=7)] == [old.root.rsplit("/", 1)[1]]
    assert os.path.isdir(fresh.root) and os.path.isdir(resumed.root)


def test_extracts_are_stacked_without_a_shuffle(spark, run, sf_dir):
    from kinspark.operators import people
    from kinspark.plans.study import study_of

    for study in (run(), study_of(spark, sf_dir)):
        master = study.build_master()
        plan = plan_of(master)
        assert "Exchange" not in plan and plan.count("Bucketed: true") == len(study.extracts)
        plain = people.master_census([study.stage.save("copy", extract) for extract in study.extracts])
        assert "Exchange" in plan_of(plain)
        rows = sorted(map(str, master.collect()))
        assert rows == sorted(map(str, plain.collect())) and len(rows) == master.count()


@pytest.mark.parametrize("limits", [{}, {"broadcast_ids": 0}, {"broadcast_ids": 0, "bloom_ids": 0}])
def test_attributes_of_the_study_only(spark, records, limits):
    from kinspark.functions.membership import keep_candidates
    from kinspark.operators import people, population

    master = records(*({"hik": f"p{i % 400}", "birthyr": 1800 + i % 7, "personcode": str(i)} for i in range(2_000)), {"hik": None})
    ids = spark.createDataFrame([(f"p{i}",) for i in range(0, 400, 10)], "hik string")
    everyone = people.person_attributes(master)
    found = population.attributes_of(master, ids, 40, **limits)
    assert sorted(found.join(ids, "hik").collect()) == sorted(everyone.join(ids, "hik").collect())
    kept = keep_candidates(master, ids, "hik", 40, **limits).count()
    plan = plan_of(found)
    if not limits:
        assert kept == 200 and plan.index("WindowGroupLimit") < plan.index("BroadcastHashJoin")
    elif "bloom_ids" not in limits:
        assert 200 <= kept < 500 and plan.index("WindowGroupLimit") < plan.index("BroadcastNestedLoopJoin BuildRight, LeftSemi")
    else:
        assert kept == 2_001
    before_the_join = plan[plan.index("LeftSemi"):] if "LeftSemi" in plan else ""
    assert "Exchange hashpartitioning(hik" not in before_the_join


def test_bloom_filter_of_many_ids(spark):
    from kinspark.functions.membership import keep_candidates, words_for

    ids = spark.range(0, 100_000, 2).selectExpr("cast(id as string) hik")
    rows = spark.range(100_000).selectExpr("cast(id as string) hik", "id")
    kept = keep_candidates(rows, ids, "hik", 50_000, broadcast_ids=0)
    counts = kept.groupBy((kept.id % 2).alias("odd")).count().collect()
    counts = {r.odd: r["count"] for r in counts}
    assert counts[0] == 50_000 and counts[1] < 50_000 * 0.06
    assert [words_for(n) for n in (0, 1, 8, 9, 16_000_000)] == [1, 1, 1, 2, 1 << 21]


def test_base_populations_need_no_lineage(spark, sf_dir):
    from kinspark.plans.queries import QUERIES
    from kinspark.plans.study import FolderStudy

    with FolderStudy(spark, sf_dir) as study:
        alone = {name: sorted(QUERIES[name](study).collect()) for name in ("base_population", "base_population_adults")}
        assert not {"lineage_links", "graph", "ids", "attributes"} & set(study.stage.written)
        assert study.attributes.count() > len(alone["base_population"]) > 0
        for name, rows in alone.items():
            assert sorted(QUERIES[name](study).collect()) == rows


def test_a_large_family_deals_the_extracts_out_by_record(run, monkeypatch):
    from kinspark.operators import families

    plain = run()
    assert plain._dealt_by_family() and "dealt" not in plain.master.columns
    rows = sorted(map(str, plain.master.collect()))
    sizes = families.family_sizes

    monkeypatch.setattr(families, "family_sizes", lambda persons: sizes(persons, 2, 4))
    spread = run()
    assert not spread._dealt_by_family() and "Exchange" not in plan_of(spread.build_master())
    assert sorted(map(str, spread.master.collect())) == rows


def test_buckets_grow_with_the_records(run, monkeypatch):
    from kinspark.operators import families, kinship

    assert [families.partitions_for(n) for n in (0, 250_000, 250_001)] == [1, 1, 2]
    monkeypatch.setattr(families, "MEMBERS_PER_PARTITION", 2)
    study = run()
    assert study._buckets() == 5 and plan_of(study.build_master()).count("5 out of 5") == 3
    # Adults and children of a family meet where they lie.
    assert "Exchange hashpartitioning" not in plan_of(kinship.parent_child_pairs(study.master))


def test_narrow_and_compressed_inputs_of_the_queries(spark, sf_dir, monkeypatch):
    from kinspark.plans import study as plans
    from kinspark.plans.queries import QUERIES
    from kinspark.sources import files

    monkeypatch.setattr(plans, "LINES_PER_FILE", 2_000)
    with plans.FolderStudy(spark, sf_dir) as study:
        numbers = sorted(map(str, QUERIES["family_number"](study).collect()))
        assert "extract" not in study.stage.written
        assert QUERIES["fixed_width_load"](study).count() == study.census.count()
        parts = [path for path in files.children(spark, study.census_text) if "part-" in path]
        assert len(parts) >= study.census.count() / 2_000 and all(path.endswith(".gz") for path in parts)
        regional = [sorted(map(str, table.collect())) for table in study.extracts]
        assert regional == [sorted(map(str, table.collect())) for table in plans.census_inputs.extracts(study.extract)]
        assert sorted(map(str, QUERIES["family_number"](study).collect())) == numbers
