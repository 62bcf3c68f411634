"""The bounded walk against a hop-by-hop walk in plain Python."""

from __future__ import annotations

import random

import pytest

from kinspark.operators import lineage
from kinspark.operators.lineage import DOWN, UP, EdgeIndex, LineageWalker

from tests.conftest import plan_of

LINKS = "src string, tgt string, edg string, sxs string, sxt string, weight double"


def links_of(spark, pairs, marriages=()):
    rows = [(s, t, "1", "1", "1", 1.0) for s, t in pairs] + [(s, t, "0", "1", "2", 1.0) for s, t in marriages]
    return spark.createDataFrame(rows, LINKS)


def ids_of(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "hik string")


def pairs_of(df):
    rows = [(r.src, r.tgt) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def hop_by_hop(pairs, seeds, rounds=3, hops=3, carried=None):
    """Every hop from every known person, gathering the edges met on each."""
    known, edges, carried = set(seeds), set(), set(seeds if carried is None else carried)
    for half in range(2 * rounds):
        near, far = (0, 1) if half % 2 == 0 else (1, 0)
        frontier, met = set(known), set()
        for _ in range(hops):
            step = {p for p in pairs if p[near] in frontier}
            met |= step
            frontier = {p[far] for p in step}
        ends = {x for p in met for x in p}
        known = ends | (carried if half == 0 else known)
        edges |= met
    return edges, known


def pedigree(seed, people=120, edges=170):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(people)}", f"n{rng.randrange(people)}") for _ in range(edges)})


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_edges_and_members_as_hop_by_hop(spark, stage, seed):
    pairs = pedigree(seed)
    seeds = ["n1", "n2", "n3", "nobody"]
    got = lineage.bounded_lineage(links_of(spark, pairs), ids_of(spark, seeds), stage, rounds=2)
    edges, known = hop_by_hop(pairs, seeds, rounds=2)
    assert pairs_of(got.links) == edges
    members = [r.hik for r in got.members.collect()]
    assert set(members) == known and len(members) == len(known)


@pytest.mark.parametrize("carried", [[], ["n2", "n50", "n51"]])
def test_carried_persons(spark, stage, carried):
    pairs = [("kid", "n3"), ("n3", "gran"), ("kid2", "n2"), ("kid5", "n50"), ("n50", "gran5"), ("n4", "n4")]
    seeds = ["n1", "n2", "n3", "n4"]
    got = lineage.bounded_lineage(
        links_of(spark, pairs), ids_of(spark, seeds), stage, rounds=2, carried=ids_of(spark, carried)
    )
    edges, known = hop_by_hop(pairs, seeds, rounds=2, carried=carried)
    assert pairs_of(got.links) == edges
    assert {r.hik for r in got.members.collect()} == known


def test_base_person_without_ancestors(spark, stage):
    """Known only through the carried set: with it the child is found, without it nothing is."""
    links = links_of(spark, [("child", "base")])
    found = lineage.bounded_lineage(links, ids_of(spark, ["base"]), stage, rounds=1)
    assert pairs_of(found.links) == {("child", "base")}
    empty = lineage.bounded_lineage(links, ids_of(spark, ["base"]), stage, rounds=1, carried=ids_of(spark, []))
    assert pairs_of(empty.links) == set() and empty.members.count() == 0


def test_walk_stops_at_its_bound(spark, stage):
    line = [(f"g{i:02d}", f"g{i + 1:02d}") for i in range(25)]
    links, seeds = links_of(spark, line), ids_of(spark, ["g00"])
    three = lineage.bounded_lineage(links, seeds, stage)
    assert {r.hik for r in three.members.collect()} == {f"g{i:02d}" for i in range(10)}
    assert pairs_of(three.links) == set(line[:9])
    closed = lineage.bounded_lineage(links, seeds, stage, rounds=20)
    assert pairs_of(closed.links) == set(line)


def test_walk_up_and_down(spark, stage):
    line = [(f"g{i}", f"g{i + 1}") for i in range(9)]
    links, seeds = links_of(spark, line), ids_of(spark, ["g4"])
    for hops in (1, 2, 3):
        up = lineage.walk_edges(links, seeds, UP, hops, stage)
        down = lineage.walk_edges(links, seeds, DOWN, hops, stage)
        assert pairs_of(up) == set(line[4 : 4 + hops])
        assert pairs_of(down) == set(line[4 - hops : 4])


def test_no_seeds(spark, stage):
    got = lineage.bounded_lineage(links_of(spark, [("a", "b")]), ids_of(spark, []), stage)
    assert got.links.count() == 0 and got.members.count() == 0
    assert got.links.columns == ["src", "tgt", "edg", "weight", "sxs", "sxt"]


@pytest.mark.parametrize("frequent_edges", [1_000_000, 20])
def test_large_frontier_path_gives_the_same(spark, stage, frequent_edges):
    """Bucketed edges, with and without keys that are too frequent for a bucket."""
    pairs = pedigree(5) + [(f"c{i}", "hub") for i in range(60)] + [("n1", "hub"), ("hub", "n2")]
    seeds = ["n1", "n7"]
    got = lineage.bounded_lineage(
        links_of(spark, pairs), ids_of(spark, seeds), stage, rounds=1, broadcast_ids=0,
        frequent_edges=frequent_edges,
    )
    edges, known = hop_by_hop(pairs, seeds, rounds=1)
    assert pairs_of(got.links) == edges
    assert {r.hik for r in got.members.collect()} == known


@pytest.fixture
def no_broadcast(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def chain_walk(spark, stage, monkeypatch, people=2_000, seeds=1_500, **options):
    """A walk over a chain of people, with more than one bucket."""
    monkeypatch.setattr(lineage, "EDGES_PER_BUCKET", 400)
    chain = spark.range(people).selectExpr("cast(id as string) src", "cast(id + 1 as string) tgt", "'1' edg")
    index = EdgeIndex(chain, stage, **options)
    assert index.buckets == 5
    walker = LineageWalker(index, stage)
    return walker, walker.start(spark.range(seeds).selectExpr("cast(id as string) hik"))


def test_large_frontier_shuffles_neither_edges_nor_persons(spark, stage, no_broadcast, monkeypatch):
    walker, walk = chain_walk(spark, stage, monkeypatch, broadcast_ids=0)
    near = walker.index.neighbours(walk.reached, UP)
    plan = plan_of(near)
    assert "Exchange" not in plan and plan.count("SelectedBucketsCount: 5 out of 5") == 2
    assert near.count() == 1_500


@pytest.mark.parametrize("broadcast_ids", [0, 1_000_000])
def test_a_hop_shuffles_the_neighbours_only(spark, stage, no_broadcast, monkeypatch, broadcast_ids):
    walker, walk = chain_walk(spark, stage, monkeypatch, broadcast_ids=broadcast_ids)
    walker.half_round(walk, UP, 2)
    new = walker.newcomers(walk, walk.reached[-1:], UP)
    plan = plan_of(new)
    near, known = plan.split("LeftAnti")[1].rsplit(":  +-", 1)[0], plan.rsplit("+- Sort", 1)[1]
    assert "Exchange" not in known and "_known" in known and "Bucketed: true" in known
    assert plan.count("Exchange hashpartitioning") == 2 == near.count("Exchange hashpartitioning")
    assert [r.hik for r in new.collect()] == ["1502"]


@pytest.mark.parametrize("broadcast_ids", [0, 1_000_000])
def test_edges_are_picked_in_one_pass(spark, stage, no_broadcast, monkeypatch, broadcast_ids):
    walker, walk = chain_walk(spark, stage, monkeypatch, broadcast_ids=broadcast_ids)
    walker.half_round(walk, UP, 2)
    walker.half_round(walk, DOWN, 1)
    picked = walker.index.pick(walk.expanded)
    plan = plan_of(picked)
    scans = [line for line in plan.splitlines() if "FileScan" in line and "src" in line.split("Batched")[0]]
    if broadcast_ids:
        assert "Exchange hashpartitioning" not in plan and plan.count("Range (0, 2000") == 1
    else:
        # The edges come in buckets of their sources and are dealt out once, by target.
        assert len(scans) == 1 and "Bucketed: true" in scans[0] and "Range" not in plan
        assert plan.count("Exchange hashpartitioning") - plan.count("Exchange hashpartitioning(hik") == 1
    assert pairs_of(picked) == {(str(i), str(i + 1)) for i in range(1_501)}


def test_buckets_follow_the_edges():
    assert [lineage.buckets_for(n) for n in (0, 1, 250_001, 10**9, 10**11)] == [1, 1, 2, 4000, 12_500]
    assert lineage.buckets_for(1_100_000_000) == 4096


def test_steps_of_a_growing_table(spark, stage):
    grown = stage.growing("grown", "hik", 3)
    assert grown.append(ids_of(spark, ["a", "b"]).repartition(3, "hik")) == (0, 2)
    assert grown.append(ids_of(spark, []).repartition(3, "hik")) == (1, 0)
    assert grown.append(grown.read([0]).selectExpr("hik || hik AS hik").repartition(3, "hik")) == (2, 2)
    assert sorted(r.hik for r in grown.read([0, 2]).collect()) == ["a", "aa", "b", "bb"]
    assert grown.read([1]).count() == 0


def test_marriages_of_lineage_people(spark, stage):
    links = links_of(
        spark,
        [("kid", "dad")],
        marriages=[("dad", "mum"), ("kid", "spouse"), ("other", "kid"), ("x", "y")],
    )
    line = lineage.bounded_lineage(links, ids_of(spark, ["kid"]), stage, rounds=1).links
    assert pairs_of(lineage.lineage_marriages(links, line)) == {("dad", "mum"), ("kid", "spouse")}
    graph = lineage.linked_families(links, line)
    assert pairs_of(graph) == {("kid", "dad"), ("dad", "mum"), ("kid", "spouse")}
    adults = ids_of(spark, ["dad"])
    assert lineage.adult_links_only(line, adults).count() == 0
    assert lineage.adult_links_only(line, ids_of(spark, ["kid", "kid"])).count() == 1


def test_steps_are_written_to_the_session_folder(spark, stage):
    from kinspark.sources.stage import checkpoint_root

    walk = LineageWalker(EdgeIndex(links_of(spark, [("a", "b")]), stage), stage).start(ids_of(spark, ["a"]))
    assert walk.reached[0].path.startswith(stage.root)
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert checkpoint_root(spark) == named.rstrip("/")


def test_a_large_frontier_sorts_no_edges(spark, stage, no_broadcast, monkeypatch):
    walker, walk = chain_walk(spark, stage, monkeypatch, broadcast_ids=0)
    near = walker.index.neighbours(walk.reached, UP)
    assert "Sort" not in plan_of(near) and "ShuffledHashJoin" in plan_of(near)
    walk.expanded[UP] = walk.reached
    assert "Sort" not in plan_of(walker.index.pick(walk.expanded))
    monkeypatch.setattr(lineage, "HASHED_IDS", 10)  # too many persons in a bucket to be hashed
    assert "SortMergeJoin" in plan_of(walker.index.neighbours(walk.reached, UP))
    assert walker.index.neighbours(walk.reached, UP).count() == near.count() == 1_500


def test_frequent_keys_by_cells(spark, stage, monkeypatch):
    """A large cell of several keys, none of them frequent, gives none."""
    monkeypatch.setattr(lineage, "COUNT_CELLS", 3)
    pairs = [("hot", f"t{i}") for i in range(30)] + [(f"s{i}", f"t{i}") for i in range(90)]
    index = EdgeIndex(links_of(spark, pairs).select("src", "tgt", "edg"), stage, frequent_edges=20)
    assert [r.src for r in index._frequent("src").collect()] == ["hot"]
    assert index._frequent("tgt").count() == 0


def test_tasks_of_a_step_follow_the_persons(spark, stage, monkeypatch):
    monkeypatch.setattr(lineage, "EDGES_PER_BUCKET", 20)
    chain = spark.range(2_000).selectExpr("cast(id as string) src", "cast(id + 1 as string) tgt", "'1' edg")
    walker = LineageWalker(EdgeIndex(chain, stage), stage)
    walk = walker.start(spark.range(1_500).selectExpr("cast(id as string) hik"))
    assert walker.index.buckets == 100
    assert walker.tasks(walk) == 2 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(lineage, "PERSONS_PER_TASK", 30)
    assert walker.tasks(walk) == 50
    step = walker.add(walk, walker.newcomers(walk, walk.reached, UP))
    assert step.size == 1 and [r.hik for r in walk.table.read([step.number]).collect()] == ["1500"]
