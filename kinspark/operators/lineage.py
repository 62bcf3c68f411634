"""Bounded lineage: alternate walks up (to parents) and down (to children) the descent edges.

A round walks ``hops`` steps up from everyone known, then ``hops`` steps down from everyone known
by then. Three facts make this cheap:

* Only persons travel. A half-round's edges are exactly those whose source (walking up) or target
  (walking down) was expanded, so edges are picked once, at the end, by the two sets of expanded
  persons, instead of being collected and deduplicated on each of the hops.
* Nobody is expanded twice in one direction. A person expanded upward earlier has all parents among
  the known persons, who start the next upward walk anyway; so that walk need only start from those
  not yet expanded, and reaches the same persons at the same hop.
* Everyone known is one table, bucketed by person, to which each step is appended. A step's newcomers are
  hashed by person the same way and compared bucket by bucket, so the known persons are never shuffled;
  only the neighbours of the frontier are. An executor loss costs one step, and every step's exact size is known.
* A frontier within ``broadcast_ids`` is broadcast and the edges are scanned without a shuffle. Beyond that, the
  edges are laid out once per direction, bucketed by the side they are looked up on, in as many buckets as the
  known persons: then neither side is shuffled, and the edges are not sorted, as a bucket's persons are hashed.
  Edges of keys too frequent for one bucket task are kept apart and matched by broadcast.
* Buckets follow the edges, of which a step reaches few; so one task takes as many buckets as it has persons for.
* The edges of the lineage are picked in one pass over the edges, with a mark for either end.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kinspark.operators.kinship import descent_edges, marriage_edges
from kinspark.sources.schemas import LINEAGE_COLUMNS
from kinspark.sources.stage import GrowingTable, Stage

UP, DOWN = "up", "down"
LOOKUP = {UP: "src", DOWN: "tgt"}
REACHED = {UP: "tgt", DOWN: "src"}

BROADCAST_IDS = 1_000_000  # person keys are some 20 characters: at most about 100 MB in a task
FREQUENT_KEYS = 10_000  # bound of the list of frequent keys that is broadcast
FREQUENT_EDGES = 1_000_000  # a key with more edges than this is kept out of the buckets
COUNT_CELLS = 65_536  # keys are counted one by one only where as many cells of hashed keys are large
HASHED_IDS = 1_000_000  # of a bucket's persons: at most about 100 MB in a task, as above
PERSONS_PER_TASK = 250_000


EDGES_PER_BUCKET = 250_000
MANY_BUCKETS, MOST_EDGES_PER_BUCKET = 4096, 8_000_000  # beyond so many buckets they grow, to this size first


def buckets_for(edges: int) -> int:
    """Buckets for the edges, and for the persons met along them."""
    fine = -(-edges // EDGES_PER_BUCKET)
    return max(1, fine if fine <= MANY_BUCKETS else max(MANY_BUCKETS, -(-edges // MOST_EDGES_PER_BUCKET)))


@dataclass(frozen=True)
class Step:
    """Persons first reached by one step: a step of the table of known persons, and its row count."""

    table: GrowingTable
    number: int
    size: int

    @property
    def path(self) -> str:
        return self.table.path


@dataclass
class Walk:
    """What a walk has reached and expanded so far."""

    table: GrowingTable
    reached: list[Step] = field(default_factory=list)
    expanded: dict[str, list[Step]] = field(default_factory=lambda: {UP: [], DOWN: []})
    waiting: dict[str, list[Step]] = field(default_factory=lambda: {UP: [], DOWN: []})

    def known(self) -> DataFrame:
        return stack(self.reached)


def stack(steps: list[Step]) -> DataFrame:
    """The persons of several steps of one walk, as one scan that keeps their buckets."""
    return steps[0].table.read(step.number for step in steps)


def size_of(steps: list[Step]) -> int:
    return sum(step.size for step in steps)


class EdgeIndex:
    """Descent edges, each once, looked up by source or by target."""

    def __init__(
        self,
        edges: DataFrame,
        stage: Stage,
        broadcast_ids: int = BROADCAST_IDS,
        frequent_edges: int = FREQUENT_EDGES,
    ):
        self.stage = stage
        self.broadcast_ids = broadcast_ids
        self.frequent_edges = frequent_edges
        self.edges = edges
        rows = Observation()
        pairs = edges.select("src", "tgt").observe(rows, F.count(F.lit(1)).alias("n"))
        self.pairs = stage.save("lineage_pairs", pairs)
        self.buckets = buckets_for(rows.get["n"])
        self._layouts: dict[str, tuple[DataFrame, DataFrame | None, DataFrame | None]] = {}

    def met(self, frontier: list[Step], direction: str) -> DataFrame:
        """The (src, tgt) pairs that lead one step away from the frontier."""
        key = LOOKUP[direction]
        ids = stack(frontier).select(F.col("hik").alias(key))
        if size_of(frontier) <= self.broadcast_ids:
            return self.pairs.join(F.broadcast(ids), key, "left_semi")
        spread, gathered, frequent = self._layout(direction)
        found = spread.select("src", "tgt").join(self._in_buckets(frontier, ids), key, "left_semi")
        if gathered is not None:
            wanted = ids.join(F.broadcast(frequent), key, "left_semi")
            found = found.unionByName(gathered.select("src", "tgt").join(F.broadcast(wanted), key, "left_semi"))
        return found

    def neighbours(self, frontier: list[Step], direction: str) -> DataFrame:
        """The persons one step away from the frontier (``hik``, with repeats)."""
        return self.met(frontier, direction).select(F.col(REACHED[direction]).alias("hik"))

    def pick(self, expanded: dict[str, list[Step]]) -> DataFrame:
        """Edges whose source was expanded upward or whose target was expanded downward, in one pass."""
        marked, marks = self.edges, []
        for direction in (UP, DOWN):
            steps, key, mark = expanded[direction], LOOKUP[direction], f"_{direction}"
            if not steps:
                continue
            ids = stack(steps).select(F.col("hik").alias(key), F.lit(True).alias(mark))
            if size_of(steps) <= self.broadcast_ids:
                marked = marked.join(F.broadcast(ids), key, "left")
            elif direction == UP:
                spread, gathered, frequent = self._layout(UP)
                marked = spread.join(self._in_buckets(steps, ids), key, "left")
                if gathered is not None:
                    wanted = ids.join(F.broadcast(frequent), key, "left_semi")
                    marked = marked.unionByName(gathered.join(F.broadcast(wanted), key, "left"))
            else:
                marked = marked.join(self._in_buckets(steps, ids), key, "left")
            marks.append(F.coalesce(F.col(mark), F.lit(False)))
        chosen = marked.filter(reduce(Column.__or__, marks)) if marks else marked.limit(0)
        return chosen.select(*self.edges.columns)

    def _in_buckets(self, steps: list[Step], ids: DataFrame) -> DataFrame:
        """The ids as the side that is hashed in a join by buckets, so that edges are not sorted for it.

        Where a bucket has too many of them, both sides are sorted, which may spill.
        """
        return ids.hint("shuffle_hash") if size_of(steps) <= HASHED_IDS * self.buckets else ids

    def _frequent(self, key: str) -> DataFrame:
        """The keys with more than ``frequent_edges`` edges. Only keys of large cells are counted one by one."""
        n, cell = F.count(F.lit(1)).alias("n"), F.pmod(F.xxhash64(key), F.lit(COUNT_CELLS)).alias("cell")
        large = self.pairs.groupBy(cell).agg(n).filter(F.col("n") > self.frequent_edges).select("cell")
        rows = self.pairs.select(key, cell).join(F.broadcast(large), "cell", "left_semi")
        frequent = rows.groupBy(key).agg(n).filter(F.col("n") > self.frequent_edges)
        return frequent.orderBy(F.col("n").desc()).limit(FREQUENT_KEYS).select(key)

    def _layout(self, direction: str) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        """(edges bucketed by key, edges of frequent keys, those keys), built on first need.

        By source whole edges, from which the lineage is picked; by target the pairs alone.
        """
        if direction not in self._layouts:
            key, save = LOOKUP[direction], self.stage.save
            rows = self.edges if direction == UP else self.pairs
            frequent = save(f"frequent_{direction}", self._frequent(key))
            spread, gathered = rows, None
            if not frequent.isEmpty():
                spread = rows.join(F.broadcast(frequent), key, "left_anti")
                gathered = rows.join(F.broadcast(frequent), key, "left_semi")
                gathered = save(f"gathered_{direction}", gathered)
            spread = self.stage.save_bucketed(f"pairs_{direction}", spread, key, self.buckets, ordered=False)
            self._layouts[direction] = (spread, gathered, frequent)
        return self._layouts[direction]


class LineageWalker:
    """Runs half-rounds over an edge index; every step writes the persons it reaches."""

    def __init__(self, index: EdgeIndex, stage: Stage):
        self.index = index
        self.stage = stage

    def hashed(self, ids: DataFrame) -> DataFrame:
        """Distinct persons, dealt out as the known ones are."""
        return ids.select("hik").distinct().repartition(self.index.buckets, "hik")

    def newcomers(self, walk: Walk, frontier: list[Step], direction: str) -> DataFrame:
        """Persons one step away from the frontier who are not known yet."""
        near = self.hashed(self.index.neighbours(frontier, direction))
        return near.join(walk.known(), "hik", "left_anti")

    def add(self, walk: Walk, ids: DataFrame) -> Step:
        return Step(walk.table, *walk.table.append(ids.coalesce(self.tasks(walk))))

    def tasks(self, walk: Walk) -> int:
        """Tasks that write a step: no more than the known persons need, each taking its buckets one by one."""
        needed = -(-size_of(walk.reached) // PERSONS_PER_TASK)
        return min(self.index.buckets, max(needed, 2 * self.stage.spark.sparkContext.defaultParallelism))

    def half_round(self, walk: Walk, direction: str, hops: int) -> bool:
        """Expand everyone waiting in this direction; True if somebody was reached."""
        other = DOWN if direction == UP else UP
        frontier = [step for step in walk.waiting[direction] if step.size]
        walk.waiting[direction] = []
        grown = False
        for _ in range(hops):
            if not frontier:
                break
            walk.expanded[direction] += frontier
            step = self.add(walk, self.newcomers(walk, frontier, direction))
            frontier = []
            if step.size:
                walk.reached.append(step)
                walk.waiting[other].append(step)
                frontier, grown = [step], True
        walk.waiting[direction] += frontier
        return grown

    def start(self, seeds: DataFrame) -> Walk:
        walk = Walk(self.stage.growing("known", "hik", self.index.buckets))
        first = self.add(walk, self.hashed(seeds.filter(F.col("hik").isNotNull())))
        walk.reached, walk.waiting = [first], {UP: [first], DOWN: [first]}
        return walk

    def keep_connected_seeds(self, walk: Walk, carried: DataFrame) -> None:
        """After the first walk up: go on with the ends of its edges and the carried persons only.

        A seed that is neither is dropped (it may come back as someone's descendant), and carried
        persons that were not seeds join, still to be expanded both ways.
        """
        seeds, found = walk.reached[0], walk.reached[1:]
        pairs = self.index.met(walk.expanded[UP], UP) if walk.expanded[UP] else self.index.pairs.limit(0)
        ends = pairs.select(F.explode(F.array("src", "tgt")).alias("hik"))
        carried = self.hashed(carried.filter(F.col("hik").isNotNull()))
        staying = self.hashed(ends.unionAll(carried))
        kept = self.add(walk, stack([seeds]).join(staying, "hik", "left_semi"))
        joined = self.add(walk, carried.join(stack([seeds, *found]), "hik", "left_anti"))
        walk.reached = [kept, joined, *found]
        walk.waiting[DOWN] = [kept, joined, *found]
        walk.waiting[UP].append(joined)


def walk_edges(
    links: DataFrame,
    seeds: DataFrame,
    direction: str,
    hops: int,
    stage: Stage,
    broadcast_ids: int = BROADCAST_IDS,
) -> DataFrame:
    """Edges met within ``hops`` steps up or down from the seeds."""
    edges = descent_edges(links).select(*LINEAGE_COLUMNS)
    walker = LineageWalker(EdgeIndex(edges, stage, broadcast_ids), stage)
    walk = walker.start(seeds)
    if hops > 1:
        walker.half_round(walk, direction, hops - 1)
    walk.expanded[direction] += walk.waiting[direction]
    return walker.index.pick(walk.expanded)


@dataclass
class Lineage:
    """The descent edges of a bounded lineage and the persons it reached."""

    links: DataFrame
    members: DataFrame


def bounded_lineage(
    links: DataFrame,
    seeds: DataFrame,
    stage: Stage,
    rounds: int = 3,
    hops: int = 3,
    carried: DataFrame | None = None,
    broadcast_ids: int = BROADCAST_IDS,
    frequent_edges: int = FREQUENT_EDGES,
) -> Lineage:
    """``rounds`` times: ``hops`` steps up from everyone known, then ``hops`` steps down.

    ``links`` holds each edge once, as ``kinship_links`` does.

    ``carried`` names the persons that stay in after the first walk up even without an edge; by
    default these are the seeds. Stops early once a whole round reaches nobody new.
    """
    edges = descent_edges(links).select(*LINEAGE_COLUMNS)
    walker = LineageWalker(EdgeIndex(edges, stage, broadcast_ids, frequent_edges), stage)
    walk = walker.start(seeds)
    for number in range(rounds):
        grown = walker.half_round(walk, UP, hops)
        if number == 0 and carried is not None:
            walker.keep_connected_seeds(walk, carried)
            grown = True
        grown = walker.half_round(walk, DOWN, hops) or grown
        if not grown:
            break
    return Lineage(walker.index.pick(walk.expanded), walk.known())


def adult_links_only(lineage_links: DataFrame, adults: DataFrame) -> DataFrame:
    """Optional trimming: only edges whose source was ever recorded as an adult."""
    return lineage_links.join(adults.select(F.col("hik").alias("src")), "src", "left_semi").select(
        *lineage_links.columns
    )


def lineage_marriages(links: DataFrame, lineage_links: DataFrame) -> DataFrame:
    """Marriages whose husband is a man, or whose wife is a woman, of the lineage edges."""
    ends = F.explode(
        F.array(
            F.struct(F.col("src").alias("hik"), F.col("sxs").alias("sex")),
            F.struct(F.col("tgt").alias("hik"), F.col("sxt").alias("sex")),
        )
    )
    people = lineage_links.select(ends.alias("end")).select("end.*").distinct()
    men = people.filter(F.col("sex") == "1").select(F.col("hik").alias("src"))
    women = people.filter(F.col("sex") == "2").select(F.col("hik").alias("tgt"))
    marriages = marriage_edges(links)
    of_men = marriages.join(men, "src", "left_semi").select(*LINEAGE_COLUMNS)
    of_women = marriages.join(women, "tgt", "left_semi").select(*LINEAGE_COLUMNS)
    return of_men.unionByName(of_women).distinct()


def linked_families(links: DataFrame, lineage_links: DataFrame) -> DataFrame:
    """The lineage graph: its descent edges and the marriages attached to them.

    The two kinds differ in ``edg`` and each is already distinct, so stacking them is their union.
    """
    return lineage_marriages(links, lineage_links).unionByName(lineage_links.select(*LINEAGE_COLUMNS))
