"""The chain from regional census tables to the study population, each shared table written once."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.operators import families, kinship, lineage, people, population
from kinspark.operators.person_records import person_records
from kinspark.plans import census_inputs
from kinspark.sources import codebook, files, hierarchical
from kinspark.sources.schemas import CENSUS_WIDTHS, EXTRACT_COLUMNS
from kinspark.sources.stage import Dealt, Stage
from kinspark.sources.tables import replace_table_ordered


@dataclass(frozen=True)
class Region:
    """One regional census: raw person records and the import batches known when it is run."""

    census: DataFrame
    batches: DataFrame


@dataclass(frozen=True)
class Design:
    """Who the base population is and how far its lineage is followed."""

    years: tuple[int, ...] = (1870,)
    zones: tuple[str, ...] = ("KB",)
    roles: tuple[str, ...] | None = None
    rounds: int = 3
    hops: int = 3
    private_households_only: bool = False
    adult_links_only: bool = False


class Study:
    """One run. Cached properties are the written tables, made on first use; ``build_`` methods
    return the step itself, not yet written.

    With a ``run`` name the study can be resumed: a later one of the same run, inputs and design reads the tables
    that are finished and goes on from there. Its inputs must be stored tables then.
    """

    def __init__(
        self,
        spark: SparkSession,
        regions: Sequence[Region],
        counties: DataFrame,
        slaveholders: DataFrame,
        carried: DataFrame | None = None,
        design: Design = Design(),
        run: str | None = None,
    ):
        self.spark = spark
        inputs = [table for region in regions for table in (region.census, region.batches)]
        inputs += [counties, slaveholders, *([] if carried is None else [carried])]
        self.stage = Stage(spark, run, version_of(spark, inputs, design) if run else "")
        self.design = design
        self.regions = list(regions)
        self.counties = counties
        self.slaveholders = slaveholders
        self.carried = carried

    def _censuses(self) -> list[DataFrame]:
        return [region.census for region in self.regions]

    @cached_property
    def _sizes(self) -> list[families.Sizes]:
        """Of the families of every census."""
        return [families.family_sizes(self._person_records(census)) for census in self._censuses()]

    def _person_records(self, census: DataFrame) -> DataFrame:
        return person_records(census, self.design.private_households_only)

    def _dealt_extract(self, i: int, batches: DataFrame) -> Dealt:
        """The extract of the i-th census; all are dealt out by one key and into equally many buckets.

        Rows of one record then meet without another shuffle, whatever extracts they come from. The key is the family
        code, by which the records are gathered anyway; where a family is too large for a task, it is the record.
        """
        persons, buckets = self._person_records(self._censuses()[i]), self._buckets()
        extract = families.census_extract(persons, batches, self.stage, sizes=self._sizes[i], partitions=buckets)
        if self._dealt_by_family():
            return Dealt(extract, "famcode", buckets)
        return Dealt(extract.repartition(buckets, "personcode"), "personcode", buckets)

    def _dealt_by_family(self) -> bool:
        return all(sizes.ordinary for sizes in self._sizes)

    def _buckets(self) -> int:
        """They grow with the largest census, so that the records a task sorts do not."""
        configured = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return max(configured, *(families.partitions_for(sizes.coded) for sizes in self._sizes))

    @cached_property
    def extracts(self) -> list[DataFrame]:
        return [
            self.stage.step(f"extract_{i:02d}", lambda i=i, r=region: self._dealt_extract(i, r.batches))
            for i, region in enumerate(self.regions)
        ]

    def build_extract(self, census: DataFrame, batches: DataFrame) -> DataFrame:
        return families.census_extract(self._person_records(census), batches, self.stage)

    @cached_property
    def master(self) -> DataFrame:
        return self.stage.step("master", self._dealt_master)

    def _dealt_master(self) -> DataFrame | Dealt:
        """The stack keeps the extracts' buckets; by family code, they spare the pairing a shuffle."""
        stacked = self.build_master()
        return Dealt(stacked, "famcode", self._buckets()) if self._dealt_by_family() else stacked

    def build_master(self) -> DataFrame:
        return people.master_census(self.extracts)

    @cached_property
    def sexes(self) -> DataFrame:
        return self.stage.step("sexes", lambda: people.person_sexes(self.master))

    @cached_property
    def adults(self) -> DataFrame:
        return self.stage.step("adults", lambda: people.adult_hiks(self.master))

    @cached_property
    def children(self) -> DataFrame:
        return self.stage.step("children", lambda: people.child_hiks(self.master))

    @cached_property
    def _descent(self) -> DataFrame:
        return self.stage.step("descent", lambda: kinship.descent_links(self.master))

    @property
    def descent(self) -> DataFrame:
        return kinship.other_descent(self._descent)

    @cached_property
    def marriages(self) -> DataFrame:
        """Every edge coded '0', apart from the descent edges, so that the walk does not read it."""
        return self.stage.step("marriages", self._build_marriages)

    def _build_marriages(self) -> DataFrame:
        marriages = kinship.marriage_links(self.master, self.sexes)
        return kinship.marriages_with_zero_coded(self._descent, marriages)

    @property
    def links(self) -> DataFrame:
        """The kinship graph in its two written parts."""
        return self.descent.unionByName(self.marriages)

    @cached_property
    def residents(self) -> DataFrame:
        """The persons of the base population."""
        return self.stage.step("residents", self._build_residents)

    def _build_residents(self) -> DataFrame:
        of = self.design
        return population.resident_ids(self.master, self.counties, of.years, of.zones, of.roles)

    @cached_property
    def base(self) -> DataFrame:
        return self.stage.step("base", self.build_base)

    def build_base(self) -> DataFrame:
        return population.base_population(
            self.master, self.counties, self.slaveholders, people=self.attributes, ids=self.residents
        )

    @cached_property
    def _walked(self) -> lineage.Lineage:
        return self.build_lineage()

    @cached_property
    def lineage(self) -> lineage.Lineage:
        links = self.stage.step("lineage_links", self._build_lineage_links)
        return lineage.Lineage(links, self.stage.step("lineage_members", lambda: self._walked.members))

    def _build_lineage_links(self) -> DataFrame:
        links = self._walked.links
        return lineage.adult_links_only(links, self.adults) if self.design.adult_links_only else links

    def build_lineage(self, rounds: int | None = None) -> lineage.Lineage:
        return lineage.bounded_lineage(
            self.descent,
            self.residents,
            self.stage,
            rounds=self.design.rounds if rounds is None else rounds,
            hops=self.design.hops,
            carried=self.carried,
        )

    @cached_property
    def graph(self) -> DataFrame:
        return self.stage.step("graph", lambda: lineage.linked_families(self.marriages, self.lineage.links))

    @cached_property
    def ids(self) -> DataFrame:
        return self.stage.step("ids", lambda: population.study_ids(self.graph))

    def wanted(self) -> list[DataFrame]:
        """Tables of the persons whose attributes are wanted."""
        return [self.residents, self.ids]

    @cached_property
    def attributes(self) -> DataFrame:
        """The attributes of both populations' persons, and of few others."""
        return self.stage.step("attributes", self._build_attributes)

    def _build_attributes(self) -> DataFrame:
        stacked = reduce(DataFrame.unionByName, self.wanted()).filter(F.col("hik").isNotNull())
        ids = self.stage.step("wanted", stacked.distinct)
        return population.attributes_of(self.master, ids, ids.count())

    def build_study_population(self) -> DataFrame:
        return population.study_population(self.attributes, self.ids, self.slaveholders, self.adults)

    def write_tables(self, folder: str) -> None:
        """Replace the result tables in ``folder``, laid out by the keys they are looked up by.

        Edges are looked up by kind and source in their order, by target through Bloom filters.
        """
        extracts = [(f"extract_{i:02d}", table, ["personcode"]) for i, table in enumerate(self.extracts)]
        for name, table, order, *lookup in (
            *extracts,
            ("master", self.master, ["personcode"]),
            ("links", self.links, ["edg", "src", "tgt"], "tgt"),
            ("adults", self.adults, ["hik"]),
            ("children", self.children, ["hik"]),
            ("base_population", self.base, ["hik"]),
            ("linked_families", self.graph, ["edg", "src", "tgt"], "tgt"),
            ("study_population", self.build_study_population(), ["hik"]),
        ):
            replace_table_ordered(table, f"{folder}/{name}", order, lookup)

    def release(self) -> None:
        """Delete the staged tables; the study is used up."""
        self.stage.release()

    def __enter__(self) -> Study:
        return self

    def __exit__(self, *failure) -> None:
        self.release()


LINES_PER_FILE = 1_000_000  # a compressed file is read by one task


class FolderStudy(Study):
    """The study of the census-shaped inputs derived from one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, run: str | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.design = Design()
        self.stage = Stage(spark, run, _digest(versions(spark, sf_dir), self.design) if run else "")
        self.carried = None

    @cached_property
    def census(self) -> DataFrame:
        return self.stage.step("census", lambda: census_inputs.census(self.spark, self.sf_dir))

    @cached_property
    def census_text(self) -> str:
        """The census as a fixed-width file, in compressed parts."""
        path = self.stage.new_path("census_text")
        lines = codebook.to_fixed_width(self.census, codebook.layout_from_widths(CENSUS_WIDTHS))
        lines.write.option("maxRecordsPerFile", LINES_PER_FILE).text(path, compression="gzip")
        return path

    @cached_property
    def census_lines(self) -> str:
        """The census as a file of household and person lines."""
        path = self.stage.new_path("census_lines")
        hierarchical.to_hierarchical(self.census, census_inputs.record_types()).write.text(path)
        return path

    @property
    def persons(self) -> DataFrame:
        return person_records(self.census)

    @property
    def batches(self) -> DataFrame:
        return census_inputs.batches(self.spark, self.sf_dir)

    @cached_property
    def counties(self) -> DataFrame:
        return self.stage.step("counties", lambda: census_inputs.counties(self.census))

    def _censuses(self) -> list[DataFrame]:
        return [self.census]

    @cached_property
    def _extract_by_region(self) -> DataFrame:
        """The extract with a column ``region``, in parts by it: a regional table reads its two parts only."""
        return self.stage.step("extract", self._dealt_by_region)

    def _dealt_by_region(self) -> Dealt:
        dealt = self._dealt_extract(0, self.batches)
        rows = dealt.rows.withColumn("region", F.expr(census_inputs.REGION))
        return replace(dealt, rows=rows.withColumnRenamed(dealt.key, "dealt_by"), key="dealt_by", split_by="region")

    @staticmethod
    def _without_region(stored: DataFrame) -> DataFrame:
        """The extract's own columns. The key is stored under another name because Spark's union forgets the buckets
        of a table when a selection leaves out columns but keeps the key as it is."""
        return stored.select(*(c if c in stored.columns else F.col("dealt_by").alias(c) for c in EXTRACT_COLUMNS))

    @property
    def extract(self) -> DataFrame:
        return self._without_region(self._extract_by_region)

    @property
    def extracts(self) -> list[DataFrame]:
        return [self._without_region(part) for part in census_inputs.extracts(self._extract_by_region, "region")]

    def extract_if_made(self) -> DataFrame:
        """The stored extract where it is made already, else the step itself, for readers of few columns."""
        if "_extract_by_region" in self.__dict__:
            return self.extract
        return self.build_extract(self.census, self.batches)

    @cached_property
    def slaveholders(self) -> DataFrame:
        return self.stage.step("slaveholders", lambda: census_inputs.slaveholders(self.master))

    def attributes_if_made(self, ids: DataFrame) -> DataFrame:
        """The stored attributes where they are made already, else those of ``ids`` alone.

        The stored ones take the whole lineage, which a base population has no need of.
        """
        if "attributes" in self.__dict__:
            return self.attributes
        return population.attributes_of(self.master, ids, ids.count())

    def build_base(self) -> DataFrame:
        people = self.attributes_if_made(self.residents)
        return population.base_population(
            self.master, self.counties, self.slaveholders, people=people, ids=self.residents
        )

    def build_base_adults(self) -> DataFrame:
        people = self.attributes_if_made(self.adult_residents)
        return population.base_population_adults(
            self.master, self.counties, self.slaveholders, people=people, ids=self.adult_residents
        )

    @cached_property
    def adult_residents(self) -> DataFrame:
        """The persons of the alternative base population."""
        return self.stage.step("adult_residents", self._build_adult_residents)

    def _build_adult_residents(self) -> DataFrame:
        return population.resident_ids(self.master, self.counties, (1870, 1880), roles=people.ADULT_ROLES)

    def wanted(self) -> list[DataFrame]:
        """With the alternative base population."""
        return [*super().wanted(), self.adult_residents]


# Raised when a step's result changes, so that no run mixes tables of two versions.
STEPS_VERSION = 1


def _digest(*parts: object) -> str:
    return hashlib.md5(repr((STEPS_VERSION, *parts)).encode()).hexdigest()


def version_of(spark: SparkSession, inputs: Sequence[DataFrame], design: Design) -> str:
    """What a run's steps are made from: the inputs' files and plans, and the design."""
    parts: list[object] = []
    for table in inputs:
        paths = table.inputFiles()
        if not paths:
            raise ValueError("a study with a run name needs stored tables as inputs")
        plan = table._jdf.queryExecution().optimizedPlan().canonicalized().toString()
        parts.append((plan, [file for path in sorted(paths) for file in files.describe(spark, path)]))
    return _digest(parts, design)


_studies: dict[tuple[str, str], tuple[list, FolderStudy]] = {}


def versions(spark: SparkSession, sf_dir: str) -> list[tuple[str, int, int]]:
    """What tells whether the input tables are still those a study was made from."""
    return [file for table in ("orders", "customer") for file in files.describe(spark, f"{sf_dir}/{table}.parquet")]


def study_of(spark: SparkSession, sf_dir: str) -> FolderStudy:
    """The study of this folder in this application; its written tables are shared by the queries.

    If the folder's tables have changed since, the old study's tables go and a new one is made.
    """
    sf_dir = sf_dir.rstrip("/")
    key, now = (spark.sparkContext.applicationId, sf_dir), versions(spark, sf_dir)
    made, study = _studies.get(key, (None, None))
    if made != now:
        if study is not None:
            study.release()
        _studies[key] = now, (study := FolderStudy(spark, sf_dir))
    return study
