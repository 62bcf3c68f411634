"""The named queries: one per operator, each over the whole tables of an input folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.operators import families, kinship, lineage, people, population
from kinspark.operators.person_records import PASSED_THROUGH, person_records
from kinspark.plans import census_inputs
from kinspark.plans.study import FolderStudy, study_of
from kinspark.sources import codebook, hierarchical, tables
from kinspark.sources.schemas import CENSUS_WIDTHS
from kinspark.sources.zones import zone_dimension

Query = Callable[[SparkSession, str], DataFrame]


def _members(study: FolderStudy) -> DataFrame:
    return families.family_members(families.with_family(study.persons, study.stage))


def _family_counts(study: FolderStudy) -> DataFrame:
    counts = families.family_counts(study.persons)
    valid = families.is_valid(F.col("adults"), F.col("children"))
    return counts.withColumn("valid", F.coalesce(valid, F.lit(False)))


def _batch_latest(study: FolderStudy) -> DataFrame:
    """The batches as the configuration file has them, read from it."""
    path = study.stage.new_path("batches")
    tables.write_batches(study.batches, path)
    return families.latest_batch(tables.read_batches(study.spark, path))


def _zone_dim(study: FolderStudy) -> DataFrame:
    """The zones of the counties, from a zone file."""
    path = study.stage.new_path("zones")
    zone_dimension(study.spark).coalesce(1).write.csv(path, header=True)
    return study.counties.join(F.broadcast(tables.read_zones(study.spark, path)), "zone")


def _fixed_width_load(study: FolderStudy) -> DataFrame:
    return codebook.read_fixed_width(study.spark, study.census_text, codebook.layout_from_widths(CENSUS_WIDTHS))


def _codebook_layout(study: FolderStudy, layout) -> list[codebook.Field] | codebook.RecordTypes:
    """The layout by way of codebook text that describes it."""
    lines = [(line,) for line in codebook.codebook_text(layout)]
    text = study.stage.save("codebook", study.spark.createDataFrame(lines, "value string"))
    return codebook.layout_from_codebook(codebook.parse_codebook(text))


def _codebook_load(study: FolderStudy) -> DataFrame:
    """The same file, cut by the codebook text that describes it."""
    layout = _codebook_layout(study, codebook.layout_from_widths(CENSUS_WIDTHS))
    return codebook.read_fixed_width(study.spark, study.census_text, layout)


def _hierarchical_load(study: FolderStudy) -> DataFrame:
    """The same census from household and person lines."""
    layout = _codebook_layout(study, census_inputs.record_types())
    read = hierarchical.read_hierarchical(study.spark, study.census_lines, layout, study.stage)
    return read.select(*CENSUS_WIDTHS)


def _walk(study: FolderStudy, direction: str, hops: int) -> DataFrame:
    return lineage.walk_edges(study.descent, study.residents, direction, hops, study.stage)


QUERIES: dict[str, Callable[[FolderStudy], DataFrame]] = {
    "census_famcode": lambda s: s.persons.select("personcode", "famcode", "rolecode"),
    "census_person": lambda s: s.persons.select(
        "personcode", "household", "cenyear", "birthyr", "age", *PASSED_THROUGH,
        "nativity", "marst", "multgen", "hik", "hiklink", "countycode",
    ),
    "census_flags": lambda s: s.persons.select(
        "personcode", "hhead", "unmarried", "child", "unmc", "minor"
    ),
    "census_slaveholding": lambda s: s.persons.select("personcode", "slavenum", "slaveown", "slvhcat"),
    "family_counts": _family_counts,
    "family_members": lambda s: _members(s).select(
        "personcode", "famcode", "rolecode", "famhead", "parent", "couple", "stepfam",
        "famadults", "famchildren",
    ),
    "family_sequence": lambda s: families.with_family(s.persons, s.stage).select(
        "famcode", "famseq", "personcode", "rolecode", "birthyr"
    ),
    "family_number": lambda s: families.family_numbers(s.extract_if_made()),
    "census_extract": lambda s: s.build_extract(s.census, s.batches),
    "family_members_wide": lambda s: families.census_extract_wide(s.persons, s.batches, s.stage),
    "census_extract_private_hh": lambda s: families.census_extract(
        person_records(s.census, private_households_only=True), s.batches, s.stage
    ),
    "batch_latest": _batch_latest,
    "zone_dim": _zone_dim,
    "codebook_parse": lambda s: codebook.parse_codebook(census_inputs.codebook_lines(s.spark, s.sf_dir)),
    "fixed_width_load": _fixed_width_load,
    "codebook_load": _codebook_load,
    "hierarchical_load": _hierarchical_load,
    "distinct_on": lambda s: people.person_attributes(s.master),
    "unique_persons": lambda s: people.unique_persons(s.master),
    "adult_hiks": lambda s: people.adult_hiks(s.master),
    "child_hiks": lambda s: people.child_hiks(s.master),
    "master_census": FolderStudy.build_master,
    "parent_child_pairs": lambda s: kinship.parent_child_pairs(s.master),
    "descent_links": lambda s: kinship.descent_links(s.master),
    "marriage_links": lambda s: kinship.marriage_links(s.master, s.sexes),
    "kinship_links": lambda s: kinship.kinship_links(s.master, s.sexes),
    "base_population": FolderStudy.build_base,
    "base_population_adults": FolderStudy.build_base_adults,
    "lineage_hop_up": lambda s: _walk(s, lineage.UP, 1),
    "lineage_hop_down": lambda s: _walk(s, lineage.DOWN, 1),
    "ancestors_3": lambda s: _walk(s, lineage.UP, 3),
    "descendants_3": lambda s: _walk(s, lineage.DOWN, 3),
    "lineage_round_1": lambda s: s.build_lineage(rounds=1).links,
    "lineage_links": lambda s: s.build_lineage().links,
    "lineage_members": lambda s: s.build_lineage().members,
    "lineage_marriages": lambda s: lineage.lineage_marriages(s.marriages, s.lineage.links),
    "lineage_adult_only": lambda s: lineage.adult_links_only(s.lineage.links, s.adults),
    "linked_families": lambda s: lineage.linked_families(s.marriages, s.lineage.links),
    "study_ids": lambda s: population.study_ids(s.graph),
    "study_population": FolderStudy.build_study_population,
}


def queries() -> dict[str, Query]:
    def bind(build: Callable[[FolderStudy], DataFrame]) -> Query:
        return lambda spark, sf_dir: build(study_of(spark, sf_dir))

    return {name: bind(build) for name, build in QUERIES.items()}
