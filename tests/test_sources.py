"""Codebooks, fixed-width files, CSV configuration and whole-table writers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kinspark.sources import codebook, hierarchical, tables
from kinspark.sources.schemas import CENSUS_WIDTHS
from kinspark.sources.zones import zone_dimension, zone_rows

from tests.conftest import family

CODEBOOK = """ Data dictionary
  Variable            Columns   Len
  YEAR      H   1-4    4
  SERIAL    H   5-12   8
  PERNUM    P   13-16  4
  SEX       P   17     1
"""


def test_codebook_and_fixed_width_file(spark, tmp_path):
    (tmp_path / "x.cbk").write_text(CODEBOOK)
    (tmp_path / "x.dat").write_text("18700000000100011\n1870000000010002 \n1870\n")
    parsed = codebook.parse_codebook(spark.read.text(str(tmp_path / "x.cbk")))
    assert {tuple(r) for r in parsed.collect()} == {
        ("YEAR", "H", "1-4", "4"), ("SERIAL", "H", "5-12", "8"), ("PERNUM", "P", "13-16", "4"),
        ("SEX", "P", "17", "1"),
    }
    layout = codebook.layout_from_codebook(parsed)
    rows = codebook.read_fixed_width(spark, str(tmp_path / "x.dat"), layout).collect()
    assert [tuple(r) for r in rows] == [
        ("1870", "00000001", "0001", "1"), ("1870", "00000001", "0002", " "), ("1870", "", "", ""),
    ]


def test_import_batch(spark, tmp_path):
    (tmp_path / "x.cbk").write_text(CODEBOOK)
    (tmp_path / "x.dat").write_text("18700000000100011\n")
    row = spark.createDataFrame(
        [("D:/elsewhere", "x.cbk", "x.dat", codebook.CODEBOOK_PATTERN)],
        "path string, cbkfilename string, datafile string, pattern string",
    ).first()
    read = codebook.read_batch(spark, row, folder=str(tmp_path))
    assert read.columns == ["year", "serial", "pernum", "sex"]
    assert tuple(read.first()) == ("1870", "00000001", "0001", "1")


def layout_of(spark, *lines):
    text = spark.createDataFrame([(line,) for line in lines], "value string")
    return codebook.layout_from_codebook(codebook.parse_codebook(text))


@pytest.mark.parametrize(
    "lines",
    [
        ("  A   P   1-4   3",), ("  A   P   4-1   2",), ("  A   P   1-2,,4   3",), ("  A   H   1-4   4", "  B   P   1-4   4"),
        ("  RECTYPE   H   1   1", "  RECTYPE   P   2   1"),
        ("  RECTYPE   H   1   1", "  RECTYPE   P   1   1", "  A   H   2   1", "  A   P   2   1"),
        ("  RECTYPE   H   1   1", "  RECTYPE   P   1   1", "  A   P   2-3   2", "  B   P   3   1"),
        ("  RECTYPE   H   1   1", "  A   P   1   1"),
    ],
)
def test_unusable_codebook_lines_are_refused(spark, lines):
    with pytest.raises(ValueError):
        layout_of(spark, *lines)


def test_variable_of_two_spans(spark):
    layout = layout_of(spark, "  A   P   1-2,7-8   4", "  B   H   3-6   4")
    lines = spark.createDataFrame([("12345678",), ("123",)], "value string")
    assert [tuple(r) for r in codebook.slice_fixed_width(lines, layout).collect()] == [("1278", "3456"), ("12", "3")]


def test_codebook_text_describes_its_layout(spark):
    layout = codebook.layout_from_widths(CENSUS_WIDTHS)
    assert layout_of(spark, *codebook.codebook_text(layout)) == layout


def test_too_long_a_value_is_an_error(spark):
    df = spark.createDataFrame([("123",), ("12345",)], "a string")
    layout = codebook.layout_from_widths({"a": 3})
    assert codebook.to_fixed_width(df.limit(1), layout).first().value == "123"
    with pytest.raises(Exception, match="a is longer than 3"):
        codebook.to_fixed_width(df, layout).collect()


def test_fixed_width_round_trip(spark, census, tmp_path):
    rows = family("00000001", children=2, slavenum=None)
    raw = census(*rows)
    layout = codebook.layout_from_widths(CENSUS_WIDTHS)
    codebook.to_fixed_width(raw, layout).write.text(str(tmp_path / "text"))
    back = codebook.read_fixed_width(spark, str(tmp_path / "text"), layout)
    expected = raw.select(
        *(F.rpad(F.coalesce(F.col(c), F.lit("")), w, " ").alias(c) for c, w in CENSUS_WIDTHS.items())
    )
    assert sorted(back.collect()) == sorted(expected.collect())


HIERARCHY = """ Record Type: household, then persons
  RECTYPE   H   1     1
  YEAR      H   2-5   4
  PLACE     H   6-9   4
  RECTYPE   P   1     1
  PERNUM    P   2-3   2
  NAME      P   4-8   5
"""


def hierarchical_file(households):
    """Lines of both types, and the rows they stand for."""
    lines, rows = [], []
    for i in range(households):
        place = ["Ohio", "Märk", "    "][i % 3]
        lines.append(f"H{1850 + i % 100}{place}")
        for k in range([2, 0, 7, 1][i % 4]):
            lines.append(f"P{k:02d}n{i:04d}")
            rows.append((str(1850 + i % 100), place, f"{k:02d}", f"n{i:04d}"))
    return lines, rows


@pytest.fixture
def small_splits(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(name) for name in names]
    for name, value in zip(names, ["90", "0"]):
        spark.conf.set(name, value)
    yield
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def batch_of(spark):
    row = [("D:/elsewhere", "x.cbk", "x.dat", codebook.CODEBOOK_PATTERN)]
    return spark.createDataFrame(row, "path string, cbkfilename string, datafile string, pattern string").first()


def test_record_types_across_splits(spark, stage, tmp_path, small_splits):
    lines, rows = hierarchical_file(300)
    (tmp_path / "x.cbk").write_text(HIERARCHY)
    (tmp_path / "x.dat").write_text("\n".join([lines[0], "", *lines[1:]]) + "\n", encoding="utf-8")
    text = spark.read.text(str(tmp_path / "x.dat"))
    firsts = text.groupBy("_metadata.file_block_start").agg(F.first("value").alias("v"))
    assert firsts.filter("v LIKE 'P%'").count() > 10 and firsts.filter("v LIKE 'H%'").count() > 10
    read = codebook.read_batch(spark, batch_of(spark), str(tmp_path), stage)
    assert read.columns == ["year", "place", "pernum", "name"]
    assert sorted(map(tuple, read.collect())) == sorted(rows)


def test_record_types_of_a_split_without_households(spark, stage, tmp_path, small_splits):
    """One household over many splits, and one file behind another."""
    layout = layout_of(spark, *HIERARCHY.splitlines())
    for name, place in (("a", "Ohio"), ("b", "Utah")):
        (tmp_path / name).write_text("\n".join([f"H1850{place}"] + [f"P01n{i:04d}" for i in range(200)]) + "\n")
    read = hierarchical.read_hierarchical(spark, str(tmp_path), layout, stage)
    assert {tuple(r) for r in read.groupBy("place").count().collect()} == {("Ohio", 200), ("Utah", 200)}


@pytest.mark.parametrize(("text", "message"), [("P01n0001\nH1850Ohio\n", "before the first household"), ("H1850Ohio\nX01\n", "neither a household")])
def test_lines_without_a_household(spark, stage, tmp_path, text, message):
    (tmp_path / "x.dat").write_text(text)
    layout = layout_of(spark, *HIERARCHY.splitlines())
    with pytest.raises(Exception, match=message):
        hierarchical.read_hierarchical(spark, str(tmp_path / "x.dat"), layout, stage).collect()


def test_no_lines(spark, stage, tmp_path):
    (tmp_path / "x.dat").write_text("")
    layout = layout_of(spark, *HIERARCHY.splitlines())
    assert hierarchical.read_hierarchical(spark, str(tmp_path / "x.dat"), layout, stage).count() == 0


def test_record_types_round_trip(spark, census, stage, tmp_path, small_splits):
    layout = codebook.record_types_from_widths({"year": 4, "serial": 8}, {"pernum": 4, "hik": 21})
    assert layout_of(spark, *codebook.codebook_text(layout)) == layout
    raw = census(*(r for i in range(50) for r in family(f"{i:08d}", children=i % 4)), {"serial": None, "hik": None})
    hierarchical.to_hierarchical(raw, layout).write.text(str(tmp_path / "text"))
    back = hierarchical.read_hierarchical(spark, str(tmp_path / "text"), layout, stage)
    padded = [F.rpad(F.coalesce(F.col(c), F.lit("")), CENSUS_WIDTHS[c], " ").alias(c) for c in back.columns]
    assert sorted(back.collect()) == sorted(raw.select(*padded).collect())
    with pytest.raises(Exception, match="year is longer than 4"):
        hierarchical.to_hierarchical(census({"year": "18700"}), layout).collect()


def test_batches_with_quoted_commas_and_backslashes(spark, tmp_path):
    pattern = r"\s{2}(\w+)\s+([HP])\s+([0-9,-]+)\s+(\d+)"
    (tmp_path / "b.csv").write_text(
        "batch,desc,path,cbkfilename,cbkname,datafile,cendata,cbkcol,pattern\n"
        rf'9,east,D:\x\y,a.cbk,cbk9,a.dat,cen9,"variable,basis,range,length","{pattern}"' + "\n"
    )
    row = tables.read_batches(spark, str(tmp_path / "b.csv")).first()
    assert (row.batch, row.path, row.cbkcol) == (9, r"D:\x\y", "variable,basis,range,length")
    assert row.pattern == pattern == codebook.CODEBOOK_PATTERN


def test_zones(spark, tmp_path):
    text = "zone,type,origin,region,axis,region\n" + "\n".join(",".join(r) for r in zone_rows()) + "\n"
    (tmp_path / "z.csv").write_text(text)
    read = tables.read_zones(spark, str(tmp_path / "z.csv"))
    assert read.columns == ["zone", "type", "origin", "region_code", "axis", "region_name"]
    assert sorted(read.collect()) == sorted(zone_dimension(spark).collect())
    assert read.count() == 37


def test_replace_table(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(spark.range(10), path)
    tables.replace_table(spark.range(3), path)
    assert tables.read_table(spark, path).count() == 3


def test_a_failed_replacement_keeps_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(spark.range(10), path)
    half = spark.range(0, 1000, 1, 8).selectExpr("if(id < 900, id, raise_error('stopped')) as id")
    with pytest.raises(Exception, match="stopped"):
        tables.replace_table(half, path)
    assert tables.read_table(spark, path).count() == 10
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_a_table_made_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(spark.range(10), path)
    for n in (9, 8):
        tables.replace_table(tables.read_table(spark, path).filter("id > 0").selectExpr("id - 1 as id"), path)
        assert sorted(r.id for r in tables.read_table(spark, path).collect()) == list(range(n))


def test_a_replacement_that_stopped_between_its_renames(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    tables.replace_table(spark.range(10), path)
    rename = tables.files.rename
    with monkeypatch.context() as patch:
        patch.setattr(tables.files, "rename", lambda s, old, new: rename(s, old, new) if ".new" not in old else 1 / 0)
        with pytest.raises(ZeroDivisionError):
            tables.replace_table(spark.range(3), path)
    assert tables.read_table(spark, path).count() == 10
    (tmp_path / "t").rename(tmp_path / "t.old")  # the driver was lost
    assert tables.read_table(spark, path).count() == 10
    (tmp_path / "t").rename(tmp_path / "t.old")
    tables.replace_table(spark.range(3), path)
    assert tables.read_table(spark, path).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["t"]


def rows_scanned(df) -> int:
    """Rows that the Parquet scan of a plan hands on: those of the row groups it has to read."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    plan = leaves.apply(0)
    plan = plan.executedPlan().collectLeaves().apply(0) if "AdaptiveSparkPlan" in plan.nodeName() else plan
    return plan.metrics().apply("numOutputRows").value()


def test_lookups_read_few_row_groups(spark, tmp_path):
    """100 row groups of some 2,000 edges, in the order of sources; targets are scattered."""
    edges = spark.range(200_000).selectExpr(
        "lpad(id, 8, '0') src", "md5(cast(id as string)) tgt", "cast(id % 3 as string) edg"
    )
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.setInt("parquet.block.row.count.limit", 2_000)
    try:
        for name, lookup in (("plain", []), ("edges", ["tgt"])):
            tables.replace_table_ordered(edges, str(tmp_path / name), ["edg", "src", "tgt"], lookup)
    finally:
        conf.unset("parquet.block.row.count.limit")
    wanted = {name: f"{name} = '{edges.first()[name]}'" for name in ("src", "tgt")}
    read = {name: tables.read_table(spark, str(tmp_path / name)) for name in ("plain", "edges")}
    scanned = {(name, key): rows_scanned(table.filter(test)) for name, table in read.items() for key, test in wanted.items()}
    assert scanned["plain", "tgt"] == 200_000
    assert scanned["edges", "tgt"] <= 8_000 and scanned["edges", "src"] <= 8_000
    assert rows_scanned(read["edges"].filter("edg = '1'")) <= 75_000
    assert read["edges"].filter(wanted["tgt"]).count() == 1


def test_replace_table_ordered(spark, tmp_path):
    path = str(tmp_path / "t")
    shuffled = spark.range(10_000).withColumn("k", F.hash("id")).repartition(7)
    tables.replace_table_ordered(shuffled, path, ["k"])
    back = spark.read.parquet(path).withColumn("f", F.input_file_name())
    spans = back.groupBy("f").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("lo").collect()
    assert all(a.hi <= b.lo for a, b in zip(spans, spans[1:]))


def test_saved_tables_stay_as_written(spark, stage):
    first = stage.save("t", spark.range(3))
    second = stage.save("t", spark.range(5))
    assert (first.count(), second.count()) == (3, 5)
