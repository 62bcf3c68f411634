"""Census-shaped inputs derived from the ``orders`` and ``customer`` tables.

Each order becomes one household of up to six persons; the order key fixes its generation, its
dynasty and one of 37 household patterns, and the person keys tie households of neighbouring
generations into a pedigree mesh. The expressions are plain SQL so that Spark and the check
database evaluate the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.sources.codebook import CODEBOOK_PATTERN, RecordTypes, record_types_from_widths
from kinspark.sources.schemas import CENSUS_WIDTHS

# Household serials are the order key in base 36, eight digits: one to one up to 36^8, an error beyond.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SERIAL = "concat({})".format(
    ", ".join(
        f"substr('{DIGITS}', 1 + cast(cast(floor(o_orderkey / {36**k}) as bigint) % 36 as int), 1)"
        for k in reversed(range(8))
    )
)
SERIAL = f"case when o_orderkey between 0 and {36**8 - 1} then {SERIAL}" \
    " else cast(cast(concat('no serial for order ', cast(o_orderkey as string)) as bigint) as string) end"

HOUSEHOLD = {
    "h": "o_orderkey",
    "sc": SERIAL,
    "g": "o_orderkey % 8",
    "f": "cast(floor(o_orderkey / 8) as bigint)",
    "k": "o_orderkey % 37",
    "nk": "c_nationkey",
    "ck": "o_custkey",
    "yr": "case when o_orderkey % 8 < 4 then 1850 + 10 * (o_orderkey % 8)"
    " else 1860 + 10 * (o_orderkey % 8) end",
}

KEPT_MEMBER = """case k when 0 then i in (2, 3, 4, 5) when 1 then i in (1, 3, 4, 5) when 2 then i <= 2
 when 3 then i = 1 when 4 then true when 7 then true when 9 then i in (3, 4, 5) else i <= 5 end"""

AGE = "case when i in (1, 2, 6) then 40 else 10 end"

PERSON = {
    "year": "cast(yr as string)",
    "serial": "sc",
    "pernum": "case when k = 7 and i = 6 then '0102' else lpad(cast(i as string), 4, '0') end",
    "sploc": "case when i = 1 then case when k in (1, 3) then '00' else '02' end"
    " when i = 2 then case when k = 0 then '00' else '01' end"
    " when k = 4 and i = 3 then '06' when k = 4 and i = 6 then '03'"
    " when k = 7 and i = 6 then '01' else '00' end",
    "momloc": "case when i in (3, 4, 5) and k <> 1 then '02' else '00' end",
    "poploc": "case when i in (3, 4, 5) and k <> 0 then '01' else '00' end",
    "sex": "case when k = 5 and i = 1 then '9' when k = 10 and i = 3 then '2'"
    " when i in (1, 3) then '1' when i in (2, 4, 6) then '2' else cast(1 + h % 2 as string) end",
    "birthyr": "case when k = 8 and i = 1 then '9999' when k = 8 and i = 2 then null"
    f" else cast(yr - ({AGE}) as string) end",
    "age": f"lpad(cast({AGE} as string), 3, '0')",
    "race": "cast(1 + ck % 3 as string)",
    "bpl": "lpad(cast(nk as string), 3, '0')",
    "farm": "cast(1 + ck % 2 as string)",
    "nativity": "case when k = 6 then ' ' else cast(1 + ck % 5 as string) end",
    "labforce": "cast(case when i in (1, 2, 6) then 2 else 1 + h % 2 end as string)",
    "marst": "case when k = 6 then ' ' when i in (1, 2, 6) then '1' else '6' end",
    "multgen": "case when k = 6 then ' ' else '2' end",
    "steppop": "case when k = 10 and i > 2 then '1' else '0' end",
    "stepmom": "case when k = 10 and i in (3, 4) then '1' else '0' end",
    "relate": "case when i = 1 then '01' when i = 2 then '02' else '03' end",
    "histid": "concat('X', sc, '-', cast(i as string))",
    "gq": "case when h % 13 = 12 then '4' else cast(1 + h % 2 as string) end",
    "hhtype": "cast(1 + f % 4 as string)",
    "famunit": "lpad(cast(case when i = 6 then 2 else 1 end as string), 2, '0')",
    "stateicp": "lpad(cast(nk as string), 2, '0')",
    "countyicp": "lpad(cast(ck % 10 * 10 as string), 4, '0')",
    "enumdist": "case when k = 6 then '    ' else lpad(cast(ck % 100 as string), 4, '0') end",
    "hik": "case when k = 6 and i = 5 then repeat(' ', 21) else concat('P',"
    " lpad(cast(case when i = 2 and g > 0 then f + 1 else f end as string), 18, '0'),"
    " cast(case when i <= 2 and g > 0 then g - 1 else g end as string),"
    " cast(case when i = 1 and g > 0 then 3 when i = 2 and g > 0 then 4 else i end as string)) end",
    "slavenum": "case when k = 8 then lpad(cast(h % 30 as string), 3, '0')"
    " when k = 6 then null else '   ' end",
    "slaveown": "case when k = 8 then lpad(cast(h % 7 as string), 3, '0') else '   ' end",
}

# Variables that are the same for all persons of a household.
OF_HOUSEHOLD = {
    "year", "serial", "farm", "gq", "hhtype", "stateicp", "countyicp", "enumdist", "slavenum", "slaveown",
}

ZONE_OF_STATE = (
    "case stateicp when '00' then 'KB' when '01' then 'KC' when '02' then 'KE'"
    " when '03' then 'KL' when '04' then 'KN' else 'OH' end"
)

# Import batches, one per residue of the order keys.
BATCH = {
    "batch": "cast(13 + b as int)",
    "desc": "concat('region ', cast(b as string))",
    "path": "concat('batch', cast(13 + b as string))",
    "cbkfilename": "concat('extract_', cast(13 + b as string), '.cbk')",
    "cbkname": "concat('cbk', cast(13 + b as string))",
    "datafile": "concat('extract_', cast(13 + b as string), '.dat')",
    "cendata": "concat('cen', cast(13 + b as string))",
    "cbkcol": "'variable,basis,range,length'",
    "pattern": f"r'{CODEBOOK_PATTERN}'",
}

# Codebook text: per order a variable line, a heading, or a line of another shape.
CODEBOOK_LINE = """case o_orderkey % 5
 when 0 then concat('  V', cast(o_orderkey as string), '      H   ', cast(1 + o_custkey % 90 as string), '-',
  cast(4 + o_custkey % 90 as string), '    4')
 when 1 then concat('  P_', cast(o_orderkey as string), '  P  ', cast(1 + o_custkey % 700 as string), '   1')
 when 2 then concat(' Variable       Columns        Len ', o_orderpriority)
 when 3 then concat('  ', o_orderstatus, cast(o_custkey as string), '   X   ', cast(o_orderkey as string), '   2')
 else concat('  L', cast(o_orderkey as string), ' P 1-2,7-', cast(8 + o_custkey % 50 as string), ' 12') end"""

EXTRACT_COUNT = 11
# A total rule: every record has a region.
REGION = f"coalesce(abs(try_cast(left(countycode, 2) as int)) % {EXTRACT_COUNT}, 0)"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw census of all orders: 29 text columns."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    households = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    households = households.selectExpr(*(f"{sql} as {name}" for name, sql in HOUSEHOLD.items()))
    members = households.withColumn("i", F.explode(F.array(*(F.lit(i) for i in range(1, 7)))))
    members = members.filter(KEPT_MEMBER)
    return members.selectExpr(*(f"{PERSON[name]} as {name}" for name in CENSUS_WIDTHS))


def record_types() -> RecordTypes:
    """The layout of a census file of household and person lines."""
    of = [{c: w for c, w in CENSUS_WIDTHS.items() if (c in OF_HOUSEHOLD) == own} for own in (True, False)]
    return record_types_from_widths(*of)


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    residues = read(spark, sf_dir, "orders").selectExpr("o_orderkey % 3 as b").distinct()
    return residues.selectExpr(*(f"{sql} as `{name}`" for name, sql in BATCH.items()))


def counties(census_table: DataFrame) -> DataFrame:
    """County code to zone."""
    pairs = census_table.selectExpr("concat(stateicp, countyicp) as countycode", f"{ZONE_OF_STATE} as zone")
    return pairs.distinct()


def extracts(extract: DataFrame, region: str = REGION) -> list[DataFrame]:
    """Eleven regional tables by state; every state lies in two of them, so the stack has copies.

    ``region`` names a column that holds the region, where there is one.
    """
    return [extract.filter(in_region(j, region)) for j in range(EXTRACT_COUNT)]


def in_region(j: int, region: str = REGION) -> str:
    """Whether a record belongs to the j-th regional table. States that are no number count as state 0."""
    return f"{region} in ({j}, {(j + 1) % EXTRACT_COUNT})"


def slaveholders(master: DataFrame) -> DataFrame:
    """The highest slaveholder category on record per person."""
    held = master.filter(F.col("slvhcat") != "0")
    return held.groupBy("hik").agg(F.max("slvhcat").alias("slvhcat"))


def codebook_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(f"{CODEBOOK_LINE} as value")
