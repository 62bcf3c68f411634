"""Column layouts of the tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Raw census person: text column -> width in the fixed-width file, in file order.
CENSUS_WIDTHS = {
    "year": 4, "serial": 8, "pernum": 4,
    "sploc": 2, "momloc": 2, "poploc": 2,
    "sex": 1, "birthyr": 4, "age": 3, "race": 1, "bpl": 3, "farm": 1,
    "nativity": 1, "labforce": 1, "marst": 1, "multgen": 1, "steppop": 1, "stepmom": 1,
    "relate": 2, "histid": 12, "gq": 1, "hhtype": 1, "famunit": 2,
    "stateicp": 2, "countyicp": 4, "enumdist": 4, "hik": 21, "slavenum": 3, "slaveown": 3,
}

CENSUS = _strings(*CENSUS_WIDTHS)

EXTRACT_COLUMNS = [
    "personcode", "cenyear", "birthyr", "sex", "race", "age", "marst", "labforce", "nativity",
    "bpl", "famcode", "rolecode", "famhead", "famseq", "stepfam", "parent", "couple", "unmarried",
    "child", "minor", "hhtype", "famunit", "hhead", "relate", "multgen", "farm", "slavenum",
    "slvhcat", "countycode", "enumdist", "hiklink", "hik", "batch",
]

EDGE_COLUMNS = ["src", "tgt", "edg", "sxs", "sxt", "weight"]
LINEAGE_COLUMNS = ["src", "tgt", "edg", "weight", "sxs", "sxt"]

BATCHES = T.StructType(
    [T.StructField("batch", T.IntegerType())]
    + _strings(
        "desc", "path", "cbkfilename", "cbkname", "datafile", "cendata", "cbkcol", "pattern"
    ).fields
)

# The file's header says "region" twice; the columns get distinct names here.
ZONES = _strings("zone", "type", "origin", "region_code", "axis", "region_name")
