from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from kinspark.session import local_session  # noqa: E402
from kinspark.sources import schemas  # noqa: E402
from kinspark.sources.stage import Stage  # noqa: E402

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=8, shuffle_partitions=3)


@pytest.fixture
def stage(spark):
    made = Stage(spark)
    yield made
    made.release()


@pytest.fixture(scope="session")
def sf_dir():
    return f"{TESTDATA}/sf0.001"


PERSON = {
    "year": "1870", "serial": "00000001", "pernum": "0001", "sploc": "00", "momloc": "00",
    "poploc": "00", "sex": "1", "birthyr": "1830", "age": "040", "race": "1", "bpl": "001",
    "farm": "1", "nativity": "1", "labforce": "2", "marst": "1", "multgen": "1", "steppop": "0",
    "stepmom": "0", "relate": "01", "histid": "X", "gq": "1", "hhtype": "1", "famunit": "01",
    "stateicp": "51", "countyicp": "0010", "enumdist": "0001", "hik": "P00000000000000000001",
    "slavenum": "   ", "slaveown": "   ",
}


@pytest.fixture
def census(spark):
    """Raw census rows from overrides of one ordinary person."""

    def build(*overrides: dict):
        rows = [{**PERSON, **o} for o in overrides]
        return spark.createDataFrame(
            [tuple(r[c] for c in schemas.CENSUS_WIDTHS) for r in rows], schemas.CENSUS
        )

    return build


@pytest.fixture
def batches(spark):
    def build(*numbers):
        return spark.createDataFrame([(n,) for n in numbers], "batch int")

    return build


RECORD_SCHEMA = (
    "hik string, famcode string, rolecode string, sex string, cenyear smallint, personcode string,"
    " race string, birthyr smallint, bpl string, farm string, countycode string, slvhcat string"
)
RECORD = {
    "hik": "a", "famcode": "F1", "rolecode": "1", "sex": "1", "cenyear": 1870, "personcode": "p1",
    "race": "1", "birthyr": 1840, "bpl": "001", "farm": "1", "countycode": "510010", "slvhcat": "0",
}


@pytest.fixture
def records(spark):
    """Stacked person records (the columns the later steps read) from overrides."""

    def build(*overrides: dict):
        rows = [{**RECORD, **o} for o in overrides]
        return spark.createDataFrame([tuple(r[c] for c in RECORD) for r in rows], RECORD_SCHEMA)

    return build


def family(serial: str, children: int = 1, **common) -> list[dict]:
    """A married couple with children."""
    base = {"serial": serial, **common}
    man = {**base, "pernum": "0001", "sploc": "02", "sex": "1"}
    woman = {**base, "pernum": "0002", "sploc": "01", "sex": "2", "relate": "02"}
    kids = [
        {
            **base, "pernum": f"{i + 3:04d}", "poploc": "01", "momloc": "02", "sex": "1",
            "birthyr": "1860", "age": "010", "relate": "03", "labforce": "1",
        }
        for i in range(children)
    ]
    return [man, woman, *kids]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
