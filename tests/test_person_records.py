"""Row-wise derivation: codes, three-valued flags, blanks and counts."""

from __future__ import annotations

import pytest

from kinspark.operators.person_records import person_records

from tests.conftest import plan_of


def one(census, **override):
    return person_records(census(override)).first()


@pytest.mark.parametrize(
    "override, famcode, role",
    [
        ({"sploc": "02", "sex": "1"}, "1870000000010102", "1"),
        ({"sploc": "01", "sex": "2", "pernum": "0002"}, "1870000000010102", "2"),
        ({"poploc": "01", "momloc": "02", "pernum": "0003"}, "1870000000010102", "3"),
        ({"poploc": "00", "momloc": "02", "pernum": "0003"}, "1870000000010002", "3"),
        ({"sex": "1"}, "1870000000010100", "1"),
        ({"sex": "2"}, "1870000000010001", "2"),
        ({"sex": "9"}, None, "0"),
        ({"sex": "9", "sploc": "02"}, None, "0"),
        # a married child founds its own family
        ({"sploc": "06", "poploc": "01", "momloc": "02", "pernum": "0003"}, "1870000000010306", "1"),
        # unknown pointers
        ({"sploc": None}, None, "0"),
        ({"momloc": None, "poploc": "01"}, None, "3"),
        ({"momloc": None, "poploc": "00"}, None, "0"),
        ({"sploc": "02", "momloc": None}, "1870000000010102", "1"),
        ({"pernum": "0102"}, "1870000000010200", "1"),
        ({"pernum": None}, None, "1"),
    ],
)
def test_family_and_role_codes(census, override, famcode, role):
    row = one(census, **override)
    assert (row.famcode, row.rolecode) == (famcode, role)


def test_unknown_conditions_are_false(census):
    row = one(census, sploc=None, momloc=None, labforce=None, relate=None, age="010")
    assert (row.unmarried, row.child, row.unmc, row.minor, row.hhead) == (False,) * 5
    row = one(census, momloc=None, poploc="01", age="010", labforce="1")
    assert (row.child, row.unmc, row.minor) == (True, True, True)
    assert one(census, age="010", labforce=None).minor is False
    assert one(census, age="018", labforce="1").minor is False


@pytest.mark.parametrize("birthyr, expected", [("9999", 1830), (None, 1830), ("1835", 1835)])
def test_birth_year(census, birthyr, expected):
    assert one(census, birthyr=birthyr).birthyr == expected


@pytest.mark.parametrize(
    "hik, key, linked",
    [
        (" " * 4, " " * 4, True),
        (" " * 5, None, False),
        (" " * 21, None, False),
        (None, None, False),
        ("P1", "P1", True),
    ],
)
def test_blank_keys(census, hik, key, linked):
    row = one(census, hik=hik)
    assert (row.hik, row.hiklink) == (key, linked)


def test_one_blank_marks_short_codes_missing(census):
    row = one(census, nativity=" ", marst=" ", multgen=" ")
    assert (row.nativity, row.marst, row.multgen) == (None, None, None)


@pytest.mark.parametrize(
    "text, number, category",
    [
        ("   ", 0, "0"), ("", 0, "0"), (None, 0, "0"), ("000", 0, "0"), ("001", 1, "1"), ("005", 5, "1"),
        ("006", 6, "2"), ("019", 19, "2"), ("020", 20, "3"), (" 12", 0, "0"),
    ],
)
def test_slaveholding(census, text, number, category):
    row = one(census, slavenum=text, slaveown=text)
    assert (row.slavenum, row.slaveown, row.slvhcat) == (number, number, category)


def test_keys_are_cut_to_width(census):
    row = one(census, serial="123456789")
    assert row.household == "187012345678" and row.personcode == "1870123456789000"


def test_unreadable_age_is_an_error(census):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        person_records(census({"age": "x"})).collect()


def test_private_households(census):
    rows = census({"gq": "1", "hhtype": "3"}, {"gq": "4"}, {"hhtype": "4"}, {"gq": None})
    assert person_records(rows, private_households_only=True).count() == 1
    assert person_records(rows).count() == 4


def test_narrow_use_reads_narrow(spark, stage, census):
    table = stage.save("census", census({}))
    plan = plan_of(person_records(table).select("famcode"))
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "hik" not in schema and "slavenum" not in schema and "pernum" in schema
