"""Codebooks (where each variable sits in a line) and the fixed-width files they describe.

A file has one line per person, with household (H) and person (P) variables in columns of their own, or lines of
two record types: a household's line, then those of its persons. The codebook tells which: in the second case
the variable RECTYPE stands under both bases and the others share columns.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from kinspark.sources.stage import Stage

# Fixed value: the pattern of a variable line (name, record basis, column range, length).
CODEBOOK_PATTERN = r"\s{2}(\w+)\s+([HP])\s+([0-9,-]+)\s+(\d+)"
CODEBOOK_COLUMNS = ["variable", "basis", "range", "length"]
HOUSEHOLD, PERSON = "H", "P"
RECORD_TYPE = "rectype"


@dataclass(frozen=True)
class Field:
    """One column of a fixed-width line: the spans (start counting from 1, length) it is put together from."""

    name: str
    spans: tuple[tuple[int, int], ...]

    @property
    def length(self) -> int:
        return sum(length for _, length in self.spans)

    def cut(self, line: str = "value") -> Column:
        return F.concat(*(F.substring(line, start, length) for start, length in self.spans)).alias(self.name)


@dataclass(frozen=True)
class RecordTypes:
    """The layouts of a file with household and person lines, and the field that tells them apart."""

    mark: Field
    household: tuple[Field, ...]
    person: tuple[Field, ...]


def parse_codebook(lines: DataFrame, pattern: str = CODEBOOK_PATTERN) -> DataFrame:
    """Variable lines of codebook text (column ``value``) as four text columns; the rest drop out."""
    matching = lines.filter(F.col("value").rlike(pattern))
    groups = [
        F.regexp_extract("value", pattern, i).alias(name)
        for i, name in enumerate(CODEBOOK_COLUMNS, start=1)
    ]
    return matching.select(*groups)


def spans_of(variable: str, ranges: str) -> tuple[tuple[int, int], ...]:
    """The spans of a column range such as ``7``, ``1-4`` or ``1-2,7-8``."""
    spans = []
    for part in ranges.split(","):
        first, _, last = part.partition("-")
        last = last or first
        if not (first.isdigit() and last.isdigit() and 1 <= int(first) <= int(last)):
            raise ValueError(f"variable {variable}: {ranges!r} is not a list of column ranges")
        spans.append((int(first), int(last) - int(first) + 1))
    return tuple(spans)


def layout_from_codebook(codebook: DataFrame) -> list[Field] | RecordTypes:
    """The layout on the driver: one entry per output column, as many as a table has.

    Variables of one line must lie in columns of their own. Household and person variables are of one line unless
    RECTYPE stands under both bases.
    """
    rows = codebook.collect()
    fields: dict[str, list[Field]] = {HOUSEHOLD: [], PERSON: []}
    for row in rows:
        spans = spans_of(row["variable"], row["range"])
        if sum(length for _, length in spans) != int(row["length"]):
            raise ValueError(f"variable {row['variable']}: range and length disagree")
        fields[row["basis"]].append(Field(row["variable"].lower(), spans))
    marks = {basis: [f for f in own if f.name == RECORD_TYPE] for basis, own in fields.items()}
    if not all(marks.values()):
        return _line(fields[HOUSEHOLD] + fields[PERSON])
    if marks[HOUSEHOLD] != marks[PERSON]:
        raise ValueError("the record type lies in different columns of household and person lines")
    lines = {basis: tuple(f for f in _line(own) if f.name != RECORD_TYPE) for basis, own in fields.items()}
    twice = {f.name for f in lines[HOUSEHOLD]} & {f.name for f in lines[PERSON]}
    if twice:
        raise ValueError(f"variables of household and of person lines have one name: {sorted(twice)}")
    return RecordTypes(marks[HOUSEHOLD][0], lines[HOUSEHOLD], lines[PERSON])


def _line(fields: list[Field]) -> list[Field]:
    """The fields of one line in the order of their columns, of which each belongs to one field."""
    taken: dict[int, str] = {}
    for field in fields:
        for column in (c for start, length in field.spans for c in range(start, start + length)):
            if column in taken:
                raise ValueError(f"variables {taken[column]} and {field.name} share column {column}")
            taken[column] = field.name
    return sorted(fields, key=lambda field: field.spans)


def layout_from_widths(widths: dict[str, int]) -> list[Field]:
    """Adjoining fields, in order, from their widths."""
    fields, start = [], 1
    for name, length in widths.items():
        fields.append(Field(name, ((start, length),)))
        start += length
    return fields


def record_types_from_widths(household: dict[str, int], person: dict[str, int]) -> RecordTypes:
    """Household and person lines that start with their record type, their fields adjoining."""
    lines = [layout_from_widths({RECORD_TYPE: 1, **widths}) for widths in (household, person)]
    return RecordTypes(lines[0][0], tuple(lines[0][1:]), tuple(lines[1][1:]))


def codebook_text(layout: Iterable[Field] | RecordTypes) -> list[str]:
    """The variable lines of a codebook that describes the layout (a single line's as person variables)."""
    if isinstance(layout, RecordTypes):
        described = [(HOUSEHOLD, (layout.mark, *layout.household)), (PERSON, (layout.mark, *layout.person))]
    else:
        described = [(PERSON, layout)]
    lines = []
    for basis, fields in described:
        for field in fields:
            ranges = ",".join(f"{start}-{start + length - 1}" for start, length in field.spans)
            lines.append(f"  {field.name.upper()}  {basis}  {ranges}  {field.length}")
    return lines


def slice_fixed_width(lines: DataFrame, layout: Iterable[Field]) -> DataFrame:
    """Cut each line (column ``value``) into text columns: one projection, no shuffle."""
    return lines.select(*(field.cut() for field in layout))


def read_fixed_width(spark: SparkSession, path: str, layout: Iterable[Field]) -> DataFrame:
    """A fixed-width text file (splittable, so read in parallel) as text columns."""
    return slice_fixed_width(spark.read.text(path), layout)


def read_batch(spark: SparkSession, batch: Row, folder: str | None = None, stage: Stage | None = None) -> DataFrame:
    """The data file of one import batch, cut by the codebook beside it.

    ``folder`` replaces the batch's own path where the files have moved. A file with lines of two record types
    is read by way of a table in ``stage``.
    """
    from kinspark.sources.hierarchical import read_hierarchical

    place = (folder or batch["path"]).rstrip("/")
    lines = spark.read.text(f"{place}/{batch['cbkfilename']}")
    layout = layout_from_codebook(parse_codebook(lines, batch["pattern"]))
    path = f"{place}/{batch['datafile']}"
    if isinstance(layout, RecordTypes):
        return read_hierarchical(spark, path, layout, stage or Stage(spark))
    return read_fixed_width(spark, path, layout)


def padded(fields: Iterable[Field], start: int = 1) -> Column:
    """The line of fields of one span that adjoin each other, from column ``start`` on.

    NULLs become blanks; a value longer than its field is an error.
    """
    values, fits, messages, end = [], [], [], start
    for field in fields:
        if field.spans[0][0] != end or len(field.spans) > 1:
            raise ValueError(f"field {field.name} does not adjoin the one before")
        end += field.length
        value = F.coalesce(F.col(field.name), F.lit(""))
        values.append(F.rpad(value, field.length, " "))
        fits.append(F.length(value) <= field.length)
        message = F.concat(F.lit(f"{field.name} is longer than {field.length}: "), value)
        messages.append(F.when(~fits[-1], message))
    # One test for the whole line; the message is looked for in a line that fails it.
    wrong = F.raise_error(F.coalesce(*messages)).cast("string")
    return F.when(reduce(Column.__and__, fits), F.concat(*values)).otherwise(wrong)


def to_fixed_width(df: DataFrame, layout: Iterable[Field]) -> DataFrame:
    """The inverse of ``slice_fixed_width`` for fields of one span that adjoin each other."""
    return df.select(padded(layout).alias("value"))
