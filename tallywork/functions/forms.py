"""Column expressions for values typed into an insurance form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(text: Column) -> Column:
    """Empty cells are null."""
    return F.when(text != "", text)


def whole_number_text(text: Column) -> Column:
    """A spreadsheet number (``66012.0``) as ``66012``; other text as it is."""
    number = text.try_cast("double").cast("bigint").cast("string")
    return F.coalesce(number, text)


def zip_text(cell: Column) -> Column:
    return whole_number_text(filled(cell))


def phone_text(area: Column, rest: Column) -> Column:
    """``area rest``; only the rest when there is no area code."""
    return F.concat_ws(" ", whole_number_text(filled(area)), whole_number_text(rest))


def diagnosis_code(main: Column, detail: Column) -> Column:
    return F.when(main != "", F.concat(main, F.lit("."), F.coalesce(detail, F.lit(""))))


def checked(cell: Column) -> Column:
    return F.lower(cell) == "x"


def first_checked(boxes: dict[str, Column]) -> Column:
    """The value of the first box that is marked."""
    marks = [F.when(checked(cell), F.lit(value)) for value, cell in boxes.items()]
    return F.coalesce(*marks)


def in_parentheses(label: Column) -> Column:
    return F.regexp_extract(label, r"\(([^)]*)\)", 1)


def field_number(field_no: Column) -> Column:
    """The leading number of ``10a``; null for a field without one."""
    return F.regexp_extract(field_no, r"^(\d{1,2})", 1).try_cast("int")


def cell_position(line: Column, start_column: Column) -> tuple[Column, Column]:
    """Where a printed position lies on the sheet, when no cell is listed for it."""
    return (line * 4 + 20).cast("int"), (start_column * 3 + 1).cast("int")
