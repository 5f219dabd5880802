"""What a report's field may say: a column, a literal, or one of five functions."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywork.functions import dates


def report_functions(as_of: datetime.date) -> dict[str, Callable[..., Column]]:
    return {
        "date": lambda: dates.day(as_of),
        "stod": as_date,
        "iif": lambda test, yes, no: F.when(test, yes).otherwise(no),
        "format": lambda d, codes: dates.formatted(d, _codes(codes)),
        "val": lambda value: value,
    }


def _codes(codes: str) -> str:
    if not codes.startswith("!@"):
        raise ValueError(f"a date format starts with !@: {codes}")
    return codes[2:]


def as_date(value: Column) -> Column:
    """ISO text or a date, as a date."""
    return dates.parsed(value.cast("string"))


def field(df: DataFrame, name: str) -> Column:
    """The column of that name, in any case; a field that names none shows its own text."""
    found = {c.lower(): c for c in df.columns}.get(name.lower())
    return F.col(f"`{found}`") if found else F.lit(name)


def printed(value: Column, kind: T.DataType, width: int) -> Column:
    """As printed: dates as mm/dd/YYYY, nothing for null, cut to the column's width."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(value, "MM/dd/yyyy")
    else:
        text = value.cast("string")
    return F.substring(F.coalesce(text, F.lit("")), 1, width)


def printed_columns(df: DataFrame, widths: Sequence[tuple[str, int]]) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[printed(F.col(c), kinds[c], w).alias(c) for c, w in widths])
