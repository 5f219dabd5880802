"""Calendar expressions. ``as_of`` is always given: nothing asks the clock."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: printf-style date codes and their Spark patterns ------------
DATE_CODES = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd",
    "%b": "MMM", "%M": "MMMM", "%B": "MMMM", "%W": "EEEE", "%A": "EEEE",
}


def day(as_of: datetime.date | str) -> Column:
    return F.to_date(F.lit(str(as_of)))


def within_days(date: Column, as_of: datetime.date, days: int) -> Column:
    """Strictly later than ``days`` before ``as_of`` (future dates pass)."""
    return date > F.date_sub(day(as_of), days)


def at_most_days_old(date: Column, as_of: datetime.date, days: int) -> Column:
    """``datediff(as_of, date) <= days``, written so that it reaches the scan."""
    return date >= F.date_sub(day(as_of), days)


def younger_than_days(date: Column, as_of: datetime.date, days: int) -> Column:
    """``datediff(as_of, date) < days``."""
    return date > F.date_sub(day(as_of), days)


def sunday_week(date: Column) -> Column:
    """Week of the year, 0 to 53; weeks start on Sunday, days before the first are 0."""
    sunday_based = F.dayofweek(date) - 1
    return F.floor((F.dayofyear(date) + 6 - sunday_based) / 7).cast("int")


def quarter_block(date: Column) -> Column:
    """Blocks of 13 weeks, 0 to 4."""
    return F.round(sunday_week(date) / 13).cast("int")


def month_name(date: Column) -> Column:
    return F.date_format(date, "MMMM")


def formatted(date: Column, codes: str) -> Column:
    """A date by printf-style codes, e.g. ``%b %d '%y``. ``%e`` is the day padded with a
    blank. Null stays null."""
    pieces: list[Column] = []
    pattern = ""

    def flush() -> None:
        nonlocal pattern
        if pattern:
            pieces.append(F.date_format(date, pattern))
            pattern = ""

    i = 0
    while i < len(codes):
        code = codes[i:i + 2]
        if code == "%e":
            flush()
            pieces.append(F.lpad(F.date_format(date, "d"), 2, " "))
            i += 2
        elif code in DATE_CODES:
            pattern += DATE_CODES[code]
            i += 2
        else:
            char = codes[i]
            pattern += "''" if char == "'" else (f"'{char}'" if char.isalpha() else char)
            i += 1
    flush()
    return pieces[0] if len(pieces) == 1 else F.concat(*pieces)


def parsed(text: Column, codes: str = "%Y-%m-%d") -> Column:
    """Text to date; null when the text is no such date. ``%c`` and ``%D``-free: month and
    day may have one digit."""
    pattern = codes.replace("%Y", "yyyy").replace("%m", "M").replace("%d", "d").replace("%y", "yy")
    return F.try_to_timestamp(text, F.lit(pattern)).cast("date")


def two_digit_year_date(year: Column, month: Column, dayno: Column) -> Column:
    """Years below 50 are 20yy, others 19yy. Null when a part is missing or 0, or when the
    parts are no date."""
    y, m, d = (p.cast("string").try_cast("double").cast("int") for p in (year, month, dayno))
    given = (y != 0) & (m != 0) & (d != 0)
    full = F.when(y < 50, y + 2000).otherwise(y + 1900)
    text = F.concat_ws("-", full.cast("string"), m.cast("string"), d.cast("string"))
    return F.when(given, parsed(text))


def greatest_or_null(a: Column, b: Column) -> Column:
    """Null when either is null (Spark's own ``greatest`` skips nulls)."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def session_title(group_name: Column, date: Column, time: Column) -> Column:
    return F.concat_ws(" ", group_name, F.date_format(date, "MM/dd/yyyy"), time)
