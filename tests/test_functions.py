from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tallywork.functions import billing, dates, forms, report_fields

AS_OF = datetime.date(2001, 11, 15)


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values \
        else spark.range(1)
    return df.select(column).first()[0]


@pytest.mark.parametrize("day,codes,text", [
    ("2012-11-03", "%e %b %Y", " 3 Nov 2012"), ("2012-11-10", "%e %b%y", "10 Nov12"),
    ("2001-06-09", "%b %d '%y", "Jun 09 '01"), ("2013-09-23", "%W, %M %d, %Y",
                                                "Monday, September 23, 2013"),
    ("2001-06-09", "%m/%d/%Y", "06/09/2001")])
def test_date_codes(spark, day, codes, text):
    assert one(spark, dates.formatted(F.lit(day).cast("date"), codes)) == text


def test_date_codes_keep_null(spark):
    assert one(spark, dates.formatted(F.lit(None).cast("date"), "%e %b %Y")) is None


def test_sunday_week_is_strftime_u(spark):
    start = datetime.date(1999, 12, 20)
    df = spark.range(800).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("day"))
    for day, week in df.select("day", dates.sunday_week(F.col("day"))).collect():
        assert week == int(day.strftime("%U")), day


@pytest.mark.parametrize("parts,expected", [
    (("7", "2", "3"), "2007-02-03"), (("87.0", "7.0", "31.0"), "1987-07-31"),
    (("49", "1", "1"), "2049-01-01"), (("50", "1", "1"), "1950-01-01"),
    (("", "1", "1"), None), (("87", "", "1"), None), (("87", "2", "30"), None),
    (("0", "2", "3"), None)])
def test_two_digit_years(spark, parts, expected):
    y, mo, da = (F.lit(p) for p in parts)
    got = one(spark, dates.two_digit_year_date(y, mo, da))
    assert (str(got) if got else None) == expected


def test_greatest_is_null_when_either_is(spark):
    day = F.lit("2001-01-01").cast("date")
    assert one(spark, dates.greatest_or_null(day, F.lit(None).cast("date"))) is None
    assert str(one(spark, dates.greatest_or_null(day, F.date_add(day, 1)))) == "2001-01-02"


@pytest.mark.parametrize("name,expected", [("Doe, Ann", "DOE.ANN.7"), ("Smith", "SMI.MIT.7")])
def test_account_no(spark, name, expected):
    assert one(spark, billing.account_no(F.lit(name), F.lit(7))) == expected


def test_status_is_the_first_that_fits(spark):
    day, none = F.lit("2001-01-01").cast("date"), F.lit(None).cast("date")
    some, no_id = F.lit(1), F.lit(None).cast("int")
    cpt, no_cpt = F.lit("1"), F.lit(None).cast("string")
    cases = [((day, day, no_id, no_cpt, 0), "paid"), ((none, day, no_id, no_cpt, 0), "billed"),
             ((none, none, no_id, no_cpt, 0), "no ins"), ((none, none, some, no_cpt, 0), "no CPT"),
             ((none, none, some, cpt, 0), "did not attend"), ((none, none, some, cpt, 1), "billable")]
    for (check, bill, policy, code, came), expected in cases:
        assert one(spark, billing.billing_status(check, bill, policy, code, F.lit(came))) == expected


def test_names_compare_without_case_and_trailing_blanks(spark):
    assert one(spark, billing.same_text(F.lit("Doe, Ann "), F.lit("DOE, ann"))) is True
    assert one(spark, billing.same_text(F.lit(" Doe"), F.lit("Doe"))) is False


def test_both_names(spark):
    none = F.lit(None).cast("string")
    assert one(spark, billing.both_names(F.lit("a"), F.lit("b"))) == "a/b"
    assert one(spark, billing.both_names(F.lit("a"), none)) == "a"
    assert one(spark, billing.both_names(none, F.lit("b"))) is None


def test_trace_without_batch(spark):
    trace, batch = billing.trace_and_batch(F.lit("33"))
    assert (one(spark, trace), one(spark, batch)) == ("33", None)


def test_form_values(spark):
    assert one(spark, forms.zip_text(F.lit("66012.0"))) == "66012"
    assert one(spark, forms.zip_text(F.lit(""))) is None
    assert one(spark, forms.phone_text(F.lit("913.0"), F.lit("5550100.0"))) == "913 5550100"
    assert one(spark, forms.phone_text(F.lit(""), F.lit("555-0100"))) == "555-0100"
    assert one(spark, forms.diagnosis_code(F.lit("305"), F.lit("00"))) == "305.00"
    assert one(spark, forms.diagnosis_code(F.lit(""), F.lit("00"))) is None
    assert one(spark, forms.in_parentheses(F.lit("Patient Status (Employed)"))) == "Employed"


@pytest.mark.parametrize("text,number", [("1", 1), ("1a", 1), ("10a", 10), ("21.1", 21), ("", None)])
def test_field_number(spark, text, number):
    assert one(spark, forms.field_number(F.lit(text))) == number


@pytest.mark.parametrize("line,start,cell", [(3, 1, (32, 4)), (7, 1, (48, 4))])
def test_cell_position(spark, line, start, cell):
    got = forms.cell_position(F.lit(line), F.lit(start))
    assert (one(spark, got[0]), one(spark, got[1])) == cell


def test_report_functions(spark):
    fn = report_fields.report_functions(AS_OF)
    assert one(spark, fn["date"]()) == AS_OF
    assert one(spark, fn["format"](fn["stod"](F.lit("2012-11-10")), "!@%e %b %Y")) == "10 Nov 2012"
    assert one(spark, fn["stod"](F.lit("no date"))) is None
    with pytest.raises(ValueError):
        fn["format"](F.lit("2012-11-10"), "%Y")


def test_a_field_that_names_nothing_shows_itself(spark):
    df = spark.range(1).select(F.lit(5).alias("Charge"))
    assert df.select(report_fields.field(df, "charge")).first()[0] == 5
    assert df.select(report_fields.field(df, "iff(1)")).first()[0] == "iff(1)"


def test_printed_columns_are_cut(spark):
    df = spark.range(1).select(F.lit("abcdef").alias("a"), F.lit("2001-02-03").cast("date").alias("b"),
                               F.lit(None).cast("string").alias("c"))
    got = report_fields.printed_columns(df, [("a", 3), ("b", 10), ("c", 5)]).first()
    assert tuple(got) == ("abc", "02/03/2001", "")
