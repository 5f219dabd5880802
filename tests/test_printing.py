"""Amounts on printed lines, pages as portals write them, and money left on days without visits."""

from __future__ import annotations

from pyspark.sql import functions as F

from conftest import d, m, rows
from tallywork.functions import billing
from tallywork.plans.claims import _phone_parts
from tallywork.sources import pages
from tallywork.sources.print_layout import Piece, line_text, wide_amounts
from tallywork.streaming import balances


def test_no_amount_is_shortened(spark):
    line = [Piece(1, 8, "amount", "right", amount=True)]
    df = spark.createDataFrame([("1,234.50",), ("12,345.67",), ("1,234,567.89",), (None,)],
                               "amount string")
    assert [r[0] for r in df.select(line_text(line)).collect()] == [
        "1,234.50", "12345.67", "********", " " * 8]
    assert rows(wide_amounts(df, [], [line])) == [("amount", "1,234,567.89")]


def test_number_is_all_after_the_first_blank(spark):
    df = spark.createDataFrame([("913 555 0100",), ("5550100",), (None,)], "phone string")
    parts = _phone_parts("p", F.col("phone"))
    assert [tuple(r) for r in df.select(parts["p_acode"], parts["p_no"]).collect()] == [
        ("913", "555 0100"), (None, "5550100"), (None, None)]


def test_blanks_are_no_text(spark):
    df = spark.createDataFrame([("  ",), ("",), ("x ",)], "a string")
    assert [r[0] for r in df.select(billing.has_text(F.col("a"))).collect()] == [False, False, True]


def test_links_in_any_case_and_quoting(spark):
    html = "<A HREF=x>one</A> <a class='c' href = \"it's\">two</a> <a href='z'>three</a>"
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert rows(pages.extract_links(df)) == [
        (1, 0, "one", "x"), (1, 1, "two", "it's"), (1, 2, "three", "z")]


def test_claims_come_from_the_first_centred_table(spark):
    menu = "<table><tr><td>Menu</td></tr><tr><td>Home</td></tr></table>"
    claims = ("<TABLE ALIGN=center><TR><TD>No</TD></TR>"
              "<TR><TD>1</TD><TD><A HREF=v?7>7</A></TD><TD>9</TD></TR></TABLE>")
    df = spark.createDataFrame([(1, menu + claims + claims)], "page_id long, html string")
    got = pages.extract_claim_rows(df, ["page_id"])
    assert rows(got.select("page_id", "trace_no", "href", "batch")) == [(1, 7, "v?7", 9)]


def test_money_of_a_day_without_visits_is_kept(spark):
    cells = spark.createDataFrame(
        [(1, d("2001-01-01"), 0, m(10), m(0), m(0)), (1, d("2001-01-02"), 1, m(5), m(1), m(0)),
         (2, d("2001-01-01"), 0, m(0), m(0), m(0))], balances.CELLS)
    assert rows(balances.balances(cells)) == [
        (1, d("2001-01-02"), d("2001-01-02"), m(15), m(1), m(0), m(14))]


def test_a_list_ends_with_its_own_table(spark):
    html = ("<table valign=center><tr><td>no</td></tr></table>"
            "<TABLE width=9 align='Center'><tr><td><table><tr><td>x</td></tr></table></td></tr>"
            "<tr><td>1</td><td>&nbsp;<a href=b?n=7>7</a></td></tr>"
            "<tr><td>2</td><td><a href='b?n=6'>6</a></td></tr></TABLE>"
            "<table align=center><tr><td>h</td></tr><tr><td>1</td><td>5</td></tr></table>")
    df = spark.createDataFrame([(1, html), (2, ""), (3, None), (4, "<table align=left><tr></tr></table>")],
                               "page_id int, html string")
    got = pages.extract_batches(df, ["page_id"]).where("batch_no is not null").orderBy("pos")
    assert [(r.batch_no, r.href) for r in got.collect()] == [(7, "b?n=7"), (6, "b?n=6")]
