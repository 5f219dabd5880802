"""Registered queries against their SQL in DuckDB. All of them with CHECK_ALL=1; otherwise
one of each family (tools/check.py runs all at any scale)."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from check import compare, connect  # noqa: E402
from conftest import SMALL  # noqa: E402
from oracle.queries import SQL  # noqa: E402
from tallywork.catalog import QUERIES  # noqa: E402

SOME = """s02_view_query s07_extract_links s12_lookups p05_billing_status f04_days_old
j04_since_cutoff a02_attendance_trend a12_break_sums_level a15_rollup w05_parity x02_sunday_week
x13_money m05_therapist_weight m08_visits_entered m14_visit_defaults r01_attendance_all
r06_bulk_invoices r14_income_by_therapist r16_last_30 r23_invoice_batch c04_claim_review
t01_streamed_balances""".split()


@pytest.mark.parametrize("name", sorted(oracle_sql()) if os.environ.get("CHECK_ALL") else SOME)
def test_same_rows(spark, name):
    ok, note = compare(spark, connect(SMALL), SMALL, name, queries()[name], oracle_sql()[name])
    assert ok, note


def test_every_query_of_the_practice_has_its_sql():
    assert set(QUERIES) == set(SQL)
    assert set(SQL) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns == ["client_id", "oldest_session_date", "recent", "charges",
                                    "client_paid", "insurance_paid", "balance"]
