from __future__ import annotations

import datetime
import re

import pytest
from pyspark.sql import functions as F

from conftest import d, m, rows, table
from tallywork.plans import lookups, reports, upkeep, views
from tallywork.operators.joins import join_every, left_first_wins, only_keys, since

AS_OF = datetime.date(2001, 11, 15)


def test_unknown_names_are_errors(tiny):
    for call in (lambda: reports.report(tiny, "nope", AS_OF), lambda: lookups.lookup(tiny, "nope"),
                 lambda: views.view(tiny, "nope", AS_OF), lambda: lookups.related(tiny, "client", "nope")):
        with pytest.raises(KeyError):
            call()


def test_every_report_runs_and_has_its_order(tiny):
    db = upkeep.with_balances(tiny, d("2001-01-01"), datetime.datetime(2001, 11, 15))
    for name, (_, order) in reports.REPORTS.items():
        df = reports.report(db, name, AS_OF)
        assert {c for c, _ in order} <= set(df.columns), name
        assert len(set(df.columns)) == len(df.columns), name


def test_printed_order(case):
    got = [(r.client_name, r.group_name, r.session_date) for r in reports.printed_report(
        case.db, "voucher_clients", AS_OF).collect()]
    assert got == sorted(got) and got
    due = [r.balance for r in reports.printed_report(case.db, "amount_due", AS_OF).collect()]
    assert due == sorted(due, reverse=True)


@pytest.mark.parametrize("name", ["attendance_by_client", "attendance_by_group", "weekly_groups"])
def test_ranges_change_no_result(case, name):
    """Over one range and over many: the same."""
    df = reports.report(case.db, name, AS_OF)
    if name == "weekly_groups":  # ten days hold few rows; take them all
        df = reports.report(case.db, name, datetime.date(1990, 1, 1))
    spec = reports.BREAKS[name]
    runs = ["id", *[f"run_{x.name}" for x in spec.levels], "start_level", "is_end"]
    from tallywork.operators.breaks import with_breaks
    one, many = (rows(with_breaks(df, spec, n).select(*runs)) for n in (1, 60))
    assert one == many and one


def test_two_clients_of_one_name_interleave(spark, tiny):
    """Sorted by name and group, the two Anns take turns: 1 2 2 1 in the one group and
    2 1 1 2 in the other are six runs of two clients."""
    df = reports._smoke(tiny).where("client_name = 'Doe, Ann'")
    spec = reports.BREAKS["voucher_clients"]
    from tallywork.operators.breaks import subtotals
    got = subtotals(df, spec, "client")
    assert got.count() == 6 and got.select("client_id").distinct().count() == 2


def test_balances_need_a_cutoff(tiny):
    assert rows(views.client_balances(tiny).select("client_id")) == [(1,), (2,)]
    two = views.client_balances(tiny).where("client_id = 2").first()
    # visits 1, 4, 7, 10 in sessions 11, 10, 13, 12; that of session 10 is before the cutoff
    assert (two.oldest_session_date, two.recent) == (d("2001-02-05"), d("2001-04-05"))
    assert two.charges == m(51 + 57 + 60) and two.balance == m(51 + 57 + 60 - 1 - 7 - 10 - 10)


def test_batches_and_invoices(tiny):
    db = upkeep.with_balances(tiny, d("2001-01-01"), datetime.datetime(2001, 11, 15))
    assert rows(views.batch_clients(db).groupBy("batch_name").count()) == [("current", 3), ("income", 3)]
    low = db.replaced(batch=table(db.batch.sparkSession, "batch", dict(
        name="current", cutoff=d("2001-03-01"), invoice_threshold=m(10000))))
    assert views.bulk_invoices(low).count() == 0 and views.bulk_invoices(db).count() == 3
    one = reports.invoice_summary(db, AS_OF, 1).first()
    assert one["name"] == "Doe, Ann" and one.charges == "218.00"
    # visits 0, 3, 6, 9 of client 1, all attended
    assert reports.invoice_lines(db, 1).count() == 4


def test_trend_counts_attended_visits_of_four_years(tiny):
    got = views.group_attendance_trend(tiny, datetime.date(2005, 1, 1))
    assert got.agg(F.sum("visits")).first()[0] == 11  # of 12, one was not attended
    # the session of 5 February, with two attended visits, is 1459 and 1460 days old
    for day, visits in ((3, 8), (4, 6)):
        got = views.group_attendance_trend(tiny, datetime.date(2005, 2, day))
        assert got.agg(F.sum("visits")).first()[0] == visits


def test_patterns_ignore_case(spark, tiny):
    db = tiny.replaced(group=tiny.group.withColumn("name", F.upper("name")))
    assert reports.cwip(db, AS_OF).count() == reports.cwip(tiny, AS_OF).count() == 6


@pytest.mark.parametrize("bounds", [[], [3], [None, 1, 4, 4, 9], list(range(40))])
def test_since_finds_each_bound_that_is_not_above(spark, bounds):
    few = spark.createDataFrame([(i, b) for i, b in enumerate(bounds)], "n int, bound int")
    values = [None, 0, 1, 4, 5, 100]
    many = spark.createDataFrame([(v,) for v in values], "value int")
    got = since(many, "value", few, "bound")
    assert sorted(map(tuple, got.select("value", "n").collect())) == sorted(
        (v, i) for v in values if v is not None for i, b in enumerate(bounds) if b is not None and b <= v)
    some = since(many, "value", few, "bound", lambda x: x["n"] % 2 == 0)
    assert rows(some) == rows(got.where("n % 2 = 0"))


def test_join_every_in_any_number_of_slots(spark):
    many = spark.range(50).withColumnRenamed("id", "a")
    few = spark.range(3).withColumnRenamed("id", "b")
    for spread in (None, 1, 7):
        assert join_every(many, few, "a", spread=spread).distinct().count() == 150
        assert join_every(many, few, "a", F.col("a") < F.col("b"), spread).count() == 3


def test_first_name_wins(spark):
    left = spark.createDataFrame([(1, "l")], "id long, x string")
    right = spark.createDataFrame([(1, "r", 5)], "id long, X string, y int")
    assert left_first_wins(left, right, "id", "id").columns == ["id", "x", "y"]
    assert rows(left_first_wins(left, right, "id", "id")) == [(1, "l", 5)]


def test_keys_by_list_or_table(spark, tiny):
    by_table = only_keys(tiny.visit, "id", spark.createDataFrame([("v1",), ("v1",)], "k string"))
    assert rows(by_table.select("id")) == rows(only_keys(tiny.visit, "id", ["v1"]).select("id")) == [("v1",)]


def test_lookup_order(tiny):
    db = tiny.replaced(therapist=upkeep.set_therapist_weight(tiny))
    assert [r.label for r in lookups.lookup(db, "therapists").collect()] == ["Dr One", "Dr Two"]
    assert [r.label for r in lookups.lookup(db, "groups").collect()] == ["CWIP Monday $20.00", "Talk $30.00"]
    days = [r.session_date for r in lookups.default_order("session", tiny.session).collect()]
    assert days == sorted(days, reverse=True)


def test_related_rows(tiny):
    got = lookups.related(tiny, "session", "visits")
    assert got.groupBy("from_key").count().where("count != 3").count() == 0
    assert rows(lookups.related(tiny, "client", "court").select("from_key", "name")) == [(1, "Court A")]


def test_old_clients_are_flagged(tiny):
    db = upkeep.with_balances(tiny, d("2001-01-01"), datetime.datetime(2001, 11, 15))
    got = {r.id: r.is_old for r in upkeep.before_current_cutoff(db).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1}


def test_names_for_sql(spark, tiny):
    views.register_views(spark, tiny, AS_OF)
    assert spark.sql("select count(*) from attendance_all").first()[0] == 12
    assert spark.sql("select sum(due) from client_balances cb join attendance_all a "
                     "on a.client_id = cb.client_id").first()[0] is not None


def _visit_scans(df) -> int:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(r"Relation \[id#\w+,client_id#\w+,session_id#", plan))


def test_balances_and_sums_do_not_join_the_visits_anew(case):
    """The bulk invoices make the clients' balances once; the three levels join visits and sessions once."""
    db = upkeep.with_balances(case.raw, d("2001-01-01"), datetime.datetime(2001, 11, 15))
    assert _visit_scans(reports.report(db, "invoice_batch", AS_OF)) == 1
    assert _visit_scans(reports.report(db, "three_levels", AS_OF)) == 0


def test_discharges_meet_visits_where_they_lie(case, spark):
    """Visits lie by client when the discharges of client and group are looked up, and stay there."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = reports.report(case.db, "attendance_by_client", AS_OF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert not re.search(r"hashpartitioning\(client_id#\w+, group_id", plan)
