from __future__ import annotations

import datetime
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import ROWS, d, m, rows, table
from tallywork.catalog import AT, DORMANT_BEFORE
from tallywork.plans import quality, reports, upkeep, views
from tallywork.sources import tables

COLUMNS = ["id", "recent", "billing_cutoff", "charges", "client_paid", "insurance_paid",
           "balance", "balance_cached"]


def test_one_aggregation_equals_the_three_steps(case, tiny):
    for db in (case.raw, tiny):
        one = db.replaced(client=upkeep.reset_balances(db))
        two = one.replaced(client=upkeep.mark_dormant(one, DORMANT_BEFORE))
        three = upkeep.refresh_balances(two, AT, everybody=False)
        fused = upkeep.with_balances(db, DORMANT_BEFORE, AT).client
        assert rows(three.select(*COLUMNS)) == rows(fused.select(*COLUMNS))


def test_refresh_again_changes_nothing(case):
    once = case.db.replaced(client=upkeep.refresh_balances(case.db, AT, True))
    twice = upkeep.refresh_balances(once, AT, True)
    assert rows(once.client.select(*COLUMNS)) == rows(twice.select(*COLUMNS))


def test_refresh_of_everybody_clears_clients_without_visits(spark, tiny):
    db = tiny.replaced(client=tiny.client.withColumns({
        "balance": F.lit(m(7)).cast("decimal(18,2)"), "recent": F.lit(d("2001-01-01"))}))
    kept = upkeep.refresh_balances(db, AT, False).where("id = 4").first()
    gone = upkeep.refresh_balances(db, AT, True).where("id = 4").first()
    assert (kept.balance, kept.recent) == (m(7), d("2001-01-01"))
    assert (gone.balance, gone.recent) == (None, None)


def test_refresh_of_some_clients(tiny):
    got = {r.id: r.charges for r in upkeep.refresh_balances(tiny, AT, True, [1]).collect()}
    assert got[1] is not None and got[2] is None and len(got) == 4
    assert rows(upkeep.refresh_balances(tiny, AT, True, []).select(*COLUMNS)) == rows(
        tiny.client.select(*COLUMNS))


def test_sums_of_due(case):
    total = views.attendance_all(case.db).agg(
        F.sum("due").alias("due"),
        F.sum(F.col("charge") - F.col("client_paid")
              - F.coalesce("insurance_paid", F.lit(0))).alias("again")).first()
    assert total.due == total.again


def test_merge_keeps_visits_and_drops_the_other_client(spark, tiny):
    merged = upkeep.merge_clients(tiny, spark.createDataFrame([(2,)], "id long"))
    assert rows(merged.client.select("id")) == [(2,), (3,), (4,)]
    assert rows(merged.insurance.select("client_id")) == [(3,)]  # client 1's went with it
    assert merged.visit.where("client_id = 1").count() == 0
    assert merged.visit.where("client_id = 2").count() == 8
    assert merged.visit.agg(F.sum("charge")).first()[0] == tiny.visit.agg(F.sum("charge")).first()[0]


def test_of_two_chosen_of_one_name_the_first_is_kept(spark, tiny):
    merged = upkeep.merge_clients(tiny, spark.createDataFrame([(2,), (1,)], "id long"))
    assert rows(merged.client.select("id")) == [(1,), (3,), (4,)]


def test_deletes_follow_references(spark, tiny):
    one = spark.createDataFrame([(1,)], "id long")
    group = upkeep.delete_rows(tiny, "group", one)
    assert rows(group.session.select("id")) == [(11,), (13,)]
    assert group.visit.where("session_id in (10, 12)").count() == 0 and group.visit.count() == 6
    office = upkeep.delete_rows(tiny, "office", one)
    assert rows(office.officer.select("id", "office_id")) == [(1, None), (2, 2)]
    assert rows(office.client.where("court_id is not null").select("id")) == []
    carrier = upkeep.delete_rows(tiny, "carrier", one)
    assert carrier.insurance.count() == 0 and carrier.client.count() == 4


def test_a_used_procedure_stays_with_what_uses_it(spark, tiny):
    used = {r.cpt for r in tiny.visit.collect()} | {r.cpt for r in tiny.group.collect()}
    extra = table(spark, "procedure", dict(cpt="00000"))
    db = tiny.replaced(procedure=tiny.procedure.unionByName(extra))
    everything = db.procedure.select("cpt")
    left = upkeep.delete_rows(db, "procedure", everything)
    assert {r.cpt for r in left.procedure.collect()} == used & {r.cpt for r in db.procedure.collect()}
    assert left.visit.count() == tiny.visit.count() and left.group.count() == tiny.group.count()
    refused = upkeep.refused_deletes(db, "procedure", everything).collect()
    assert "00000" not in {r.row_key for r in refused}
    uses = sum(r.uses for r in refused if r.by_table == "visit")
    assert uses == tiny.visit.join(db.procedure, "cpt", "left_semi").count()


def test_refusals_are_carried_up_to_every_parent_that_led_there(spark, tiny, monkeypatch):
    """A reference that restricts, two steps below what is deleted: one root is refused with all that
    lies under it, the other goes."""
    from tallywork import schema
    more = [*schema.REFERENCES, schema.Reference("batch", "name", "visit", "restrict")]
    monkeypatch.setattr(schema, "REFERENCES", more)
    visits = {r.id: r.session_id for r in tiny.visit.collect()}
    groups = {r.id: r.group_id for r in tiny.session.collect()}
    held = min(v for v, s in visits.items() if groups[s] == 1)
    db = tiny.replaced(batch=table(spark, "batch", dict(name=held)))
    both = spark.createDataFrame([(g,) for g in sorted(set(groups.values()))], "id long")
    left = upkeep.delete_rows(db, "group", both)
    assert {r.id for r in left.group.collect()} & set(groups.values()) == {1}
    assert {r.id for r in left.session.collect()} == {s for s, g in groups.items() if g == 1}
    assert {r.id for r in left.visit.collect()} == {v for v, s in visits.items() if groups[s] == 1}
    refused = upkeep.refused_deletes(db, "group", both).collect()
    assert [(r.row_key, r.by_table, r.uses) for r in refused] == [("1", "batch", 1)]


def test_a_returning_client(spark, tiny):
    db = tiny.replaced(client=table(spark, "client", dict(id=1, name="A", recent=d("2001-05-05")),
                                    dict(id=2, name="B", billing_cutoff=d("2001-01-01"),
                                         recent=d("2001-02-02"))))
    new = spark.createDataFrame([(1, d("2001-03-01")), (2, d("2001-06-01")), (1, d("2001-02-01"))],
                                "client_id long, session_date date")
    got = upkeep.visits_entered(db, new).select("id", "billing_cutoff", "recent")
    assert rows(got) == [(1, d("2001-02-01"), d("2001-05-05")), (2, d("2001-01-01"), d("2001-06-01"))]


def test_audit_columns(tiny):
    new = upkeep.stamp_inserted(tiny.office, "ann", AT)
    later = AT + datetime.timedelta(days=1)
    got = upkeep.stamp_updated(new, F.col("id") == 2, "bob", later).select(
        "id", "added_user", "modified_user", "modified_time")
    assert rows(got) == [(1, "ann", "ann", AT), (2, "ann", "bob", later)]


def test_add_columns_keeps_those_there(spark):
    df = spark.createDataFrame([(1, "x")], "id long, Name string")
    got = upkeep.add_columns(df, {"name": "string", "file": "string"})
    assert got.columns == ["id", "Name", "file"] and got.first().file is None


def test_group_code_only_where_there_is_one(tiny):
    got = {r.id: r.cpt for r in upkeep.set_group_cpt(tiny).collect()}
    assert got["v0"] == "90853" and got["v1"] is None  # group 2 has an empty code


def test_set_batch_replaces_its_row(tiny):
    got = upkeep.set_batch(tiny.batch, "current", d("2001-04-01"), "5")
    assert rows(got) == [("current", d("2001-04-01"), m(5)), ("income", d("2001-02-01"), None)]


def test_scalar_of_two_rows_is_an_error(tiny):
    twice = tiny.replaced(batch=tiny.batch.unionByName(tiny.batch))
    with pytest.raises(Exception, match="(?i)scalar|more than one row"):
        views.attendance(twice).collect()


def test_no_batch_means_no_rows(tiny):
    none = tiny.replaced(batch=tiny.batch.where("name = 'income'"))
    assert views.attendance(none).count() == 0


def test_violations(spark, tiny):
    bad = tiny.replaced(
        therapist=table(spark, "therapist", *[{**t, "tax_id": "x", "name": "Same"}
                                              for t in ROWS["therapist"]]),
        visit=table(spark, "visit", dict(id="a", client_id=99, session_id=10, attend_n=2,
                                         charge=m(1), client_paid=m(1), insurance_paid=m(0),
                                         cpt="1234567", discharge_status="Q")))
    got = set(rows(quality.violations(bad)))
    assert {("visit", "a", "attend_n 0 or 1"), ("visit", "a", "cpt length"),
            ("visit", "a", "discharge_status allowed"), ("visit", "a", "client_id in client"),
            ("visit", "a", "cpt in procedure"), ("therapist", "same", "name unique"),
            ("therapist", "2", "one tax_id")} <= got
    assert not any(rule == "session_id in session" for _, _, rule in got)


def test_every_kind_of_violation_at_once(spark, tiny):
    """A parent listed twice, a child of two lost parents and a null reference: one row a rule and value."""
    visits = [dict(id="a", client_id=99, session_id=98, charge=m(1), client_paid=m(1), insurance_paid=m(0)),
              dict(id="b", client_id=1, session_id=None, charge=m(1), client_paid=None, insurance_paid=m(0)),
              dict(id="b", client_id=1, session_id=10, charge=m(1), client_paid=m(1), insurance_paid=m(0))]
    bad = tiny.replaced(client=tiny.client.unionByName(tiny.client),
                        visit=table(spark, "visit", *visits))
    got = Counter(rows(quality.violations(bad)))
    about = {(key, rule): n for (t, key, rule), n in got.items() if t == "visit"}
    assert about == {("a", "client_id in client"): 1, ("a", "session_id in session"): 1,
                     ("b", "session_id required"): 1, ("b", "client_paid required"): 1,
                     ("b", "id unique"): 1}
    assert got["client", "1", "id unique"] == 1


def test_violations_read_visits_three_times(spark, tiny, tmp_path):
    tables.write_practice(tiny, str(tmp_path), 2)
    found = quality.violations(tables.read_practice(spark, str(tmp_path)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("discharge_status" in line or "attend_n" in line for line in plan.splitlines()
               if "Relation" in line) == 3


def test_stored_tables_read_back(spark, tiny, tmp_path):
    tables.write_practice(tiny, str(tmp_path), 2)
    back = tables.read_practice(spark, str(tmp_path))
    for name in ("visit", "client", "batch"):
        assert back[name].schema == tiny[name].schema and rows(back[name]) == rows(tiny[name])
    with pytest.raises(Exception, match="already exists"):
        tables.write_table(tiny.batch, str(tmp_path), "batch")


def test_older_versions_of_a_table(spark):
    old = spark.createDataFrame([(1, "A")], "ID int, Name string")
    got = tables.conform(old, "office")
    assert got.columns == ["id", "name", "address", "fax"] and got.first().fax is None


def test_differences_are_found(case):
    assert reports.stored_due_differences(case.db, AT.date()).count() == 0


def test_bucketed_tables_join_without_a_shuffle(spark, tiny, tmp_path):
    names = {}
    for name in tables.BUCKETED:
        names[name] = f"bucketed_{name}"
        tables.save_bucketed(tiny[name], name, 4, str(tmp_path / name), names[name])
    db = tables.bucketed_practice(spark, tiny, names)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = views.dated_visits(db)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert rows(views.client_balances(db)) == rows(views.client_balances(tiny))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for table_name in names.values():
            spark.sql(f"drop table {table_name}")
