"""The practice's named reports: one DataFrame each, its print order and its headings.

``report(db, name, as_of)`` gives the rows (unordered: order costs a shuffle and belongs
to whoever prints or writes); ``printed_report`` sorts them. ``BREAKS[name]`` declares the
headings and subtotals for operators/breaks.py.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork import schema
from tallywork.functions import billing, dates
from tallywork.operators.breaks import BreakSpec, ordering, subtotals, with_breaks
from tallywork.operators.joins import left_first_wins
from tallywork.operators.numbering import Level
from tallywork.plans.upkeep import add_columns, duplicate_names, therapist_sessions
from tallywork.plans.views import (
    attendance,
    attendance_all,
    batch_value,
    bulk_invoices,
    client_balances,
    group_attendance_trend,
    visit_details,
)
from tallywork.practice import Practice
from tallywork.session import kept

DETAIL = ["session_date", "group_name", "attend_n", "charge", "client_paid",
          "insurance_paid", "due"]
MONEY_SUMS = ("attend_n", "charge", "client_paid", "insurance_paid", "due")


def _recent_clients(db: Practice) -> DataFrame:
    return db.client.where(F.col("recent") >= batch_value(db, "current"))


# ---- clients and money ---------------------------------------------------------------

def amount_due(db: Practice, as_of: datetime.date) -> DataFrame:
    c = _recent_clients(db)
    return c.select(*c.columns, F.col("name").alias("client_name"))


def reduced_balances(db: Practice, as_of: datetime.date) -> DataFrame:
    return (_recent_clients(db).where(billing.has_text(F.col("reduced_fee")))
            .select(F.col("name").alias("client_name"), "reduced_fee", "balance",
                    F.col("id").alias("client_id")))


def ins_summary(db: Practice, as_of: datetime.date) -> DataFrame:
    c = _recent_clients(db).select(F.col("id").alias("client_id"),
                                   F.col("name").alias("client_name"), "note")
    ca = db.carrier.select(F.col("id").alias("carrier_id"), F.col("name").alias("carrier_name"))
    i = db.insurance.select("client_id", "carrier_id", "details")
    return (i.join(c, "client_id").join(ca, "carrier_id")
            .select("client_name", "carrier_name",
                    billing.starred(F.col("details"), F.col("note")).alias("details"),
                    "client_id"))


def discharges(db: Practice) -> DataFrame:
    s = db.session.select(F.col("id").alias("session_id"), "group_id",
                          F.col("session_date").alias("discharge_date"))
    return (db.visit.where(F.col("discharge_status").isNotNull())
            .select("client_id", "session_id", "discharge_status").join(s, "session_id")
            .select("client_id", "group_id", "discharge_date", "discharge_status"))


def attendance_by_client(db: Practice, as_of: datetime.date) -> DataFrame:
    with_policy = left_first_wins(attendance(db), db.insurance, "client_id", "client_id")
    return with_policy.join(discharges(db), ["client_id", "group_id"], "left")


def attendance_by_group(db: Practice, as_of: datetime.date) -> DataFrame:
    return attendance(db)


def billing_insurance(db: Practice, as_of: datetime.date) -> DataFrame:
    return attendance(db).where(billing.has_text(F.col("insurance"))
                                | billing.has_text(F.col("carrier_name")))


def voucher_clients(db: Practice, as_of: datetime.date) -> DataFrame:
    return attendance(db).where("voucher > 0")


def cwip(db: Practice, as_of: datetime.date) -> DataFrame:
    a = attendance_all(db).where(F.col("group_name").ilike("%CWIP%"))
    c = db.client.select(F.col("id").alias("_id"), "court_id", "lawyer_id")
    court = db.office.select(F.col("id").alias("court_id"), F.col("name").alias("court_name"))
    lawyer = db.officer.select(F.col("id").alias("lawyer_id"),
                               F.col("name").alias("lawyer_name"))
    return (a.join(c, F.col("client_id") == F.col("_id"))
            .join(court, "court_id", "left").join(lawyer, "lawyer_id", "left")
            .select(*a.columns, "court_name", "lawyer_name"))


def monitoring(db: Practice, as_of: datetime.date) -> DataFrame:
    return (attendance_all(db)
            .where(F.col("group_name").ilike("%monitoring%")
                   & (F.col("recent") >= batch_value(db, "current")))
            .select("client_name", "client_id", "group_name", "session_date", "attend_n",
                    "charge", "client_paid", "due", "note", "id"))


def dup_clients(db: Practice, as_of: datetime.date) -> DataFrame:
    a = attendance_all(db)
    names = duplicate_names(db).select(billing.text_key(F.col("name")).alias("_dup"))
    # the filter by name is made on the clients, before their visits are looked up
    twice = (add_columns(db.client, schema.AUDIT)
             .join(names, billing.text_key(F.col("name")) == F.col("_dup"), "left_semi")
             .select(F.col("id").alias("_id"), "id_dabble", "id_zoho", "added_time",
                     "added_user"))
    return a.join(twice, F.col("client_id") == F.col("_id")).drop("_id")


# ---- sessions ------------------------------------------------------------------------

def evaluations(db: Practice, as_of: datetime.date) -> DataFrame:
    g = db.group.where("evaluation = 1").select(F.col("id").alias("_group"))
    t = db.therapist.select(F.col("id").alias("_therapist"),
                            F.col("name").alias("therapist_name"))
    s = db.session.select(F.col("id").alias("_session"), "time")
    a = attendance_all(db).where(dates.within_days(F.col("session_date"), as_of, 30))
    return (a.join(g, F.col("group_id") == F.col("_group"))
            .join(s, F.col("session_id") == F.col("_session"))
            .join(t, F.col("therapist_id") == F.col("_therapist"))
            .select("group_id", "group_name", "session_date", "time", "client_name",
                    "therapist_name", "charge", "client_paid", "insurance_paid", "due",
                    "note", "id"))


def income_by_therapist(db: Practice, as_of: datetime.date) -> DataFrame:
    cutoff = batch_value(db, "income")
    # visits are summed per session before anything else is joined
    s = db.session.where(F.col("session_date") >= cutoff)
    keys = s.select(F.col("id").alias("session_id"))
    sums = (db.visit.select("session_id", "charge", "client_paid", "insurance_paid")
            .join(keys, "session_id", "left_semi").groupBy("session_id")
            .agg(F.count(F.lit(1)).alias("attend_n"),
                 billing.total(F.col("charge")).alias("charge"),
                 billing.total(F.col("insurance_paid")).alias("ins_pd"),
                 billing.total(F.col("client_paid")).alias("client_pd")))
    g = db.group.select(F.col("id").alias("group_id"), F.col("name").alias("gp_name"))
    t = db.therapist.select(F.col("id").alias("therapist_id"), F.col("name").alias("th_name"))
    d = F.col("session_date")
    return (sums.join(s, F.col("session_id") == F.col("id")).join(g, "group_id")
            .join(t, "therapist_id")
            .select(F.year(d).alias("sn_year"), F.month(d).alias("sn_month"),
                    dates.month_name(d).alias("sn_month_name"), "id",
                    dates.formatted(d, "%b %d").alias("short_date"), "session_date",
                    "gp_name", F.col("therapist_id").alias("th_id"), "th_name",
                    "attend_n", "charge", "ins_pd", "client_pd"))


def recent_sessions(db: Practice, as_of: datetime.date) -> DataFrame:
    s = db.session.select(F.col("id").alias("_session"), "time")
    t = db.therapist.select(F.col("id").alias("therapist_id"),
                            F.col("name").alias("therapist_name"))
    a = attendance_all(db).where(dates.within_days(F.col("session_date"), as_of, 30))
    return (a.join(s, F.col("session_id") == F.col("_session")).drop("_session")
            .join(t, "therapist_id", "left").select(*a.columns, "time", "therapist_name"))


def weekly_groups(db: Practice, as_of: datetime.date) -> DataFrame:
    s = (db.session.where(dates.at_most_days_old(F.col("session_date"), as_of, 10))
         .withColumnRenamed("id", "session_id"))
    th = db.therapist.select(F.col("id").alias("therapist_id"),
                             F.col("name").alias("therapist_name"))
    g = db.group.select(F.col("id").alias("group_id"), F.col("name").alias("group_name"))
    c = db.client.select(F.col("id").alias("client_id"), F.col("name").alias("client_name"))
    v = db.visit.select("id", "session_id", "client_id", "charge", "client_paid", "note")
    return (v.join(s.join(th, "therapist_id").join(g, "group_id"), "session_id")
            .join(c, "client_id")
            .select(dates.formatted(F.col("session_date"), "%W, %M %d, %Y").alias("session_day"),
                    "session_date", "group_name",
                    F.coalesce("time", F.lit("time?")).alias("time"), "therapist_name",
                    "charge", "client_paid", "note", "client_name", "session_id", "group_id",
                    "id", F.col("time").alias("session_time")))


# ---- last 30 days --------------------------------------------------------------------

# --- fixed values: group names that are courses, not treatment -----------------
COURSE_PATTERNS = ["%Education%", "Substance Abuse Ed%", "Financial Crimes Ed%", "CWIP%"]


def _treated_lately(db: Practice, as_of: datetime.date) -> DataFrame:
    treatment = F.col("evaluation") == 0
    for pattern in COURSE_PATTERNS:
        treatment = treatment & ~F.col("name").ilike(pattern)
    g = db.group.where(treatment).select(F.col("id").alias("group_id"))
    return (attendance(db).where(dates.within_days(F.col("session_date"), as_of, 30))
            .select("group_id", "group_name", "client_id", "client_name")
            .join(g, "group_id", "left_semi").distinct())


def _client_sums(db: Practice) -> DataFrame:
    return db.client.select(F.col("id").alias("client_id"), "recent", "charges", "client_paid",
                            "insurance_paid", "balance", "officer_id", "officer2_id")


def last_30(db: Practice, as_of: datetime.date) -> DataFrame:
    o = db.officer.select(F.col("id").alias("officer_id"), F.col("name").alias("_o"))
    o2 = db.officer.select(F.col("id").alias("officer2_id"), F.col("name").alias("_o2"))
    lately = discharges(db).where(dates.within_days(F.col("discharge_date"), as_of, 30))
    return (_treated_lately(db, as_of).join(_client_sums(db), "client_id")
            .join(o, "officer_id", "left").join(o2, "officer2_id", "left")
            .join(lately, ["group_id", "client_id"], "left")
            .select("group_id", "group_name", "client_id", "client_name", "recent", "charges",
                    "client_paid", "insurance_paid", "balance",
                    billing.both_names(F.col("_o"), F.col("_o2")).alias("officer_names"),
                    "discharge_date", "discharge_status"))


def last_30_blank(db: Practice, as_of: datetime.date) -> DataFrame:
    o = db.officer.select(F.col("id").alias("officer_id"), F.col("name").alias("officer_name"))
    return (_treated_lately(db, as_of).join(_client_sums(db), "client_id")
            .join(o, "officer_id", "left")
            .select("group_id", "group_name", "client_id", "client_name", "recent", "charges",
                    "client_paid", "insurance_paid", "balance", "officer_name"))


# ---- invoices ------------------------------------------------------------------------

def invoice_summary(db: Practice, as_of: datetime.date,
                    client_id: int | None = None) -> DataFrame:
    """The heading of a client's invoice (of everybody's, when no client is given)."""
    c = db.client if client_id is None else db.client.where(F.col("id") == client_id)
    money = ["charges", "client_paid", "insurance_paid", "balance"]
    return c.select(F.col("id").alias("client_id"), "name",
                    *[billing.money_commas(F.col(m)).alias(m) for m in money],
                    dates.day(as_of).alias("invoice_date"), "invoice_note")


def invoice_lines(db: Practice, client_id: int | None = None) -> DataFrame:
    """The attended visits on an invoice."""
    a = attendance(db).where("attend_n != 0")
    return (a if client_id is None else a.where(F.col("client_id") == client_id)).select(
        "client_id", "id", *DETAIL)


def invoice_batch(db: Practice, as_of: datetime.date) -> DataFrame:
    """All bulk invoices, one row per attended visit; one join instead of a query per
    client. A client without any has one row with an empty line."""
    # balances are asked for three times, here and below, and made once
    db = db.replaced(client=kept(db.client))
    due_now = bulk_invoices(db).select("client_id")
    c = (db.client.join(due_now, F.col("id") == F.col("client_id"), "left_semi")
         .select(F.col("id").alias("client_id"), "name", F.col("charges").alias("total_charges"),
                 F.col("client_paid").alias("total_client_paid"),
                 F.col("insurance_paid").alias("total_insurance_paid"), "balance",
                 dates.day(as_of).alias("invoice_date"), "invoice_note"))
    # only the visits of those clients meet the dimensions
    visits = db.visit.where("attend_n != 0").join(due_now, "client_id", "left_semi").select(db.visit.columns)
    lines = attendance(db.replaced(visit=visits)).select("client_id", "id", *DETAIL)
    return c.join(lines, "client_id", "left")


# ---- visit lists and checks ----------------------------------------------------------

def visit_list(db: Practice, as_of: datetime.date) -> DataFrame:
    lead = ["session_date", "group_id", "group_name", "carrier_name", "ins_status", "due"]
    return visit_details(db).select(*lead, *db.visit.columns)


def _held_visits(db: Practice) -> DataFrame:
    s = db.session.select(F.col("id").alias("session_id"), "session_date", "group_id")
    return db.visit.join(s, "session_id")


def _smoke(db: Practice, held: DataFrame | None = None) -> DataFrame:
    held = _held_visits(db) if held is None else held
    g = db.group.select(F.col("id").alias("group_id"), F.col("name").alias("group_name"))
    c = db.client.select(F.col("id").alias("client_id"), F.col("name").alias("client_name"))
    due = billing.due(F.col("charge"), F.col("client_paid"), F.col("insurance_paid"))
    return held.withColumn("due", due).join(g, "group_id").join(c, "client_id")


def smoke_detail(db: Practice, as_of: datetime.date) -> DataFrame:
    """Visits with the difference between the due amount they carry and the one computed
    anew, which must be 0."""
    again = F.col("charge") - F.col("client_paid") - billing.zero_if_null(F.col("insurance_paid"))
    return _smoke(db).select(
        "id", "group_name", "client_name",
        dates.formatted(F.col("session_date"), "%b %d '%y").alias("session"),
        "attend_n", "charge", "client_paid", "insurance_paid", "due",
        (F.col("due") - again).cast("decimal(10,2)").alias("delta"))


def group_client_sums(db: Practice, held: DataFrame | None = None) -> DataFrame:
    """Totals per group and client. Visits are summed before names are looked up."""
    held = _held_visits(db) if held is None else held
    g = db.group.select(F.col("id").alias("group_id"), F.col("name").alias("group_name"))
    c = db.client.select(F.col("id").alias("client_id"), F.col("name").alias("client_name"))
    paid = billing.zero_if_null(F.col("insurance_paid"))
    sums = (held.groupBy("group_id", "client_id")
            .agg(F.min("session_date").alias("first"), F.max("session_date").alias("last"),
                 F.sum("attend_n").alias("attend_n"),
                 billing.total(F.col("charge")).alias("charges"),
                 billing.total(F.col("client_paid")).alias("client_paid"),
                 billing.total(paid).alias("insurance_paid"),
                 billing.total(billing.due(F.col("charge"), F.col("client_paid"),
                                           F.col("insurance_paid"))).alias("due")))
    return sums.join(g, "group_id").join(c, "client_id")


def smoke_totals(db: Practice, as_of: datetime.date) -> DataFrame:
    short = "%b %d '%y"
    return group_client_sums(db).select(
        "group_id", "client_id", "group_name", "client_name",
        dates.formatted(F.col("first"), short).alias("start_day"),
        dates.formatted(F.col("last"), short).alias("end_day"),
        "attend_n", "charges", "client_paid", "insurance_paid", "due")


def smoke_totals_undated(db: Practice, as_of: datetime.date) -> DataFrame:
    # the two keys are in the list, so no two rows are equal and "distinct" has no work
    return group_client_sums(db).select("group_id", "group_name", "client_id", "client_name",
                                        "attend_n", "charges", "client_paid",
                                        "insurance_paid", "due")


def smoke_amount_due(db: Practice, as_of: datetime.date) -> DataFrame:
    """Amount due per client over all visits; insurance payments are null when none was
    ever entered."""
    s = db.session.select(F.col("id").alias("session_id"), "session_date")
    c = db.client.select(F.col("id").alias("client_id"), F.col("name").alias("client"))
    sums = (db.visit.join(s, "session_id").groupBy("client_id")
            .agg(F.min("session_date").alias("earliest"), F.max("session_date").alias("latest"),
                 billing.total(F.col("charge")).alias("charges"),
                 billing.total(F.col("client_paid")).alias("client_pd"),
                 billing.total(F.col("insurance_paid")).alias("ins_pd"),
                 billing.total(billing.due(F.col("charge"), F.col("client_paid"),
                                           F.col("insurance_paid"))).alias("due")))
    return sums.join(c, "client_id").select("client_id", "earliest", "latest", "client",
                                            "charges", "client_pd", "ins_pd", "due")


def stored_due_differences(db: Practice, as_of: datetime.date) -> DataFrame:
    """Cached balances that are not what the visits add up to."""
    again = client_balances(db).select("client_id", F.col("balance").alias("recomputed"))
    c = db.client.where(F.col("balance").isNotNull())
    return (c.join(again, F.col("id") == F.col("client_id"), "left")
            .select("id", "name", "balance", "recomputed",
                    (F.col("balance") - F.coalesce("recomputed", F.lit(0).cast("decimal(18,2)")))
                    .cast("decimal(18,2)").alias("delta"))
            .where("delta != 0"))


def clients_without_visits(db: Practice, as_of: datetime.date) -> DataFrame:
    v = db.visit.select("client_id")
    c = db.client.select("id", "name")
    return c.join(v, F.col("id") == F.col("client_id"), "left_anti")


def charge_not_rate(db: Practice, as_of: datetime.date) -> DataFrame:
    return attendance(db).where("attend_n != 0 and charge != group_rate")


def visits_per_session(db: Practice, as_of: datetime.date) -> DataFrame:
    visits = db.visit.agg(F.count(F.lit(1))).scalar()
    return db.session.agg(F.count(F.lit(1)).alias("sessions")).select(
        visits.alias("visits"), "sessions",
        F.round(visits.cast("double") / F.col("sessions"), 4).alias("ratio"))


def periods(db: Practice, as_of: datetime.date) -> DataFrame:
    """Calendar months of the years in which sessions were held."""
    span = db.session.agg(F.min("session_date").alias("a"), F.max("session_date").alias("b"))
    first = F.explode(F.sequence(F.trunc("a", "year"), F.trunc("b", "year") + F.expr(
        "interval 11 months"), F.expr("interval 1 month")))
    month = F.month("first")
    return span.select(first.alias("first")).select(
        F.year("first").alias("year"), month.alias("month"),
        F.ceil(month / 3).cast("int").alias("quarter"),
        F.ceil(month / 6).cast("int").alias("half"), F.to_date("first").alias("first"))


def three_levels(db: Practice, as_of: datetime.date) -> DataFrame:
    """Groups, their clients with totals, and the visits, as rows of three kinds. Nothing
    is nested: a client's visits stay as many rows."""
    # read for the sums and for the visits
    held = kept(_held_visits(db).select(
        "id", "client_id", "group_id", "session_date", "attend_n", "charge", "client_paid", "insurance_paid"))
    sums = group_client_sums(db, held)
    none = F.lit(None)
    group_rows = db.group.select(
        F.lit(1).alias("level"), F.col("id").alias("group_id"), F.col("name").alias("group_name"),
        none.cast("bigint").alias("client_id"), none.cast("string").alias("client_name"),
        none.cast("string").alias("visit_id"), none.cast("string").alias("session"),
        none.cast("bigint").alias("attend_n"),
        *[none.cast("decimal(18,2)").alias(c)
          for c in ("charge", "client_paid", "insurance_paid", "due")])
    client_rows = sums.select(
        F.lit(2).alias("level"), "group_id", "group_name", "client_id", "client_name",
        none.cast("string").alias("visit_id"), none.cast("string").alias("session"), "attend_n",
        F.col("charges").alias("charge"), "client_paid", "insurance_paid", "due")
    visit_rows = _smoke(db, held).select(
        F.lit(3).alias("level"), "group_id", "group_name", "client_id", "client_name",
        F.col("id").alias("visit_id"),
        dates.formatted(F.col("session_date"), "%b %d '%y").alias("session"),
        F.col("attend_n").cast("bigint").alias("attend_n"),
        *[F.col(c).cast("decimal(18,2)").alias(c)
          for c in ("charge", "client_paid", "insurance_paid", "due")])
    return group_rows.unionByName(client_rows).unionByName(visit_rows)


def group_client_rollup(db: Practice, as_of: datetime.date) -> DataFrame:
    """Totals per group and client, per group, and over all."""
    s = db.session.select(F.col("id").alias("session_id"), "group_id")
    due = billing.due(F.col("charge"), F.col("client_paid"), F.col("insurance_paid"))
    return (db.visit.join(s, "session_id").rollup("group_id", "client_id")
            .agg(F.grouping_id().cast("int").alias("grouping"),
                 F.count(F.lit(1)).alias("visits"), F.sum("attend_n").alias("attend_n"),
                 billing.total(F.col("charge")).alias("charges"),
                 billing.total(due).alias("due")))


# ---- registry ------------------------------------------------------------------------

Builder = Callable[[Practice, datetime.date], DataFrame]

# name -> (builder, print order)
REPORTS: dict[str, tuple[Builder, list[tuple[str, str]]]] = {
    "group_attendance_trend": (group_attendance_trend,
                               [("year", "desc"), ("quarter", "desc"), ("group_name", "asc"),
                                ("group_id", "asc")]),
    "amount_due": (amount_due, [("balance", "desc"), ("name", "asc"), ("id", "asc")]),
    "amount_due_by_name": (amount_due, [("name", "asc"), ("id", "asc")]),
    "attendance_by_client": (attendance_by_client,
                             [("client_name", "asc"), ("group_name", "asc"),
                              ("session_date", "asc"), ("id", "asc"),
                              ("discharge_date", "asc")]),
    "attendance_by_group": (attendance_by_group,
                            [("group_name", "asc"), ("client_name", "asc"),
                             ("session_date", "asc"), ("id", "asc")]),
    "billing_insurance": (billing_insurance,
                          [("client_name", "asc"), ("client_id", "asc"),
                           ("session_date", "desc"), ("group_name", "asc"),
                           ("group_id", "asc"), ("id", "asc")]),
    "cwip": (cwip, [("client_name", "asc"), ("client_id", "asc"), ("session_date", "asc"),
                    ("id", "asc")]),
    "dup_clients": (dup_clients, [("client_name", "asc"), ("client_id", "asc"),
                                  ("group_name", "asc"), ("session_date", "desc"),
                                  ("id", "asc")]),
    "evaluations": (evaluations, [("group_name", "asc"), ("session_date", "desc"),
                                  ("client_name", "asc"), ("id", "asc")]),
    "income_by_therapist": (income_by_therapist,
                            [("sn_year", "desc"), ("sn_month", "desc"), ("th_name", "asc"),
                             ("gp_name", "asc"), ("session_date", "asc"), ("id", "asc")]),
    "ins_summary": (ins_summary, [("client_name", "asc"), ("client_id", "asc")]),
    "last_30": (last_30, [("group_name", "asc"), ("client_name", "asc"), ("group_id", "asc"),
                          ("client_id", "asc"), ("discharge_date", "asc")]),
    "last_30_blank": (last_30_blank, [("group_name", "asc"), ("client_name", "asc"),
                                      ("group_id", "asc"), ("client_id", "asc")]),
    "monitoring": (monitoring, [("client_name", "asc"), ("client_id", "asc"),
                                ("session_date", "desc"), ("id", "asc")]),
    "recent_sessions": (recent_sessions, [("session_date", "desc"), ("group_id", "asc"),
                                          ("client_name", "asc"), ("client_id", "asc"),
                                          ("id", "asc")]),
    "reduced_balances": (reduced_balances, [("client_name", "asc"), ("client_id", "asc")]),
    "voucher_clients": (voucher_clients, [("client_name", "asc"), ("group_name", "asc"),
                                          ("session_date", "asc"), ("id", "asc")]),
    "weekly_groups": (weekly_groups, [("session_date", "desc"), ("group_name", "asc"),
                                      ("session_time", "asc"), ("client_name", "asc"), ("id", "asc")]),
    "invoice_batch": (invoice_batch, [("balance", "desc"), ("client_id", "asc"),
                                      ("session_date", "asc"), ("id", "asc")]),
    "visit_list": (visit_list, [("session_date", "desc"), ("id", "asc")]),
    "smoke_detail": (smoke_detail, [("group_name", "asc"), ("client_name", "asc"),
                                    ("id", "asc")]),
    "smoke_totals": (smoke_totals, [("group_name", "asc"), ("client_name", "asc"),
                                    ("group_id", "asc"), ("client_id", "asc")]),
    "smoke_totals_undated": (smoke_totals_undated,
                             [("group_name", "asc"), ("client_name", "asc"),
                              ("group_id", "asc"), ("client_id", "asc")]),
    "smoke_amount_due": (smoke_amount_due, [("due", "desc"), ("client_id", "asc")]),
    "stored_due_differences": (stored_due_differences, [("id", "asc")]),
    "therapist_sessions": (lambda db, as_of: therapist_sessions(db), [("id", "asc")]),
    "clients_without_visits": (clients_without_visits, [("id", "asc")]),
    "charge_not_rate": (charge_not_rate, [("session_date", "asc"), ("id", "asc")]),
    "visits_per_session": (visits_per_session, []),
    "periods": (periods, [("first", "asc")]),
    "three_levels": (three_levels, [("group_name", "asc"), ("group_id", "asc"),
                                    ("client_name", "asc"), ("client_id", "asc"),
                                    ("level", "asc"), ("visit_id", "asc")]),
    "group_client_rollup": (group_client_rollup, [("group_id", "asc"), ("client_id", "asc")]),
}


def report(db: Practice, name: str, as_of: datetime.date) -> DataFrame:
    """Rows of a named report. An unknown name is a ``KeyError``."""
    return REPORTS[name][0](db, as_of)


def printed_report(db: Practice, name: str, as_of: datetime.date) -> DataFrame:
    """The report in its print order: a range-partitioned sort whose last key is unique,
    so equal names spread over partitions."""
    return report(db, name, as_of).orderBy(*ordering(REPORTS[name][1]))


def _spec(name: str, levels: list[Level], part: list[str],
          sums: tuple[str, ...] = ()) -> BreakSpec:
    return BreakSpec(levels, part, REPORTS[name][1], sums)


PER_CLIENT, PER_GROUP = Level("client", ["client_id"]), Level("group", ["group_id"])

BREAKS: dict[str, BreakSpec] = {
    "attendance_by_client": _spec(
        "attendance_by_client", [PER_CLIENT, PER_GROUP], ["client_name"], MONEY_SUMS),
    "attendance_by_group": _spec(
        "attendance_by_group", [PER_GROUP, PER_CLIENT], ["group_name"], MONEY_SUMS),
    "billing_insurance": _spec(
        "billing_insurance", [PER_CLIENT], ["client_name", "client_id"], MONEY_SUMS),
    "cwip": _spec("cwip", [PER_CLIENT], ["client_name", "client_id"], ("due",)),
    "dup_clients": _spec(
        "dup_clients", [PER_CLIENT, PER_GROUP], ["client_name", "client_id"], MONEY_SUMS),
    "evaluations": _spec("evaluations", [PER_GROUP], ["group_name"]),
    "income_by_therapist": _spec(
        "income_by_therapist", [Level("therapist", ["sn_month", "sn_year", "th_id"])],
        ["sn_year", "sn_month", "th_name"], ("attend_n", "charge", "ins_pd", "client_pd")),
    "last_30": _spec("last_30", [PER_GROUP], ["group_name"]),
    "last_30_blank": _spec("last_30_blank", [PER_GROUP], ["group_name"]),
    "monitoring": _spec("monitoring", [PER_CLIENT], ["client_name", "client_id"],
                        ("attend_n", "charge", "client_paid", "due")),
    "recent_sessions": _spec("recent_sessions", [Level("session", ["session_id"])],
                             ["session_date", "group_id"], ("attend_n", "charge", "client_paid")),
    "voucher_clients": _spec("voucher_clients", [PER_CLIENT, PER_GROUP], ["client_name"],
                             ("attend_n", "charge", "client_paid", "due")),
    "weekly_groups": _spec(
        "weekly_groups", [Level("day", ["session_date"]), PER_GROUP,
                          Level("session", ["session_id"])], ["session_date"]),
}


# ---- headings and footers of a named report ------------------------------------------

def report_with_breaks(db: Practice, name: str, as_of: datetime.date,
                       ranges: int | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Rows of a report (of its columns those of ``keep``, where given) with its run numbers, heading levels
    and ends."""
    return with_breaks(report(db, name, as_of), BREAKS[name], ranges, keep)


def report_footers(db: Practice, name: str, as_of: datetime.date, level: str,
                   scope: str = "level", ranges: int | None = None) -> DataFrame:
    """A report's subtotals, one row per run."""
    return subtotals(report(db, name, as_of), BREAKS[name], level, scope, ranges)
