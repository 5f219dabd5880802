"""Named views over the practice's tables. Each is a function ``DataFrame(s) -> DataFrame``;
Catalyst inlines it into whatever is built on top. None of them sorts: order belongs to
the report that prints."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.functions import billing, dates
from tallywork.operators.joins import scalar, since
from tallywork.practice import Practice


def visit_details(db: Practice) -> DataFrame:
    """Every visit with its session, group, client, policy, amount due and billing state,
    and the visit's discharge state."""
    v, s, g, c = (db[t].alias(t[0]) for t in ("visit", "session", "group", "client"))
    o, i, co = db.officer.alias("o"), db.insurance.alias("i"), db.carrier.alias("co")
    p = db.procedure.select(F.col("cpt").alias("priced_cpt"))
    return (
        v.join(s, F.col("v.session_id") == F.col("s.id"))
        .join(g, F.col("s.group_id") == F.col("g.id"))
        .join(c, F.col("v.client_id") == F.col("c.id"))
        .join(o, F.col("c.officer_id") == F.col("o.id"), "left")
        .join(i, F.col("i.client_id") == F.col("c.id"), "left")
        .join(co, F.col("i.carrier_id") == F.col("co.id"), "left")
        .join(p, F.col("priced_cpt") == F.col("v.cpt"), "left")
        .select(
            "v.id",
            F.col("g.id").alias("group_id"), F.col("g.name").alias("group_name"),
            F.col("g.rate").alias("group_rate"),
            F.col("c.id").alias("client_id"), F.col("c.name").alias("client_name"),
            "c.billing_cutoff", "c.recent", "c.voucher", "c.voucher_note", "c.insurance",
            F.col("i.id").alias("policy_id"), "i.dx1", "i.dx2",
            F.col("co.id").alias("carrier_id"), F.col("co.name").alias("carrier_name"),
            F.col("o.name").alias("officer_name"),
            F.col("s.id").alias("session_id"), "s.therapist_id", "s.session_date",
            "v.attend_n", "v.charge", "v.client_paid", "v.claim_uid", "v.insurance_paid",
            "v.bill_date", "v.check_date", "v.note",
            billing.due(F.col("v.charge"), F.col("v.client_paid"),
                        F.col("v.insurance_paid")).alias("due"),
            "v.cpt",
            billing.billing_status(
                F.col("v.check_date"), F.col("v.bill_date"), F.col("i.id"),
                F.col("priced_cpt"), F.col("v.attend_n")).alias("ins_status"),
            "v.discharge_status"))


def attendance_all(db: Practice) -> DataFrame:
    return visit_details(db).drop("discharge_status")


def batch_value(db: Practice, name: str, column: str = "cutoff") -> F.Column:
    return scalar(db.batch.where(F.col("name") == name).select(column))


def attendance(db: Practice) -> DataFrame:
    """Visits that can still be billed: within the client's billing period, of clients
    seen since the current cutoff."""
    return attendance_all(db).where(
        (F.col("session_date") >= F.col("billing_cutoff"))
        & (F.col("recent") >= batch_value(db, "current")))


def dated_visits(db: Practice) -> DataFrame:
    """Visit money with its date. The slim join for aggregates: none of the other tables
    can add or drop a visit, so none is read."""
    s = db.session.select(F.col("id").alias("session_id"), "session_date")
    return db.visit.select("client_id", "session_id", "charge", "client_paid",
                           "insurance_paid").join(s, "session_id")


def balance_sums() -> list[F.Column]:
    paid_by_insurance = billing.zero_if_null(F.col("insurance_paid"))
    return [
        F.min("session_date").alias("oldest_session_date"),
        F.max("session_date").alias("recent"),
        billing.total(F.col("charge")).alias("charges"),
        billing.total(F.col("client_paid")).alias("client_paid"),
        billing.total(paid_by_insurance).alias("insurance_paid"),
        billing.total(billing.due(F.col("charge"), F.col("client_paid"),
                                  F.col("insurance_paid"))).alias("balance")]


def client_balances(db: Practice) -> DataFrame:
    """Per client, over the visits on or after the client's billing cutoff (none when the
    cutoff is null)."""
    c = db.client.select(F.col("id").alias("client_id"), "billing_cutoff")
    return (dated_visits(db).join(c, "client_id")
            .where(F.col("session_date") >= F.col("billing_cutoff"))
            .groupBy("client_id").agg(*balance_sums()))


def group_attendance_trend(db: Practice, as_of: datetime.date) -> DataFrame:
    """Attended visits per year, block of 13 weeks and group, over the last four years."""
    recent = db.session.where(dates.younger_than_days(F.col("session_date"), as_of, 4 * 365))
    s = recent.select(F.col("id").alias("session_id"), "group_id", "session_date")
    g = db.group.select(F.col("id").alias("group_id"), F.col("name").alias("group_name"))
    per_group = (db.visit.where("attend_n = 1").select("session_id").join(s, "session_id")
                 .groupBy(F.year("session_date").alias("year"),
                          dates.quarter_block(F.col("session_date")).alias("quarter"),
                          "group_id")
                 .agg(F.count(F.lit(1)).alias("visits")))
    return per_group.join(g, "group_id").select("year", "quarter", "group_id", "group_name",
                                                "visits")


def batch_clients(db: Practice) -> DataFrame:
    """Each billing batch with the clients seen since its cutoff."""
    b = db.batch.select(F.col("name").alias("batch_name"), "cutoff", "invoice_threshold")
    c = db.client.select(F.col("id").alias("client_id"), "recent")
    return since(c, "recent", b, "cutoff").select("batch_name", "invoice_threshold", "client_id")


def client_with_batch(db: Practice) -> DataFrame:
    b = batch_clients(db).select(F.col("client_id").alias("_id"), "batch_name")
    return db.client.join(b, F.col("id") == F.col("_id"), "left").drop("_id")


def bulk_invoices(db: Practice) -> DataFrame:
    """Clients of the current batch who owe more than its threshold."""
    current = db.batch.where("name = 'current'").select("cutoff", "invoice_threshold")
    c = db.client.select(F.col("id").alias("client_id"), "name", "balance", "recent")
    owing = since(c, "recent", current, "cutoff", lambda b: F.col("balance") > b["invoice_threshold"])
    return owing.select(*c.columns)


# name -> builder(db, as_of)
VIEWS: dict[str, Callable[[Practice, datetime.date], DataFrame]] = {
    "attendance_all": lambda db, as_of: attendance_all(db),
    "group_attendance_trend": group_attendance_trend,
    "client_balances": lambda db, as_of: client_balances(db),
    "batch_clients": lambda db, as_of: batch_clients(db),
    "bulk_invoices": lambda db, as_of: bulk_invoices(db),
    "attendance": lambda db, as_of: attendance(db),
}


def view(db: Practice, name: str, as_of: datetime.date) -> DataFrame:
    return VIEWS[name](db, as_of)


def register_views(spark: SparkSession, db: Practice, as_of: datetime.date) -> None:
    """Make tables and views known to ``spark.sql`` under their names."""
    for name, df in db.items():
        df.createOrReplaceTempView(name)
    for name in VIEWS:
        view(db, name, as_of).createOrReplaceTempView(name)
