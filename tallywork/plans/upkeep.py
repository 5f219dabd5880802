"""Table upkeep: each step is ``new version = f(old versions)``."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork import schema
from tallywork.functions import billing, dates
from tallywork.operators.joins import without_keys
from tallywork.operators.numbering import numbered
from tallywork.plans.views import balance_sums, batch_value, client_balances, dated_visits
from tallywork.practice import Practice

MONEY = "decimal(18,2)"
SUMS = ["charges", "client_paid", "insurance_paid", "balance"]


# ---- generic -------------------------------------------------------------------------

def update_from(old: DataFrame, key: str, changes: DataFrame, columns: Sequence[str],
                matched_only: bool = True) -> DataFrame:
    """``old`` with ``columns`` taken from ``changes`` (one row per key).

    ``matched_only``: rows without a change stay as they are; otherwise they get nulls.
    """
    new = changes.select(F.col(key).alias("_key"), F.lit(1).alias("_hit"),
                         *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = old.join(new, F.col(key) == F.col("_key"), "left")

    def value(c: str) -> Column:
        fresh = F.col(f"_new_{c}").cast(old.schema[c].dataType)
        return (F.when(F.col("_hit").isNotNull(), fresh).otherwise(F.col(c))
                if matched_only else fresh)

    return joined.select(*[value(c).alias(c) if c in columns else c for c in old.columns])


def replace_rows(old: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """Rows of ``rows`` instead of those of the same key, and in addition to the others."""
    return without_keys(old, key, rows, key).unionByName(rows)


def insert_absent(old: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """Only the rows whose key (as text compares here) is not there yet."""
    have = old.select(billing.text_key(F.col(key)).alias("_key"))
    fresh = (rows.withColumn("_mine", billing.text_key(F.col(key)))
             .join(have, F.col("_mine") == F.col("_key"), "left_anti").drop("_mine"))
    return old.unionByName(fresh, allowMissingColumns=True)


def with_new_ids(old: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ids that follow the largest one in ``old``, by ``order`` (unique)."""
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()
    return (numbered(rows, [], [F.col(order)], "_no")
            .withColumn("id", (F.col("_no") + top).cast("bigint")).drop("_no"))


def add_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Typed null columns for those the table does not have yet."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items()
                           if c.lower() not in have})


def stamp_inserted(rows: DataFrame, user: str, at: datetime.datetime) -> DataFrame:
    when = F.lit(str(at)).cast("timestamp")
    return add_columns(rows, schema.AUDIT).withColumns({
        "added_user": F.lit(user), "added_time": when,
        "modified_user": F.lit(user), "modified_time": when})


def stamp_updated(df: DataFrame, changed: Column, user: str, at: datetime.datetime) -> DataFrame:
    full = add_columns(df, schema.AUDIT)
    return full.withColumns({
        "modified_user": F.when(changed, F.lit(user)).otherwise(F.col("modified_user")),
        "modified_time": F.when(changed, F.lit(str(at)).cast("timestamp"))
                          .otherwise(F.col("modified_time"))})


# ---- visits --------------------------------------------------------------------------

def set_group_cpt(db: Practice) -> DataFrame:
    """Visits take the procedure code of their group, where the group has one."""
    s = db.session.select(F.col("id").alias("session_id"), "group_id")
    g = (db.group.where(billing.has_text(F.col("cpt")))
         .select(F.col("id").alias("group_id"), F.col("cpt").alias("_group_cpt")))
    v = db.visit
    return (v.join(s.join(g, "group_id"), "session_id", "left")
            .withColumn("cpt", F.coalesce("_group_cpt", "cpt")).select(*v.columns))


def new_visit_defaults(rows: DataFrame, db: Practice) -> DataFrame:
    """Visits as entered, what was left open filled in: attended, charged at the group's
    rate, with the group's procedure code."""
    s = db.session.select(F.col("id").alias("session_id"), "group_id")
    g = db.group.select(F.col("id").alias("group_id"), F.col("rate").alias("_rate"),
                        F.col("cpt").alias("_cpt"))
    return (rows.join(s.join(g, "group_id", "left"), "session_id", "left")
            .withColumns({"attend_n": F.coalesce("attend_n", F.lit(1)),
                          "charge": F.coalesce("charge", "_rate"),
                          "cpt": F.coalesce("cpt", "_cpt")})
            .select(*rows.columns))


def stamp_claims(visit: DataFrame, stamps: DataFrame) -> DataFrame:
    """``stamps``: (visit_id, claim_uid), one row per visit."""
    return update_from(visit, "id", stamps.withColumnRenamed("visit_id", "id"), ["claim_uid"])


# ---- balances ------------------------------------------------------------------------

def reset_balances(db: Practice) -> DataFrame:
    """Forget the cached sums; everybody's billing period starts with the first session."""
    earliest = db.session.agg(F.min("session_date")).scalar()
    blank = {c: F.lit(None).cast(MONEY) for c in SUMS}
    return db.client.withColumns({**blank, "balance_cached": F.lit(None).cast("timestamp"),
                                  "billing_cutoff": earliest})


def mark_dormant(db: Practice, dormant_before: datetime.date) -> DataFrame:
    """Note each client's last visit. Billing starts with the first visit, or, when the
    last one is too long ago, not at all. Clients without balances stay as they are."""
    limit = dates.day(dormant_before)
    cb = client_balances(db).select(
        F.col("client_id").alias("id"), "recent",
        F.when(F.col("recent") < limit, None).otherwise(F.col("oldest_session_date"))
         .alias("billing_cutoff"))
    return update_from(db.client, "id", cb, ["recent", "billing_cutoff"])


def refresh_balances(db: Practice, at: datetime.datetime, everybody: bool,
                     client_ids: Sequence[int] | None = None) -> DataFrame:
    """Cached sums from the visits.

    ``everybody``: clients without billable visits get nulls, last visit included;
    otherwise they keep what they had. ``client_ids`` limits the refresh to some clients
    (or, as everywhere, to none: an empty list is not "all").
    """
    cb = client_balances(db).withColumnRenamed("client_id", "id")
    cb = cb.withColumn("balance_cached", F.lit(str(at)).cast("timestamp"))
    columns = [*SUMS, "balance_cached"]
    if not everybody:
        return update_from(db.client, "id", cb, columns)
    fresh = update_from(db.client, "id", cb, ["recent", *columns], matched_only=False)
    fresh = fresh.withColumn("balance_cached", F.lit(str(at)).cast("timestamp"))
    if client_ids is None:
        return fresh
    # sums of the chosen clients only: the filter reaches both sides of the join
    chosen = F.col("id").isin(list(client_ids))
    return fresh.where(chosen).unionByName(db.client.where(~chosen))


def with_balances(db: Practice, dormant_before: datetime.date,
                  at: datetime.datetime) -> Practice:
    """The three steps reset, mark dormant, refresh, over one aggregation of the visits.

    After the reset every visit lies in its client's billing period, so the first
    balances are the sums of all visits; marking moves the start to the first of them or
    takes it away, so the second balances are the same sums, or none.
    """
    earliest = db.session.agg(F.min("session_date")).scalar()
    sums = dated_visits(db).groupBy("client_id").agg(*balance_sums())
    active = F.col("_s.recent") >= dates.day(dormant_before)
    c, s = db.client.alias("_c"), sums.alias("_s")
    joined = c.join(s, F.col("_c.id") == F.col("_s.client_id"), "left")
    fresh = {
        "recent": F.coalesce("_s.recent", "_c.recent"),
        "billing_cutoff": F.when(F.col("_s.client_id").isNull(), earliest)
                           .otherwise(F.when(active, F.col("_s.oldest_session_date"))),
        "balance_cached": F.when(active, F.lit(str(at)).cast("timestamp")),
        **{x: F.when(active, F.col(f"_s.{x}")) for x in SUMS}}
    return db.replaced(client=joined.select(*[
        fresh[x].alias(x) if x in fresh else F.col(f"_c.{x}") for x in db.client.columns]))


def visits_entered(db: Practice, entered: DataFrame) -> DataFrame:
    """Clients after ``entered`` (client_id, session_date) visits: a dormant client's
    billing starts again, and the last visit moves on. Several visits of one client count
    as entered in date order."""
    seen = (entered.groupBy(F.col("client_id").alias("id"))
            .agg(F.min("session_date").alias("_first"), F.max("session_date").alias("_last")))
    c = db.client
    return (c.join(seen, "id", "left")
            .withColumns({
                "billing_cutoff": F.coalesce("billing_cutoff", "_first"),
                "recent": F.when(F.col("_last").isNull(), F.col("recent")).otherwise(
                    dates.greatest_or_null(F.col("_last"), F.col("recent")))})
            .select(*c.columns))


# ---- other tables --------------------------------------------------------------------

def therapist_sessions(db: Practice) -> DataFrame:
    held = (db.session.where(F.col("therapist_id").isNotNull())
            .groupBy("therapist_id").agg(F.count(F.lit(1)).alias("weight")))
    return (db.therapist.drop("weight").join(held, F.col("id") == F.col("therapist_id"))
            .select("id", "name", "weight"))


def set_therapist_weight(db: Practice) -> DataFrame:
    return update_from(db.therapist, "id", therapist_sessions(db), ["weight"])


def set_batch(batch: DataFrame, name: str, cutoff: datetime.date,
              threshold: str | None = None) -> DataFrame:
    row = batch.sparkSession.range(1).select(
        F.lit(name).alias("name"), dates.day(cutoff).alias("cutoff"),
        F.lit(threshold).cast("decimal(12,2)").alias("invoice_threshold"))
    return replace_rows(batch, "name", row)


def before_current_cutoff(db: Practice) -> DataFrame:
    """Clients with a flag: the last visit is too old for current billing."""
    cutoff = batch_value(db, "current")
    return db.client.select(
        "id", "name", "recent", cutoff.alias("cutoff"),
        F.coalesce(F.col("recent").isNull() | (F.col("recent") < cutoff), F.lit(False))
         .cast("int").alias("is_old"))


def duplicate_names(db: Practice) -> DataFrame:
    return (db.client.groupBy(billing.text_key(F.col("name")).alias("name_key"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name"))
            .where("n > 1").select("name", "n"))


def merge_clients(db: Practice, chosen: DataFrame) -> Practice:
    """Give all visits of clients named like a chosen one (``id``) to it; delete the
    others, and with them their policies. Of two chosen clients of one name the first id
    is kept."""
    names = db.client.select("id", billing.text_key(F.col("name")).alias("_name"))
    kept = (names.join(chosen.select("id"), "id", "left_semi")
            .groupBy("_name").agg(F.min("id").alias("_kept")))
    mapping = (names.join(kept, "_name").where("id != _kept")
               .select(F.col("id").alias("_old"), "_kept"))
    v = db.visit
    moved = (v.join(mapping, F.col("client_id") == F.col("_old"), "left")
             .withColumn("client_id", F.coalesce("_kept", "client_id")).select(*v.columns))
    return delete_rows(db.replaced(visit=moved), "client", mapping.select("_old"))


def _downwards() -> list[str]:
    """The tables, each after those from which a delete can reach it."""
    left, out = list(schema.KEYS), []
    while left:
        free = [t for t in left if not any(
            r.child == t and r.on_delete == "cascade" and r.parent in left for r in schema.REFERENCES)]
        out += free
        left = [t for t in left if t not in free]
    return out


@dataclass(frozen=True)
class Deletion:
    """What deleting rows of ``table`` leads to: by table, the rows that would go (``key``) with the row
    whose deletion leads there (``root``), and the ``refusals``: the rows (``by_table``, ``by_key``) that
    still refer to such a one and do not allow it."""

    table: str
    reached: dict[str, DataFrame]
    refusals: DataFrame

    def allowed(self, table: str) -> DataFrame | None:
        """Keys of a table that do go: those of a root that nothing refuses."""
        rows = self.reached.get(table)
        if rows is None:
            return None
        return rows.join(self.refusals.select("root").distinct(), "root", "left_anti").select("key").distinct()


def deletion(db: Practice, table: str, keys: DataFrame) -> Deletion:
    """Follow the references down, one step a table: the frontier of a table is all rows that the tables
    above lead to. A reference that restricts refuses a row of its parent while any child that would
    not go with the same root refers to it, and so refuses the root that led there."""
    own = keys.select(F.col(keys.columns[0]).cast("string").alias("key")).distinct()
    start = db[table].select(F.col(schema.KEYS[table]).cast("string").alias("key")).join(own, "key", "left_semi")
    reached = {table: start.withColumn("root", F.col("key"))}
    refusals = None
    for name in _downwards():
        for ref in schema.REFERENCES:
            if ref.child == name and ref.on_delete == "cascade" and ref.parent in reached:
                led = reached[ref.parent].select(F.col("key").alias("_to"), "root")
                child = db[name].select(F.col(schema.KEYS[name]).cast("string").alias("key"),
                                        F.col(ref.column).cast("string").alias("_to"))
                found = child.join(led, "_to").select("key", "root")
                reached[name] = reached[name].unionByName(found) if name in reached else found
    for ref in schema.REFERENCES:
        if ref.on_delete == "restrict" and ref.parent in reached:
            led = reached[ref.parent].select(F.col("key").alias("row_key"), "root")
            child = db[ref.child].select(F.col(schema.KEYS[ref.child]).cast("string").alias("by_key"),
                                         F.col(ref.column).cast("string").alias("row_key"))
            using = child.join(led, "row_key")
            if ref.child in reached:
                going = reached[ref.child].select(F.col("key").alias("by_key"), "root")
                using = using.join(going, ["by_key", "root"], "left_anti")
            using = using.select("root", F.lit(ref.parent).alias("parent"), "row_key",
                                 F.lit(ref.child).alias("by_table"), F.lit(ref.column).alias("by_column"),
                                 "by_key")
            refusals = using if refusals is None else refusals.unionByName(using)
    if refusals is None:
        refusals = keys.sparkSession.createDataFrame(
            [], "root string, parent string, row_key string, by_table string, by_column string, by_key string")
    return Deletion(table, reached, refusals)


def delete_rows(db: Practice, table: str, keys: DataFrame) -> Practice:
    """Delete rows by key, and whatever a reference to them says: cascade, set null, or restrict, which
    keeps the row, and what its deletion would have led to (``refused_deletes`` lists them)."""
    plan = deletion(db, table, keys)
    out = db
    for name in plan.reached:
        gone = plan.allowed(name)
        for ref in schema.REFERENCES:
            if ref.parent == name and ref.on_delete == "set null":
                child = out[ref.child]
                joined = child.join(gone, F.col(ref.column).cast("string") == F.col("key"), "left")
                kept = F.when(F.col("key").isNull(), F.col(ref.column))
                out = out.replaced(**{ref.child: joined.withColumn(ref.column, kept).select(*child.columns)})
    for name in plan.reached:
        rows = out[name]
        left = rows.join(plan.allowed(name), F.col(schema.KEYS[name]).cast("string") == F.col("key"), "left_anti")
        out = out.replaced(**{name: left})
    return out


def refused_deletes(db: Practice, table: str, keys: DataFrame) -> DataFrame:
    """row_key (of ``table``), by_table, by_column, uses: why rows are not deleted."""
    return (deletion(db, table, keys).refusals.groupBy(F.col("root").alias("row_key"), "by_table", "by_column")
            .agg(F.count(F.lit(1)).alias("uses")))
