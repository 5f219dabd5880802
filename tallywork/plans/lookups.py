"""Id and label lists for choosing records, related records, and facets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork import schema
from tallywork.functions import dates
from tallywork.operators.breaks import ordering
from tallywork.plans.views import (
    attendance,
    batch_clients,
    bulk_invoices,
    client_balances,
    group_attendance_trend,
)
from tallywork.practice import Practice


def _names(table: str) -> Callable[[Practice], DataFrame]:
    return lambda db: db[table].select(F.col("id").cast("string").alias("id"),
                                       F.col("name").alias("label"))


def _codes(table: str) -> Callable[[Practice], DataFrame]:
    key = schema.KEYS[table]
    return lambda db: db[table].select(F.col(key).alias("id"), F.col(key).alias("label"))


def _groups(db: Practice) -> DataFrame:
    label = F.concat("name", F.lit(" "), F.lit("$"), F.col("rate").cast("string"))
    return db.group.select(F.col("id").cast("string").alias("id"), label.alias("label"), "name")


def _sessions(db: Practice) -> DataFrame:
    g = db.group.select(F.col("id").alias("group_id"), "name")
    label = F.concat_ws(": ", "name", dates.formatted(F.col("session_date"), "%m/%d/%Y"))
    return db.session.join(g, "group_id").select(
        F.col("id").cast("string").alias("id"), label.alias("label"), "session_date", "name")


# name -> (list, order)
LOOKUPS: dict[str, tuple[Callable[[Practice], DataFrame], list[tuple[str, str]]]] = {
    "officers": (_names("officer"), [("label", "asc"), ("id", "asc")]),
    "offices": (_names("office"), [("label", "asc"), ("id", "asc")]),
    "clients": (_names("client"), [("label", "asc"), ("id", "asc")]),
    "carriers": (_names("carrier"), [("label", "asc"), ("id", "asc")]),
    "diagnoses": (_codes("diagnosis"), [("id", "asc")]),
    "procedures": (_codes("procedure"), [("id", "asc")]),
    "therapists": (lambda db: _names("therapist")(db).join(
        db.therapist.select(F.col("id").cast("string").alias("id"), "weight"), "id"),
        [("weight", "desc"), ("id", "asc")]),
    "groups": (_groups, [("name", "asc"), ("id", "asc")]),
    "sessions": (_sessions, [("session_date", "asc"), ("name", "asc"), ("id", "asc")]),
}


def lookup(db: Practice, name: str) -> DataFrame:
    """(id, label) in list order. An unknown name is a ``KeyError``."""
    build, order = LOOKUPS[name]
    return build(db).orderBy(*ordering(order)).select("id", "label")


def default_order(table: str, df: DataFrame) -> DataFrame:
    """A table in its usual order, if it has one; equal rows by key."""
    if table not in schema.DEFAULT_ORDER:
        return df
    return df.orderBy(*ordering([schema.DEFAULT_ORDER[table], (schema.KEYS[table], "asc")]))


# --- fixed values: (table, relation) -> how the related rows are found ----------
# source column, related table or view, its column
RELATIONS: dict[tuple[str, str], tuple[str, str, str]] = {
    ("attendance", "visit"): ("id", "visit", "id"),
    ("attendance", "client"): ("client_id", "client", "id"),
    ("attendance", "group"): ("group_id", "group", "id"),
    ("attendance", "session"): ("session_id", "session", "id"),
    ("bulk_invoices", "client"): ("client_id", "client", "id"),
    ("carrier", "policies"): ("id", "insurance", "carrier_id"),
    ("client", "insurance"): ("id", "insurance", "client_id"),
    ("client", "visits"): ("id", "attendance", "client_id"),
    ("client", "visits_all"): ("id", "visit", "client_id"),
    ("client", "officer"): ("officer_id", "officer", "id"),
    ("client", "lawyer"): ("lawyer_id", "officer", "id"),
    ("client", "court"): ("court_id", "office", "id"),
    ("client_balances", "client"): ("client_id", "client", "id"),
    ("client_balances", "visits"): ("client_id", "visit", "client_id"),
    ("group", "sessions"): ("id", "session", "group_id"),
    ("group", "attendance_trend"): ("id", "group_attendance_trend", "group_id"),
    ("group", "procedure"): ("cpt", "procedure", "cpt"),
    ("insurance", "client"): ("client_id", "client", "id"),
    ("insurance", "carrier"): ("carrier_id", "carrier", "id"),
    ("officer", "clients"): ("id", "client", "officer_id"),
    ("officer", "office"): ("office_id", "office", "id"),
    ("session", "group"): ("group_id", "group", "id"),
    ("session", "visits"): ("id", "visit", "session_id"),
    ("session", "therapist"): ("therapist_id", "therapist", "id"),
    ("therapist", "sessions"): ("id", "session", "therapist_id"),
    ("visit", "client"): ("client_id", "client", "id"),
    ("visit", "session"): ("session_id", "session", "id"),
}


def _frame(db: Practice, name: str, as_of) -> DataFrame:
    views = {"attendance": attendance, "bulk_invoices": bulk_invoices,
             "client_balances": client_balances, "batch_clients": batch_clients}
    if name == "group_attendance_trend":
        return group_attendance_trend(db, as_of)
    return views[name](db) if name in views else db[name]


def _key(table: str, df: DataFrame) -> str:
    return schema.KEYS.get(table, "id" if "id" in df.columns else "client_id")


def related(db: Practice, table: str, relation: str, as_of=None) -> DataFrame:
    """Rows related to each row of ``table``: its key as ``from_key``, and their columns."""
    column, other, other_column = RELATIONS[table, relation]
    start = _frame(db, table, as_of)
    key = _key(table, start)
    pairs = start.select(F.col(key).alias("from_key"), F.col(column).alias("_value"))
    there = _frame(db, other, as_of)
    return (pairs.join(there.withColumn("_there", F.col(other_column)),
                       F.col("_value") == F.col("_there"))
            .drop("_value", "_there"))


def related_counts(db: Practice, as_of=None,
                   kept: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """relation, from_key, n: how many related rows each record has, over all relations. Related rows are
    counted by their column before they are joined, so a record meets one row a relation, and a table's
    records are grouped once for all its relations. Most values have one related row: only those with none or
    several are joined to the records. ``kept`` may store a table; what it has stored Spark can broadcast."""
    tables = list(dict.fromkeys(t for t, _ in RELATIONS))
    views: dict[str, DataFrame] = {}

    def frame(name: str) -> DataFrame:
        if name not in db and name not in views:
            wanted = {x for (t, _), (column, other, there) in RELATIONS.items()
                      for x in ([column] if t == name else []) + ([there] if other == name else [])}
            found = _frame(db, name, as_of)
            if name in tables:
                wanted.add(_key(name, found))
            views[name] = kept(found.select(*sorted(wanted)), name)
        return views[name] if name in views else db[name]

    parts = None
    for table in tables:
        start, key = frame(table), _key(table, frame(table))
        relations = {r: x for (t, r), x in RELATIONS.items() if t == table}
        others = sorted({column for column, _, _ in relations.values() if column != key})
        rows = start.select(F.col(key).alias("from_key"), *(F.col(x).alias(f"to_{x}") for x in others))
        sums, last = [], []
        for relation, (column, other, there) in relations.items():
            to = "from_key" if column == key else f"to_{column}"
            count = (frame(other).where(F.col(there).isNotNull()).groupBy(F.col(there).alias(to))
                     .agg(F.count(F.lit(1)).alias(f"n_{relation}")))
            if column == key:
                last.append((relation, count))
            else:
                n = F.coalesce(f"n_{relation}", F.lit(0))
                other_than_one = kept(rows.select(to).distinct().where(F.col(to).isNotNull())
                                      .join(count, to, "left").select(to, n.alias(f"n_{relation}"))
                                      .where(F.col(f"n_{relation}") != 1), f"{table}-{relation}")
                n = F.when(F.col(to).isNotNull(), F.coalesce(f"n_{relation}", F.lit(1)))
                rows = rows.join(other_than_one, to, "left").withColumn(f"n_{relation}", n)
                sums.append(F.sum(f"n_{relation}").alias(f"n_{relation}"))
        rows = rows.groupBy("from_key").agg(F.count(F.lit(1)).alias("_rows"), *sums)
        for relation, count in last:
            rows = rows.join(count, "from_key", "left").withColumn(
                f"n_{relation}", F.col("_rows") * F.col(f"n_{relation}"))
        each = F.explode(F.array(*(F.struct(F.lit(f"{table}.{r}").alias("relation"), F.col(f"n_{r}").alias("n"))
                                   for r in relations)))
        one = (rows.select(F.col("from_key").cast("string").alias("from_key"), each.alias("_each"))
               .select("_each.relation", "from_key", "_each.n").where("n > 0"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def clients_of_batches(db: Practice) -> DataFrame:
    """Batches with their clients' rows, over the table that links the two."""
    links = batch_clients(db).select("batch_name", F.col("client_id").alias("_id"))
    batch = db.batch.select(F.col("name").alias("batch_name"), "cutoff")
    return (batch.join(links, "batch_name")
            .join(db.client.select("id", "name"), F.col("_id") == F.col("id")).drop("_id"))


def facet_values(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def facet(df: DataFrame, column: str, value: Column | str | int) -> DataFrame:
    return df.where(F.col(column) == value)
