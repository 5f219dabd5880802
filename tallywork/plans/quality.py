"""Quality rules as violation rows: (table_name, row_key, rule)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork import schema
from tallywork.functions.billing import text_key
from tallywork.practice import Practice


def row_rules(table: str) -> dict[str, Column]:
    """rule -> test that is true for a bad row; null never is."""
    rules: dict[str, Column] = {}
    for c in schema.REQUIRED.get(table, []):
        rules[f"{c} required"] = F.col(c).isNull()
    for c, texts in schema.ALLOWED.get(table, {}).items():
        rules[f"{c} allowed"] = ~F.col(c).isin(texts)
    for c in schema.FLAGS.get(table, []):
        rules[f"{c} 0 or 1"] = ~F.col(c).isin(0, 1)
    for c, most in schema.LENGTHS.get(table, {}).items():
        rules[f"{c} length"] = F.length(c) > most
    return rules


def _found(table: str, key: Column, rule: Column) -> list[Column]:
    return [F.lit(table).alias("table_name"), key.cast("string").alias("row_key"),
            rule.alias("rule")]


def bad_rows(db: Practice, table: str) -> DataFrame:
    """Rules on single rows and references to rows that are not there, in one pass over the table: each
    row carries the rules it fails through a chain of joins with the keys of its parents."""
    failed = F.array(*[F.when(test, F.lit(rule)) for rule, test in row_rules(table).items()])
    refs = [ref for ref in schema.REFERENCES if ref.child == table]
    checked = db[table].select(F.col(schema.KEYS[table]).alias("_key"), failed.alias("_failed"),
                               *[F.col(ref.column).alias(f"_ref{i}") for i, ref in enumerate(refs)])
    absent = []
    for i, ref in enumerate(refs):
        parent = db[ref.parent].select(F.col(schema.KEYS[ref.parent]).alias(f"_parent{i}")).distinct()
        checked = checked.join(parent, F.col(f"_ref{i}") == F.col(f"_parent{i}"), "left")
        lost = F.col(f"_ref{i}").isNotNull() & F.col(f"_parent{i}").isNull()
        absent.append(F.when(lost, F.lit(f"{ref.column} in {ref.parent}")))
    rules = F.concat("_failed", F.array(*absent).cast("array<string>"))
    return (checked.select("_key", F.explode(F.array_compact(rules)).alias("_rule"))
            .select(*_found(table, F.col("_key"), F.col("_rule"))))


def repeated(df: DataFrame, table: str) -> DataFrame:
    """Values of the table's unique columns and of its key that occur more than once: one grouped pass over
    (column, value)."""
    kinds = dict(df.dtypes)
    pairs = []
    for column in dict.fromkeys([*schema.UNIQUE.get(table, []), schema.KEYS[table]]):
        value = text_key(F.col(column)) if kinds[column] == "string" else F.col(column).cast("string")
        pairs.append(F.struct(F.lit(column).alias("column"), value.alias("value")))
    return (df.select(F.explode(F.array(*pairs)).alias("_at")).where("_at.value is not null")
            .groupBy("_at.column", "_at.value").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
            .select(*_found(table, F.col("value"), F.concat("column", F.lit(" unique")))))


def several_providers(db: Practice) -> DataFrame:
    """More than one provider with a tax id: every claim would be made once per provider."""
    n = db.therapist.where("tax_id is not null").agg(F.count(F.lit(1)).alias("n"))
    return n.where("n > 1").select(*_found("therapist", F.col("n"), F.lit("one tax_id")))


def several_discharges(db: Practice) -> DataFrame:
    """A client discharged more than once from a group: its report lines are multiplied."""
    s = db.session.select(F.col("id").alias("session_id"), "group_id")
    return (db.visit.where("discharge_status is not null").join(s, "session_id")
            .groupBy("client_id", "group_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            .select(*_found("visit", F.concat_ws(",", "client_id", "group_id"),
                            F.lit("one discharge per group"))))


def violations(db: Practice) -> DataFrame:
    parts = [bad_rows(db, t) for t in db]
    parts += [repeated(db[t], t) for t in db]
    parts += [several_providers(db), several_discharges(db)]
    return reduce(DataFrame.unionByName, parts)
