"""File sinks and small file sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.functions.forms import field_number


def write_claims_csv(df: DataFrame, path: str, order: Sequence[Column] = ()) -> None:
    """Every field quoted, a heading in every part, missing values as empty text."""
    ordered = df.orderBy(*order) if order else df
    ordered.write.mode("errorifexists").csv(path, header=True, quoteAll=True, nullValue="",
                                            emptyValue="")


def write_flat_claims(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, header=True, nullValue="", emptyValue="")


def read_form_spec(spark: SparkSession, path: str) -> DataFrame:
    """The print specification of a form: (line, field_no, field, label, type, bytes,
    columns). Cells may hold line breaks, rows may be ragged, rows without columns are no
    fields."""
    raw = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
           .schema("line string, field string, literal string, field_type string, "
                   "bytes string, columns string, rest string")
           .csv(path))
    return raw.where("columns > ''").select(
        F.col("line").cast("int").alias("line"),
        field_number(F.coalesce("field", F.lit(""))).alias("field_no"),
        F.coalesce("field", F.lit("")).alias("field"), F.col("literal").alias("label"),
        F.col("field_type").alias("type"), F.col("bytes").cast("int").alias("bytes"),
        F.split("columns", "-").cast("array<int>").alias("columns"))


def lookup_lines(df: DataFrame, text: Column, aux: Column | None, value: Column) -> DataFrame:
    """``text aux|value``, one line per row, for an auto-completing input."""
    shown = text if aux is None else F.concat(
        F.coalesce(text, F.lit("")), F.lit(" "), F.coalesce(aux, F.lit("")))
    return df.select(F.concat(F.coalesce(shown, F.lit("")), F.lit("|"), value.cast("string"))
                     .alias("text"))
