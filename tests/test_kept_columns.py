"""Only the columns that breaks and results need are sorted and written."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import rows
from test_numbering import data, spec
from tallywork.operators.breaks import subtotals, with_breaks, with_parity


@pytest.fixture()
def wide(spark):
    return data(spark, 9)[0].withColumn("note", F.concat(F.lit("note "), F.col("id").cast("string")))


def written(spark, df) -> set[str]:
    return set(spark.read.parquet(*df.inputFiles()).columns)


def test_footers_write_no_other_columns(spark, wide):
    footers = subtotals(wide, spec(), "client")
    assert "note" not in written(spark, footers)
    assert rows(footers) == rows(subtotals(wide.drop("note"), spec(), "client"))


def test_breaks_and_parity_of_chosen_columns(spark, wide):
    whole = with_breaks(wide, spec())
    chosen = with_breaks(wide, spec(), keep=["id", "name"])
    assert chosen.columns == ["id", "name", "run_client", "run_group", "start_level", "is_end"]
    assert "note" not in written(spark, chosen) and "amount" not in written(spark, chosen)
    assert rows(chosen) == rows(whole.select(chosen.columns))
    named = wide.fillna("z", ["name"])
    shaded = with_parity(named, spec(), keep=["id"])
    assert "note" not in written(spark, shaded)
    assert rows(shaded) == rows(with_parity(named, spec()).select("id", "parity"))
