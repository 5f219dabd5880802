"""Cells to forms: the same rows from any order of cells, and nothing sorted before a form's cells are together."""

from __future__ import annotations

from tallywork.sources import form_cells


def cells(spark):
    at = {name: (row, col) for name, _, _, row, col in form_cells.CELLS}
    rows = [(1, *at["dob_y"], "80.0"), (1, *at["dob_y"], "81.0"), (1, 0, 0, "no such cell"), (2, 0, 0, "x"),
            (None, *at["x_male"], "X"), (3, *at["dx1"], None), (1, *at["dx1"], "305")]
    return spark.createDataFrame(rows, "form_id long, row int, col int, value string").repartition(3)


def test_forms_from_cells(spark):
    got = form_cells.read_forms(cells(spark))
    assert got.columns == ["form_id", *form_cells.NAMES]
    found = {r.form_id: {k: v for k, v in r.asDict().items() if v is not None and k != "form_id"}
             for r in got.collect()}
    assert found == {1: {"dob_y": "81.0", "dx1": "305"}, None: {"x_male": "X"}, 3: {}}


def test_cells_are_not_sorted_before_they_are_shuffled(spark):
    plan = form_cells.read_forms(cells(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" in plan
    assert "Aggregate" not in plan[plan.index("Exchange"):]
