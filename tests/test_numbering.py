"""Numbering and control breaks over ranges of the order, against a plain loop over the sorted rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallywork.operators.breaks import BreakSpec, subtotals, with_breaks, with_parity
from tallywork.operators.numbering import Level, _Scan, laid_out, numbered, runs

LEVELS = [Level("client", ["client_id"]), Level("group", ["group_id"])]


def data(spark, seed: int, n: int = 400):
    """Few names, several ids per name, one name with a third of the rows."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        name = "hot" if rnd.random() < 0.34 else rnd.choice(["a", "b", "c", None])
        out.append((name, rnd.choice([1, 2]), f"g{rnd.randrange(4)}", rnd.choice([1, 2, None]),
                    rnd.randrange(30), i, rnd.randrange(5)))
    kinds = "name string, client_id int, group_name string, group_id int, day int, id int, amount int"
    return spark.createDataFrame(out, kinds), out


def loop(rows):
    """id -> (run of client, run of group, level, is_end), as a report is printed: row by row."""
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[2], r[4], r[5]))
    out, last_name, prev = {}, object(), None
    runs_ = [0, 0]
    for k, r in enumerate(ordered):
        if r[0] != last_name:
            last_name, prev, runs_ = r[0], None, [0, 0]
        if prev is None:
            level = 0
        elif prev[1] != r[1]:
            level = 0
        elif prev[3] != r[3]:
            level = 1
        else:
            level = None
        if level is not None:
            for i in range(level, 2):
                runs_[i] += 1
        following = ordered[k + 1] if k + 1 < len(ordered) else None
        end = (following is None or following[0] != r[0] or following[1] != r[1]
               or following[3] != r[3])
        out[r[5]] = (runs_[0], runs_[1], level, end)
        prev = r
    return out


@pytest.mark.parametrize("ranges", [None, 1, 7, 150])
@pytest.mark.parametrize("seed", [1, 2])
def test_runs(spark, seed, ranges):
    df, rows = data(spark, seed)
    got = runs(df, LEVELS, [F.col("group_name"), F.col("day"), F.col("id")], ["name"], ranges)
    found = {r.id: (r.run_client, r.run_group, r.start_level, r.is_end) for r in got.collect()}
    assert found == loop(rows)


@pytest.mark.parametrize("ranges", [None, 1, 7, 150])
def test_numbered(spark, ranges):
    df, rows = data(spark, 3)
    got = numbered(df, ["name"], [F.col("day").desc(), F.col("id")], "no", ranges)
    found = {r.id: r.no for r in got.collect()}
    expected = {}
    for name in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == name), key=lambda r: (-r[4], r[5]))
        expected.update({r[5]: i for i, r in enumerate(mine, 1)})
    assert found == expected


def test_a_client_with_a_third_of_all_rows_lies_in_many_ranges(spark):
    df, rows = data(spark, 8, 3000)
    spread = laid_out(df, [F.col("name"), F.col("day"), F.col("id")], 12).withColumn(
        "range", F.shiftright("_place", 33))
    sizes = [r["count"] for r in spread.groupBy("range").count().collect()]
    hot = spread.where("name = 'hot'").select("range").distinct().count()
    assert hot >= 4 and max(sizes) < 2 * len(rows) / 12
    plan = numbered(df, ["name"], [F.col("day"), F.col("id")], "no", 12)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("ranges", [1, 5])
def test_no_rows_at_all(spark, ranges):
    df = data(spark, 1)[0].where("id < 0")
    assert runs(df, LEVELS, [F.col("id")], ["name"], ranges).collect() == []
    assert numbered(df, [], [F.col("id")], "no", ranges).columns == [*df.columns, "no"]


def test_numbered_over_all_rows(spark):
    df, rows = data(spark, 4)
    got = numbered(df, [], [F.col("day"), F.col("id")], "no")
    ordered = sorted(rows, key=lambda r: (r[4], r[5]))
    assert {r.id: r.no for r in got.collect()} == {r[5]: i for i, r in enumerate(ordered, 1)}


def spec():
    return BreakSpec(LEVELS, ["name"], [("name", "asc"), ("group_name", "asc"), ("day", "asc"),
                                        ("id", "asc")], ["amount"])


def test_subtotals_of_both_scopes(spark):
    df, rows = data(spark, 5)
    marks = loop(rows)
    for scope, at in (("any", 1), ("level", 0)):
        expected: dict = {}
        for r in rows:
            key = (r[0], marks[r[5]][at])
            n, total = expected.get(key, (0, 0))
            expected[key] = (n + 1, total + r[6])
        run = "run_group" if scope == "any" else "run_client"
        got = subtotals(df, spec(), "client", scope).collect()
        assert {(r["name"], r[run]): (r.n_rows, r.amount_sum) for r in got} == expected
    with pytest.raises(ValueError):
        subtotals(df, spec(), "client", "page")


def test_any_runs_refine_level_runs(spark):
    df, _ = data(spark, 6)
    cells = with_breaks(df, spec()).select("name", "run_client", "run_group").distinct()
    assert cells.groupBy("name", "run_group").count().where("count > 1").count() == 0


def test_parity_alternates_down_the_report(spark):
    df, rows = data(spark, 7, 60)
    got = with_parity(df.fillna("z", ["name"]), spec(), 9)
    ordered = sorted(rows, key=lambda r: (r[0] or "z", r[2], r[4], r[5]))
    assert {r.id: r.parity for r in got.collect()} == {r[5]: i % 2 for i, r in enumerate(ordered)}


def test_ranges_are_scanned_without_a_shuffle(spark):
    df, _ = data(spark, 7)
    local = _Scan(["name"], [["client_id"], None]).local(laid_out(df, [F.col("name"), F.col("id")], 12))
    assert "Exchange" not in local._jdf.queryExecution().executedPlan().toString()


def test_subtotals_of_names_that_are_one_client_are_summed_before_they_are_sorted(spark, monkeypatch):
    """Names of one client, names of two, a null name, null keys and amounts; sums as of the plain loop."""
    rnd = random.Random(8)
    rows = [(name, rnd.choice(ids), f"g{rnd.randrange(3)}", rnd.choice([1, None]), rnd.randrange(9), 10 * k + i,
             rnd.choice([None, 1, 2, 3]))
            for k, (name, ids) in enumerate([("a", [1]), ("b", [2, 3]), (None, [4]), ("d", [None]), ("e", [None, 5]),
                                             ("f", [6])])
            for i in range(8)]
    df = spark.createDataFrame(
        rows, "name string, client_id int, group_name string, group_id int, day int, id int, amount int")
    marks = loop(rows)
    expected: dict = {}
    for r in rows:
        n, total = expected.get((r[0], marks[r[5]][0], r[1]), (0, None))
        expected[r[0], marks[r[5]][0], r[1]] = (n + 1, total if r[6] is None else (total or 0) + r[6])
    sorted_rows = []
    monkeypatch.setattr("tallywork.operators.breaks.runs",
                        lambda df, *rest: sorted_rows.append(df.count()) or runs(df, *rest))
    got = subtotals(df, spec(), "client").collect()
    assert {(r["name"], r.run_client, r.client_id): (r.n_rows, r.amount_sum) for r in got} == expected
    assert len(got) == len(expected) and sorted_rows == [4 + 2 * 8]
