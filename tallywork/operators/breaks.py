"""A report's headings and subtotals as one declaration."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.operators.numbering import Level, numbered, runs
from tallywork.session import kept


@dataclass(frozen=True)
class BreakSpec:
    levels: Sequence[Level]
    part: Sequence[str]
    order: Sequence[tuple[str, str]]  # column, asc | desc; total
    sums: Sequence[str] = ()

    def order_columns(self) -> list[Column]:
        return ordering(self.order)

    def order_in_part(self) -> list[Column]:
        return ordering([(c, way) for c, way in self.order if c not in self.part])

    def level(self, name: str) -> int:
        return [x.name for x in self.levels].index(name)


def ordering(order: Sequence[tuple[str, str]]) -> list[Column]:
    return [F.col(c).desc() if way == "desc" else F.col(c).asc() for c, way in order]


def _only(df: DataFrame, spec: BreakSpec, keep: Sequence[str]) -> DataFrame:
    """The columns of ``keep`` and those the breaks are found by: no others are sorted and written."""
    wanted = {*keep, *spec.part, *[c for c, _ in spec.order], *[k for x in spec.levels for k in x.keys]}
    return df.select(*[c for c in df.columns if c in wanted])


def with_breaks(df: DataFrame, spec: BreakSpec, ranges: int | None = None,
                keep: Sequence[str] | None = None) -> DataFrame:
    """The report's rows with their runs; of its columns those of ``keep``, where given."""
    if keep is None:
        return runs(df, spec.levels, spec.order_in_part(), spec.part, ranges)
    return runs(_only(df, spec, keep), spec.levels, spec.order_in_part(), spec.part, ranges).select(
        *keep, *[f"run_{x.name}" for x in spec.levels], "start_level", "is_end")


def subtotals(df: DataFrame, spec: BreakSpec, level: str, scope: str = "level",
              ranges: int | None = None) -> DataFrame:
    """Footer sums, one row per run.

    ``scope='level'``: a sum is reset only when ``level`` starts anew. ``scope='any'``:
    it is reset when any level does, so a footer covers the rows since the last change
    at all. Every 'level' run is made of whole 'any' runs.
    """
    if scope not in ("level", "any"):
        raise ValueError(scope)
    deepest = len(spec.levels) - 1 if scope == "any" else spec.level(level)
    shown = [k for x in spec.levels[:deepest + 1] for k in x.keys]
    by = list(dict.fromkeys([*spec.part, f"run_{spec.levels[deepest].name}"]))
    keep = [k for k in dict.fromkeys(shown) if k not in by]
    if deepest == 0:
        return _summed_first(df, spec, by, keep, ranges)
    # the level's keys are constant within its run
    used = list(dict.fromkeys([*spec.part, *keep, *spec.sums]))
    return (with_breaks(df, spec, ranges, used).groupBy(*by, *keep)
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 *[F.sum(c).alias(f"{c}_sum") for c in spec.sums]))


def _summed_first(df: DataFrame, spec: BreakSpec, by: Sequence[str], keep: Sequence[str],
                  ranges: int | None) -> DataFrame:
    """Footer sums of the outermost level, most rows summed before they are sorted.

    Rows of one part lie together. Where they have one set of keys no run begins among them, and one row
    with their sums stands for all. Parts in which several keys meet (clients of one name) are
    few: their rows stay as they are, as where their runs begin depends on the whole order.
    """
    top = spec.levels[:1]
    ordered = [c for c, _ in spec.order]
    wanted = {*spec.part, *keep, *spec.sums, *ordered}
    rows = kept(df.select(*[c for c in df.columns if c in wanted]))
    once = kept(rows.groupBy(*dict.fromkeys([*spec.part, *keep])).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_sum_{c}") for c in spec.sums]))
    shared = once.groupBy(*spec.part).agg(F.count(F.lit(1)).alias("_many")).where("_many > 1").select(
        *[F.col(c).alias(f"_{c}") for c in spec.part])
    meant = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in spec.part])
    short = once.join(shared, meant, "left_anti")
    whole = rows.join(shared, meant, "left_semi").select(
        *[c for c in rows.columns if c in {*spec.part, *keep, *ordered}], F.lit(1).cast("bigint").alias("_rows"),
        *[F.col(c).cast(once.schema[f"_sum_{c}"].dataType).alias(f"_sum_{c}") for c in spec.sums])
    both = whole.unionByName(short, allowMissingColumns=True)
    return (runs(both, top, spec.order_in_part(), spec.part, ranges).groupBy(*by, *keep)
            .agg(F.sum("_rows").alias("n_rows"),
                 *[F.sum(f"_sum_{c}").cast(once.schema[f"_sum_{c}"].dataType).alias(f"{c}_sum")
                   for c in spec.sums]))


def with_parity(df: DataFrame, spec: BreakSpec, ranges: int | None = None,
                keep: Sequence[str] | None = None) -> DataFrame:
    """Alternate shading, 0 and 1 down the whole report; of its columns those of ``keep``, where given."""
    shown = df.columns if keep is None else keep
    return numbered(_only(df, spec, shown), [], spec.order_columns(), "_no", ranges).select(
        *shown, ((F.col("_no") - 1) % 2).cast("int").alias("parity"))
