"""Row numbers and control-break runs over a sorted report: one plan at every size.

The rows are dealt into ranges of the whole sort order (Spark samples it), sorted and written once, so every
later step sees the same ranges and nothing before them runs again. A range is about as large as any other,
however many rows a client, a group or a surname has: the order is total, so a range may begin anywhere.

Then a prefix scan: each range counts what starts inside it, and gives one summary row (its first and
last keys, its counts); the summaries, as many as there are ranges, are put in order among themselves and
hand each range what came before it and the keys on either side. A run or a number that begins anew
with its part (a client, say) takes off what had been counted when the part began, which is the largest
such count so far.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywork.session import shared_dir

#: A row's place is its range and its number inside it, in so many bits; ranges share a block of summaries.
PLACE_BITS, BLOCK_BITS = 33, 20


def laid_out(df: DataFrame, order: Sequence[Column], ranges: int | None = None) -> DataFrame:
    """The rows, sorted over ``ranges`` ranges of a total order (as many as Spark shuffles into, if
    not given), written to the shared folder; with ``_place`` and ``_range``. They are written in buckets of
    whole ranges, so that what is worked out range by range needs no shuffle."""
    spark = df.sparkSession
    many = min(ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << BLOCK_BITS)
    rows = (df.repartitionByRange(many, *order).sortWithinPartitions(*order)
            .withColumn("_place", F.monotonically_increasing_id())
            .withColumn("_range", F.shiftright("_place", PLACE_BITS).cast("int")))
    name = f"ranges_{uuid.uuid4().hex}"
    (rows.write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}")
     .format("parquet").bucketBy(many, "_range").saveAsTable(name))
    return spark.table(name)


class _Scan:
    """A prefix scan over laid-out rows. ``part``: columns with which every count begins anew.
    ``keys``: for each count the columns whose change is counted; None counts every row."""

    def __init__(self, part: Sequence[str], keys: Sequence[Sequence[str] | None]):
        wide = [*part]
        self.part = range(len(part))
        self.own: list[list[int] | None] = []
        for own in keys:
            self.own.append(None if own is None else [*self.part, *range(len(wide), len(wide) + len(own))])
            wide += own or []
        self.count = range(len(keys))
        self.packed = F.struct(F.lit(0).alias("k"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(wide)])

    def differ(self, which: Sequence[int], a: Column, b: Column) -> Column:
        same = F.lit(True)
        for j in which:
            same = same & a[f"k{j}"].eqNullSafe(b[f"k{j}"])
        return ~same

    def starts(self, i: int, a: Column, b: Column) -> Column:
        return F.lit(True) if self.own[i] is None else self.differ(self.own[i], a, b)

    def each(self, make) -> dict[str, Column]:
        return {k: v for i in self.count for k, v in make(i).items()}

    def local(self, rows: DataFrame) -> DataFrame:
        """Counts inside each range; what its first row starts is not known there."""
        w = Window.partitionBy("_range").orderBy("_place")
        so_far = w.rowsBetween(Window.unboundedPreceding, 0)
        cur, back = F.col("_cur"), F.col("_back")
        return (rows.withColumn("_cur", self.packed)
                .withColumns({"_back": F.lag("_cur").over(w), "_ahead": F.lead("_cur").over(w)})
                .withColumns({"_new": back.isNotNull() & self.differ(self.part, cur, back), **self.each(
                    lambda i: {f"_e{i}": F.when(back.isNull(), 0).otherwise(
                        self.starts(i, cur, back).cast("int"))})})
                .withColumns(self.each(lambda i: {f"_s{i}": F.sum(f"_e{i}").over(so_far)}))
                .withColumns(self.each(lambda i: {f"_b{i}": F.max(F.when(
                    F.col("_new"), F.col(f"_s{i}") - F.col(f"_e{i}"))).over(so_far)})))

    def carried(self, local: DataFrame) -> DataFrame:
        """One row a range: what its first row starts (``_first_e``), the counts before it (``_off``), the
        count when the part that goes on into it began (``_base``), the keys after it."""
        summary = local.groupBy("_range").agg(
            F.max(F.when(F.col("_back").isNull(), F.col("_cur"))).alias("_first"),
            F.max(F.when(F.col("_ahead").isNull(), F.col("_cur"))).alias("_last"),
            *[F.max(f"_s{i}").alias(f"_n{i}") for i in self.count],
            *[F.max(f"_b{i}").alias(f"_m{i}") for i in self.count])
        w = Window.partitionBy("_block").orderBy("_range")
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        first, prior = F.col("_first"), F.col("_prior")

        def begun(i: int) -> Column:
            """The count when the last part of the range began; null if none does."""
            return F.greatest(F.when(F.col("_fresh"), F.col(f"_off{i}")),
                              F.col(f"_off{i}") + F.col(f"_first_e{i}") + F.col(f"_m{i}"))

        return (summary.withColumn("_block", F.shiftright("_range", BLOCK_BITS))
                .withColumns({"_prior": F.lag("_last").over(w), "_after": F.lead("_first").over(w)})
                .withColumns({"_fresh": prior.isNull() | self.differ(self.part, first, prior), **self.each(
                    lambda i: {f"_first_e{i}": F.when(prior.isNull(), 1).otherwise(
                        self.starts(i, first, prior).cast("int"))})})
                .withColumns(self.each(lambda i: {f"_off{i}": F.coalesce(F.sum(
                    F.col(f"_n{i}") + F.col(f"_first_e{i}")).over(before), F.lit(0))}))
                .withColumns(self.each(lambda i: {f"_base{i}": F.max(begun(i)).over(before)}))
                .select("_range", "_after", "_fresh",
                        *[f"{x}{i}" for x in ("_first_e", "_off", "_base") for i in self.count]))

    def over(self, rows: DataFrame) -> DataFrame:
        """Adds for each count ``_count`` (from 1 within the part) and ``_start`` (counted at this row), and
        ``_next``, the keys after the row (null at the end)."""
        local = self.local(rows)
        joined = local.join(self.carried(local), "_range")

        def counts(i: int) -> dict[str, Column]:
            so_far = F.col(f"_off{i}") + F.col(f"_first_e{i}")
            began = F.coalesce(so_far + F.col(f"_b{i}"), F.when(F.col("_fresh"), F.col(f"_off{i}")),
                               F.col(f"_base{i}"))
            return {f"_count{i}": (so_far + F.col(f"_s{i}") - began).cast("bigint"),
                    f"_start{i}": F.when(F.col("_back").isNull(), F.col(f"_first_e{i}"))
                    .otherwise(F.col(f"_e{i}")) == 1}

        return joined.withColumns({"_next": F.coalesce("_ahead", "_after"), **self.each(counts)})


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str = "row_no",
             ranges: int | None = None) -> DataFrame:
    """``row_number()`` within ``group``: the same rows and a bigint column more. ``order`` must be total
    within a group."""
    rows = laid_out(df, [*map(F.col, group), *order], ranges)
    scan = _Scan(group, [None])
    return scan.over(rows).select(*df.columns, F.col("_count0").alias(out))


@dataclass(frozen=True)
class Level:
    """A heading of a report: it starts anew when its key columns change."""

    name: str
    keys: Sequence[str]


def runs(df: DataFrame, levels: Sequence[Level], order: Sequence[Column],
         part: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Control breaks over the report order.

    ``levels`` go from the outermost in. A level's run starts when its own key or that of
    a level outside it differs from the row before. ``part`` names leading sort columns
    whose change always changes the outermost key, so no run crosses them.

    Adds ``run_<level>`` (numbered from 1 within ``part``), ``start_level`` (index of the
    outermost level that starts at this row, else null) and ``is_end`` (the next row
    starts a run, or there is none).
    """
    keys: list[list[str]] = []
    for level in levels:
        keys.append([*(keys[-1] if keys else []), *level.keys])
    scan = _Scan(part, keys)
    rows = scan.over(laid_out(df, [*map(F.col, part), *order], ranges))
    ahead, last = F.col("_next"), len(levels) - 1
    return rows.select(
        *df.columns,
        *[F.col(f"_count{i}").alias(f"run_{x.name}") for i, x in enumerate(levels)],
        F.coalesce(*[F.when(F.col(f"_start{i}"), F.lit(i)) for i in scan.count]).cast("int")
        .alias("start_level"),
        (ahead.isNull() | scan.starts(last, F.col("_cur"), ahead)).alias("is_end"))
