"""Joins the practice's queries need beyond a plain equi-join.

No side is ever broadcast by hint: Spark broadcasts a side whose estimated (or, with
adaptive execution, measured) size is under ``spark.sql.autoBroadcastJoinThreshold``
and shuffles otherwise, so a dimension that outgrows the threshold still works.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def left_first_wins(left: DataFrame, right: DataFrame, left_key: str,
                    right_key: str) -> DataFrame:
    """Left join in whose result a repeated column name means the left one."""
    seen = {c.lower() for c in left.columns}
    renamed = right.toDF(*[f"_r_{c}" for c in right.columns])
    joined = left.join(renamed, F.col(left_key) == F.col(f"_r_{right_key}"), "left")
    return joined.select(*left.columns, *[F.col(f"_r_{c}").alias(c) for c in right.columns
                                          if c.lower() not in seen])


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def join_every(many: DataFrame, few: DataFrame, key: str, condition: Column | None = None,
               spread: int | None = None) -> DataFrame:
    """Every row of ``many`` with each row of ``few`` (that meets ``condition``).

    For a handful of parameter rows (providers, billing batches). An equi-join on a
    slot number: each row of ``many`` falls into one of ``spread`` slots by its key (as
    many as there are shuffle partitions), each row of ``few`` is put into all of them.
    It is a hash join at any size of ``few``, and no slot is hotter than another.
    """
    spread = spread or int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = many.withColumn("_slot", F.pmod(F.xxhash64(key), F.lit(spread)).cast("int"))
    right = few.withColumn(
        "_slot", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    joined = left.join(right, "_slot").drop("_slot")
    return joined if condition is None else joined.where(condition)


#: Steps of a binary search: enough for a list of 2**31 bounds.
HALVINGS = [1 << k for k in range(30, -1, -1)]


def since(many: DataFrame, value: str, few: DataFrame, bound: str,
          keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """Every row of ``many`` with each row of ``few`` whose ``bound`` is not above ``value`` (and that
    ``keep`` likes, a condition on the row of ``few`` as a struct).

    The parameter rows are sorted by their bound into one list, in which each row finds its rank by binary
    search; only pairs of the result ever become rows. The list is one value: it has a row for
    each billing batch that was ever set up, and the result has far more. Null bounds and values pair
    with nothing.
    """
    item = F.struct(F.col(bound).alias("bound"), F.struct(*few.columns).alias("row"))
    ranks = few.where(F.col(bound).isNotNull()).agg(F.sort_array(F.collect_list(item))).scalar()
    listed = many.withColumn("_ranks", ranks)
    rank = F.aggregate(
        F.lit(HALVINGS), F.lit(0),
        lambda at, step: F.when(F.get("_ranks", at + step - 1)["bound"] <= F.col(value), at + step).otherwise(at))
    found = F.transform(F.slice("_ranks", F.lit(1), rank), lambda x: x["row"])
    found = found if keep is None else F.filter(found, keep)
    return listed.select(*many.columns, F.explode(found).alias("_row")).select(*many.columns, "_row.*")


def only_keys(df: DataFrame, column: str, keys: DataFrame | Sequence) -> DataFrame:
    """Rows whose ``column`` is in a list. A list of literals becomes ``IN``; a table of
    keys, of any size, a semi-join."""
    if isinstance(keys, DataFrame):
        wanted = keys.select(F.col(keys.columns[0]).alias("_key"))
        return df.join(wanted, F.col(column) == F.col("_key"), "left_semi")
    return df.where(F.col(column).isin(list(keys)))


def without_keys(df: DataFrame, column: str, keys: DataFrame, key: str | None = None) -> DataFrame:
    gone = keys.select(F.col(key or keys.columns[0]).alias("_key"))
    return df.join(gone, F.col(column) == F.col("_key"), "left_anti")


def scalar(df: DataFrame) -> Column:
    """A one-row, one-column frame as a value. No row is null; two rows are an error."""
    return df.scalar()
