"""Reading and writing the practice's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallywork import schema
from tallywork.practice import Practice


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Full scan of a base table; the declared schema spares a look at the files."""
    return spark.read.schema(schema.struct(name)).parquet(f"{folder}/{name}")


def read_practice(spark: SparkSession, folder: str) -> Practice:
    return Practice({name: read_table(spark, folder, name) for name in schema.COLUMNS})


def read_database(spark: SparkSession, url: str, name: str, lower: int, upper: int,
                  partitions: int, **options: str) -> DataFrame:
    """A base table of a live database, read in ``partitions`` ranges of its key."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=name, partitionColumn=schema.KEYS[name], lowerBound=lower,
        upperBound=upper, numPartitions=partitions, fetchsize=10000, **options)
    return conform(reader.load(), name)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Lower-case the names and cast to the declared types; columns the source does
    not have yet become typed nulls (older versions of a table)."""
    lowered = df.toDF(*[c.lower() for c in df.columns])
    have = set(lowered.columns)
    return lowered.selectExpr(*[
        f"cast({c if c in have else 'null'} as {kind}) as `{c}`"
        for c, kind in schema.types(name).items()])


# how large tables lie in their files: rows of a client (a day) together, so that a filter
# on it reads few row groups; further columns split what is busy
CLUSTERED = {
    "visit": ["client_id", "session_id"], "session": ["session_date", "id"],
    "client": ["id"], "insurance": ["client_id"],
}


def write_table(df: DataFrame, folder: str, name: str, parts: int | None = None) -> None:
    """A new version of a table. Never the folder ``df`` is read from. ``parts``: number of
    files of a large table, about its size / 256 MB; left out, Spark decides."""
    keys = CLUSTERED.get(name)
    if keys:
        ranged = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
        df = ranged.sortWithinPartitions(*keys)
    df.write.mode("errorifexists").parquet(f"{folder}/{name}")


def write_practice(db: Practice, folder: str, parts: int | None = None) -> None:
    for name, df in db.items():
        write_table(df, folder, name, parts)


# bucketed layout: visits lie with their session, so the join every report begins with needs
# no shuffle. A session is one meeting, so no bucket key is hot.
BUCKETED = {"visit": "session_id", "session": "id"}


def save_bucketed(df: DataFrame, name: str, buckets: int, path: str, table: str) -> None:
    """A new version of a table as catalog table ``table``, bucketed and sorted by its join
    key. Both sides of the join need the same number of buckets."""
    key = BUCKETED[name]
    # one task per bucket writes one file per bucket
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
     .option("path", path).mode("errorifexists").saveAsTable(table))


def bucketed_practice(spark: SparkSession, db: Practice, names: dict[str, str]) -> Practice:
    """``db`` with some of its tables read from the catalog (name -> catalog table)."""
    return db.replaced(**{name: spark.table(table) for name, table in names.items()})
