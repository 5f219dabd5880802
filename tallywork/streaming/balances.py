"""Client balances that follow the visits as they are entered, edited and deleted.

Every micro-batch adds one small set of *cells*: sums of the changes per client and day. Cells add up,
deletions are negative. The balances of the clients that a batch touches are made anew from their cells (a semi
join), so first and last visit survive deletions, and are written as one more part of the balance table; the newest
part that has a client holds. A busy client is many days, not one row everybody waits for.

Parts count once the batch's pointer names them, and that is written last: a reader sees a whole batch or
none of it, and a batch that is run again after it was finished changes nothing. Every so many parts the
job folds them into one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallywork.functions import billing

CELLS = ("client_id bigint, session_date date, visits bigint, charges decimal(18,2), "
         "client_paid decimal(18,2), insurance_paid decimal(18,2)")
SUMS = ["charges", "client_paid", "insurance_paid"]


def cells(changes: DataFrame) -> DataFrame:
    """Change rows (op +1 entered, -1 deleted) summed per client and day. An edit is a
    deletion and an entry."""
    op = F.col("op")
    return changes.groupBy("client_id", "session_date").agg(
        F.sum(op).cast("bigint").alias("visits"),
        billing.total(F.col("charge") * op).alias("charges"),
        billing.total(F.col("client_paid") * op).alias("client_paid"),
        billing.total(billing.zero_if_null(F.col("insurance_paid")) * op).alias("insurance_paid"))


def add_up(parts: DataFrame) -> DataFrame:
    return parts.groupBy("client_id", "session_date").agg(
        F.sum("visits").alias("visits"),
        *[billing.total(F.col(c)).alias(c) for c in SUMS])


def balances(parts: DataFrame, clients: DataFrame | None = None) -> DataFrame:
    """Balances from cells. With ``clients`` (id, billing_cutoff) only days in the client's
    billing period count.

    Money of days without visits left counts (a deletion may differ from its entry); only the days
    with visits are first or last ones. A client with neither visits nor money has no row."""
    days = add_up(parts)
    if clients is not None:
        cutoffs = clients.select(F.col("id").alias("client_id"), "billing_cutoff")
        days = days.join(cutoffs, "client_id").where("session_date >= billing_cutoff")
    owed = F.col("charges") - F.col("client_paid") - F.col("insurance_paid")
    return days.groupBy("client_id").agg(
        F.min(F.when(F.col("visits") > 0, F.col("session_date"))).alias("oldest_session_date"),
        F.max(F.when(F.col("visits") > 0, F.col("session_date"))).alias("recent"),
        *[billing.total(F.col(c)).alias(c) for c in SUMS],
        billing.total(owed).alias("balance")).where(
            "recent is not null or charges <> 0 or client_paid <> 0 or insurance_paid <> 0")


POINTER = "batch_id bigint, cells array<string>, balances array<string>"
BALANCES = ("client_id bigint, oldest_session_date date, recent date, charges decimal(18,2), "
            "client_paid decimal(18,2), insurance_paid decimal(18,2), balance decimal(18,2), version bigint")


@dataclass(frozen=True)
class Version:
    """What the pointer says: the last finished batch and the parts that hold."""

    batch_id: int = -1
    cells: tuple[str, ...] = ()
    balances: tuple[str, ...] = ()


def current_version(spark: SparkSession, folder: str) -> Version:
    """The version of the newest pointer; an empty one where no batch has finished yet."""
    pointers = spark.read.schema(POINTER).option("pathGlobFilter", "*.json").option(
        "recursiveFileLookup", "true")
    try:
        newest = pointers.json(f"{folder}/pointer").orderBy(F.desc("batch_id")).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        newest = None
    return Version(newest.batch_id, tuple(newest.cells), tuple(newest.balances)) if newest else Version()


def _parts(spark: SparkSession, folder: str, kinds: str, names: Sequence[str]) -> DataFrame:
    if not names:
        return spark.createDataFrame([], kinds)
    return spark.read.schema(kinds).parquet(*[f"{folder}/{n}" for n in names])


def read_cells(spark: SparkSession, folder: str, version: Version | None = None) -> DataFrame:
    version = version or current_version(spark, folder)
    return _parts(spark, folder, CELLS, version.cells)


def _newest(parts: DataFrame) -> DataFrame:
    """Each client's row of the newest part; one without money there has no balance left."""
    row = F.struct(*[c for c in parts.columns if c != "client_id"])
    return parts.groupBy("client_id").agg(F.max_by(row, "version").alias("row")).select("client_id", "row.*")


def read_balances(spark: SparkSession, folder: str, version: Version | None = None) -> DataFrame:
    """The balance table as of the last finished batch."""
    version = version or current_version(spark, folder)
    return (_newest(_parts(spark, folder, BALANCES, version.balances))
            .where("balance is not null").drop("version"))


def merge_batch(changes: DataFrame, batch_id: int, folder: str, clients: DataFrame | None = None,
                fold_after: int = 20) -> None:
    """Take the change rows of a batch into the balance table. ``clients``: their billing cutoffs.
    From ``fold_after`` parts on, all are folded into one."""
    spark = changes.sparkSession
    version = current_version(spark, folder)
    if batch_id <= version.batch_id:
        return
    own = f"batch_id={batch_id}"
    cells(changes).write.mode("overwrite").parquet(f"{folder}/cells/{own}")
    version = Version(batch_id, (*version.cells, f"cells/{own}"), version.balances)
    touched = _parts(spark, folder, CELLS, version.cells[-1:]).select("client_id").distinct()
    days = read_cells(spark, folder, version).join(touched, "client_id", "left_semi")
    (touched.join(balances(days, clients), "client_id", "left").withColumn("version", F.lit(batch_id))
     .write.mode("overwrite").parquet(f"{folder}/balances/{own}"))
    version = Version(batch_id, version.cells, (*version.balances, f"balances/{own}"))
    if len(version.cells) > fold_after:
        empty = " and ".join(f"{c} = 0" for c in ("visits", *SUMS))
        (add_up(read_cells(spark, folder, version)).where(f"not ({empty})")
         .write.mode("overwrite").parquet(f"{folder}/cells/upto={batch_id}"))
        (read_balances(spark, folder, version).withColumn("version", F.lit(batch_id))
         .write.mode("overwrite").parquet(f"{folder}/balances/upto={batch_id}"))
        version = Version(batch_id, (f"cells/upto={batch_id}",), (f"balances/upto={batch_id}",))
    pointer = spark.createDataFrame([(batch_id, list(version.cells), list(version.balances))], POINTER)
    pointer.coalesce(1).write.mode("overwrite").json(f"{folder}/pointer/{own}")


def keep_balances(changes: DataFrame, folder: str, checkpoint: str, clients: DataFrame | None = None,
                  fold_after: int = 20, available_now: bool = False) -> StreamingQuery:
    """Start the job. ``folder`` and ``checkpoint`` lie in shared storage."""
    writer = (changes.writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda df, batch_id: merge_batch(df, batch_id, folder, clients, fold_after)))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
