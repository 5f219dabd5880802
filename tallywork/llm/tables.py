"""Reading, storing and small helpers that all operators here share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.session import shared_dir

#: Spark's setting for the bytes of a batch, and what it is here.
ARROW, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
#: Bytes of text that are worked on at once: hashes and running sums take some fifty times as much.
PIECE = 1 << 19


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, which cuts its lineage: a lost
    executor costs a read, and no branch computes the rows anew. Where there are many more partitions than
    cores, a task writes several, one after the other."""
    spark = df.sparkSession
    place = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.coalesce(4 * max(spark.sparkContext.defaultParallelism, 4)).write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns an operator reads, whatever else a table has; null text is empty text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def small_batches(spark: SparkSession) -> None:
    """What goes to a Python worker comes in batches of ARROW_BYTES, unless the session has a bound of its own. Rows
    with two texts otherwise fill Spark's 64 MB, held by the executor and by the worker, and neither gives
    all of it back."""
    if ARROW not in spark.conf.getAll:
        spark.conf.set(ARROW, ARROW_BYTES)


def let_workers_import(spark: SparkSession) -> None:
    """Python workers find this package where the driver has it; a cluster that installs or ships
    it elsewhere is not disturbed. They get small batches."""
    small_batches(spark)
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [x for x in known.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, root])


def mapped(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]],
           schema: str) -> DataFrame:
    """``make()`` runs once in each task and gives a function from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for piece in cut(batch):
                out = work(piece)
                if out is not None:
                    yield out

    let_workers_import(df.sparkSession)
    return df.mapInArrow(run, schema)


def cut(batch: pa.RecordBatch, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text (one row at least; all text columns count), so memory follows the
    longest text and not the number of rows that came together."""
    if batch.num_rows == 0:
        return
    texts = [x for x in batch.columns if pa.types.is_string(x.type) or pa.types.is_large_string(x.type)]
    if not texts:
        yield batch
        return
    ends = np.sum([text_bytes(x)[1] for x in texts], axis=0)
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(ends, ends[lo] + most, side="right")) - 1
        hi = max(hi, lo + 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and where each begins (and the end)."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def record(**columns: object) -> pa.RecordBatch:
    arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, list(columns))
