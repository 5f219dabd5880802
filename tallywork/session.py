"""Session settings. Everything here is a runtime SQL setting, so a session that
was built elsewhere (a cluster's own) can be tuned too."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME = {
    # dates in the reports are calendar dates, never shifted
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # one client or group may hold a third of all visits
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join even when the aggregate after it then needs its own
    # (already reduced) exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # visits that lie by client need not be shuffled again to be joined by client and group
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


#: Folders of local sessions by application (the setting itself cannot be changed at run time).
_local_dirs: dict[str, str] = {}


def build_session(app: str = "tallywork", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session (tests)
    without that setting gets a folder of its own, one for each application.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="tallywork-")
    return _local_dirs[app]


def kept(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder: for what a query reads more than once."""
    path = f"{shared_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
