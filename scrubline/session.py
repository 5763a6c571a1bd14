"""Spark session and shared-storage helpers.

The library never creates machine-local scratch space on a cluster: shared
intermediates are tables written to the folder named by
``spark.checkpoint.dir``.  Only when that setting is absent on a local master
(tests) a private temporary folder is used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "scrubline", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Session with the settings this library is tuned for.

    AQE coalesces small shuffles and splits skewed ones at runtime; the UI is
    off (no server).  ``maxPartitionBytes`` is kept modest because text rows are
    wide and regex work is CPU-heavy per byte.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
        # Higher-order functions over span arrays are interpreted; keep a
        # generous limit for the few very long documents.
        "spark.sql.codegen.wholeStage": "true",
    }
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    Where it is unset, a private temporary folder is made for a local master
    (tests).  On a cluster that would lose data, so it is an error there.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="scrubline-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as parquet under the shared checkpoint folder and read
    it back, so several consumers share one computation and executor loss
    never recomputes the upstream regex work."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Inputs above this size are left as their splits are.
BALANCE_BYTES = 1 << 30
#: Bytes of a small input that are worth a task of their own.
TASK_BYTES = 4 << 20


def scan_bytes(df: DataFrame) -> int:
    """What the optimizer expects ``df`` to hold.  Close for scans of files,
    unions and projections of them; of a join it is the product of its sides,
    so measure the sides instead."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def balance(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread a small input over the cluster before CPU-heavy text work.

    Regex and fold work is per row and costs far more than reading, so a
    table stored as one row group (one task) would run on one core.  Only an
    input of at most ``BALANCE_BYTES`` is dealt anew, so what this shuffles is
    bounded; larger ones are split by ``spark.sql.files.maxPartitionBytes``.
    """
    size = scan_bytes(df)
    cores = df.sparkSession.sparkContext.defaultParallelism
    target = min_partitions or min(4 * cores, max(cores, size // TASK_BYTES))
    return df.repartition(target) if size <= BALANCE_BYTES and df.rdd.getNumPartitions() < target else df


def deal(rows: DataFrame, task_bytes: int) -> DataFrame:
    """Deal narrow rows that are about to become much wider or dearer: a file
    of a few megabytes is one split, but may stand for hours of work.  One task
    per ``task_bytes`` of the scan, at least one per core, whatever the size of
    the table: the rows shuffled are the narrow ones."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, -(-scan_bytes(rows) // task_bytes)))
