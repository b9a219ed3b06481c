"""Local session for tests and bench, and the shared checkpoint folder."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("panelspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PANELSPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's ``spark.checkpoint.dir``.

    Only a local session without one gets a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="panelspark-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def relieved(spark: SparkSession, always: bool = False) -> None:
    """Collect the driver's garbage if its heap has grown beyond half of its limit, or ``always``.

    What plans, broadcasts and listeners of ended jobs leave is garbage, but a Java heap grows
    to its limit before it gives memory back, and a query of many small jobs fills it so. Spark
    deletes the files of a shuffle once its plan has been collected, here and in Python: after the
    last job that reads a large shuffle, ``always`` keeps them from staying on the executors' disks.
    """
    java = getattr(spark, "_jvm", None)  # a remote session has no driver of its own
    if java is None:
        return
    runtime = java.java.lang.Runtime.getRuntime()
    if always:
        gc.collect()
        java.java.lang.System.gc()
        time.sleep(1)  # until listeners have let go of the last job
    if always or runtime.totalMemory() > runtime.maxMemory() // 2:
        java.java.lang.System.gc()


def stored(df: DataFrame, few: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and continue from there.

    The result has no lineage, so a lost executor cannot re-run a sampled range
    partitioning and move rows, and later passes read only the columns they need. With ``few``,
    for tables of some rows per rule, one task reads it: joins, windows and sorts of such tables
    need no shuffles, each of which would be a job and broadcasts in the driver's heap.
    """
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    relieved(df.sparkSession)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    return table.coalesce(1) if few else table
