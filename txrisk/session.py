"""Spark session and shared-storage helpers.

Everything in the library works on the session it is given; ``get_session``
is a convenience for tests, the bench and notebooks.  Cluster settings that
matter at scale (AQE, skew-join splitting, Arrow batch size) are set here so
that the local and the cluster configuration look the same.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def _default_driver_memory() -> str:
    """60 % of physical memory, at most 16 GB (local mode runs everything in the driver)."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
        return f"{max(1, min(16, int(total * 0.6 / 2**30)))}g"
    except (ValueError, OSError, AttributeError):
        return "4g"


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "txrisk") -> SparkSession:
    master = master or os.environ.get("TXRISK_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("TXRISK_SHUFFLE_PARTITIONS", "8"))
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        .config("spark.driver.memory", os.environ.get("TXRISK_DRIVER_MEMORY", _default_driver_memory()))
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting must point at storage that the driver and every
    executor share; it is read, never replaced.  Only a local master may leave
    it unset: driver and executors are then one process and a scratch folder
    is made.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a shared folder: master is {master}")
        current = tempfile.mkdtemp(prefix="txrisk-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    return current


def data_signature(spark: SparkSession, path: str) -> tuple:
    """Newest change time, total bytes and number of the Parquet files below ``path``: a listing, no scan."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True)
    newest = size = n = 0
    while files.hasNext():
        f = files.next()
        if f.getPath().getName().endswith(".parquet"):
            newest, size, n = max(newest, f.getModificationTime()), size + f.getLen(), n + 1
    return newest, size, n


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder path of this run's own below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df, path: str):
    """Write ``df`` as Parquet to a shared path and read it back.

    Cuts the lineage: what follows reads the written files, so a lost executor
    costs a re-read and not a recomputation.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
