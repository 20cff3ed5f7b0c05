"""Session construction and the shared scratch location.

On a cluster the operator of the cluster names a shared folder in
``spark.checkpoint.dir``; intermediate tables (lineage cuts, files written
between two stages of one job) go below it.  Only when the setting is absent
(local tests) do we create one of our own.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_LOCAL_ROOTS: dict[str, str] = {}       # of local sessions without the setting (Spark refuses to set it later), by application


def get_spark(master: str | None = None, app: str = "curata",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Session for local runs and tests; on a cluster use the cluster's session."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.autoBroadcastJoinThreshold", str(64 * 1024 * 1024))
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", str(64 * 1024 * 1024))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CURATA_DRIVER_MEMORY", "16g"))
        .config("spark.sql.files.maxPartitionBytes", str(64 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Settings for a large cluster (to put in the cluster's session configuration, not set here):
# AQE coalesces the many initial shuffle partitions to ~advisory size, splits skewed
# partitions of sort-merge joins, and turns joins with a small measured side into
# broadcast joins (threshold below).
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for lineage cuts; set to a local one only if unset."""
    root = spark.conf.get(_CHECKPOINT_KEY, None)
    try:
        jsc = spark.sparkContext._jsc.sc()
    except Exception:  # noqa: BLE001 - no JVM context in this client
        jsc = None
    if not root and jsc is not None:
        jdir = jsc.getCheckpointDir()
        root = jdir.get() if jdir.isDefined() else None
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"{_CHECKPOINT_KEY} must name a folder that driver and executors share (master {master!r})")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="curata-ckpt-")
        root = _LOCAL_ROOTS[app]
    if jsc is not None and not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists in the store that the path names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def folders_in(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder; none when it doesn't exist."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory()) if fs.exists(p) else []


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def checkpointed(df, name: str = "table"):
    """Cut the lineage of a table read many times: write it as Parquet below the shared
    checkpoint folder and read it back (columnar, survives lost executors, and later
    reads get column pruning and filter pushdown, which an RDD checkpoint does not)."""
    path = shared_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
