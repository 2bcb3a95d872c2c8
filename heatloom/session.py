"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_scratch: dict[str, str] = {}


def get_spark(app: str = "heatloom", **conf: str) -> SparkSession:
    """A session with the settings the operators assume.

    Hours of day and dates are read in UTC. AQE sizes reducers, splits skewed
    join partitions and turns joins into broadcasts from *measured* sizes, so
    the operators hint a broadcast only where a row bound was checked.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # The JVM leaves larger methods uncompiled; wide rows then run faster
        # without whole-stage code.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # Without this every column call walks the Python stack for its origin.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a single-machine session may leave that unset; it gets a temporary
    folder. On a cluster each executor would write to a disk of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _local_scratch[app] = tempfile.mkdtemp(prefix="heatloom-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch root; never reused between calls. One
    folder per application holds all of them, so it can be removed afterwards."""
    folder = f"{scratch_root(spark)}/heatloom-{spark.sparkContext.applicationId}"
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.mkdirs(place):
        files.deleteOnExit(place)  # with the driver's JVM
    return f"{folder}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared scratch folder and reads it back.

    Cuts the lineage in a way that survives lost executors, and gives Spark the
    true size when it chooses a join.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
