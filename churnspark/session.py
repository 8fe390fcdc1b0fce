"""Spark session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "churnspark") -> SparkSession:
    """Session with the settings the operators are tuned for.

    On a cluster the master, memory and shuffle sizing come from the
    submitter; locally (tests, bench) we size them for ``local[N]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor
            builder = builder.config("spark.driver.memory", os.environ.get("CHURNSPARK_DRIVER_MEMORY", "16g"))
    builder = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session; only when it is unset
    (local runs, as in tests) is a scratch folder created for it; a cluster without it is refused.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="churnspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def new_table_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared checkpoint folder, for an intermediate table."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, rows_a_file: int = 0, by: str = "", session: SparkSession | None = None) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back (cuts the lineage, survives lost executors).

    ``rows_a_file``: rows of a file at most (0: any number); a scan holds thousands of rows of a file at once, too many where a row has megabytes.
    ``by``: a column whose values have a folder each. ``session``: that reads it back."""
    path = new_table_path(df.sparkSession, tag)
    df.write.option("maxRecordsPerFile", rows_a_file).partitionBy(*[by] * bool(by)).parquet(path)
    return (session or df.sparkSession).read.schema(df.schema).parquet(path).select(df.columns)
