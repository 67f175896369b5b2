"""Session helpers: a local session for tests and benchmarks, and table reading."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A local[...] session in UTC with AQE on; `extra` holds further settings, dots written as __."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("threadlens")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # where each expression was written is not kept: plans here are long
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("THREADLENS_DRIVER_MEMORY", "8g"))
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """`df` in the checkpoint folder, without its lineage: it is worked out once, and a lost executor costs nothing. The folder is the cluster's
    (`spark.checkpoint.dir`); one of this machine is made in local sessions alone."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir is to name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="threadlens-checkpoint-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """`df` dealt by `by` over all cores, for rows that are few or short and take long: adaptive execution would put them into one task."""
    sc = df.sparkSession.sparkContext
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * sc.defaultParallelism), *by)


def sql_text(value: str) -> str:
    """A string as a literal of Spark SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
