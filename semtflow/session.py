"""Session and checkpoint helpers."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, name: str = "semtflow") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SEMTFLOW_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session that names none (a test) gets a scratch folder; a cluster must name one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder of the session."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash the rows by a unique key over all cores before work that costs far more than moving them.

    A file split holds millions of short texts; matching one costs milliseconds.
    An input of at least two splits per core keeps them and is not shuffled. Below
    that, a fixed count keeps adaptive coalescing from undoing the spread, and
    hashing (unlike round robin) gives the same partitions on a retry.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if not df.isStreaming and df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(max(2 * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)
