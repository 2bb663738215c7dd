"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that only affect how plans run, never what they return.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    # needed to read GBK text tables and to decode GBK documents
    "spark.sql.legacy.javaCharsets": "true",
    # bytes that no charset accepts are replaced instead of ending the job
    "spark.sql.legacy.codingErrorAction": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidymill")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        # keep small stages on all cores instead of one task
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
    )
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for written intermediate results.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master without that setting, where one
    machine holds everything, gets a folder of its own, which goes when the process ends.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = f"{tempfile.gettempdir()}/tidymill-checkpoint-{os.getpid()}"
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)
    return named


def pin(df: DataFrame) -> DataFrame:
    """Write a frame once to the shared checkpoint folder and go on from the written table.

    It is never recomputed differently afterwards, whichever executors are lost, and as Parquet it
    is read by column.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/pinned-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
