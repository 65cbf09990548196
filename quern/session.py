"""Session settings and table access shared by every operator."""

from __future__ import annotations

import math
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


BATCH_BYTES = 16 << 20


def get_spark(master: str = "local[*]", **conf: str) -> SparkSession:
    """Build a session with the settings the operators rely on."""
    b = SparkSession.builder.master(master)
    for k, v in {**SETTINGS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it.

    Needed where it is neither installed nor on the workers' path; on a cluster the folder must be
    shared, or the package installed.
    """
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        env["PYTHONPATH"] = os.pathsep.join([home, *paths])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def small_batches(spark: SparkSession) -> None:
    """Let blocks go to Python workers a few at a time: a batch is held by the JVM and by the worker, and Spark's own limit is 64 MB."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that is
    unset (single-machine tests) a temporary folder is used.
    """
    sc = df.sparkSession.sparkContext
    named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc._jsc.sc().getCheckpointDir().isEmpty():
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quern-"))
    return df.checkpoint(eager=True)


def partitions_for(rows: int, per_partition: int, least: int = 1) -> int:
    """Number of partitions that keeps each one near ``per_partition`` rows."""
    return max(least, math.ceil(rows / max(1, per_partition)))


def spread(df: DataFrame) -> DataFrame:
    """The frame over all cores, if its scan has fewer splits than there are cores.

    For costly functions over small inputs, such as one file of one row group. Inputs with splits enough
    for the cluster stay as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
