"""Tables written to the shared folder of the cluster, to cut lineage and to be read more than once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ortholake.plans.shared import shared_dir


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Arrow batches to Python of at most so many bytes, which bounds a worker's memory however long the texts are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if now < 0 or now > most:
        spark.conf.set(name, str(most))


#: Shuffle files of an action go as soon as it ends, not when the driver's JVM collects what refers to them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again; the files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ortholake-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def replayable(df: DataFrame) -> DataFrame:
    """``df`` as rows that come in the same order when a task runs again, as packed exchanges need.

    A scan's do; the order in which a shuffle's blocks arrive may change, so such input is written first.
    """
    return materialize(df, "input") if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df
