"""Session settings the jobs rely on, and the shared folder for cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Session-level SQL settings; none of them needs a restart.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Joins that turn out to have small partitions on one side need no sort.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "128MB",
    # Hot login names, users and parts sit on the left of the joins; a skewed
    # partition is split even where that costs one more exchange afterwards.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir.

    Where none is set, a local master gets a folder of its own machine; on a cluster,
    whose executors share none, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("assaylake.folder", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all of {master} share")
        folder = tempfile.mkdtemp(prefix="assaylake-")
        spark.conf.set("assaylake.folder", folder)
    return folder


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Distribute a scan by `key` if it comes in fewer partitions than there are cores.

    Few large files keep most cores idle in costly row-wise work. A table of many files
    stays as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, key)


def cut(df: DataFrame, *by: str) -> DataFrame:
    """Write `df` to the shared folder, in folders by the columns `by`, and read it back.

    The stored table survives the loss of executors, is read column by column, and its
    size is known to the planner. Shuffle files made for it are removed once it is
    written, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.folder = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Remove tables that `cut` stored and that nothing will read any more."""
    for df in stored:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Mark `df` for broadcast if it has at most `max_rows` rows.

    The table is written to the shared folder first, so the check and the later
    join read the stored rows and the aggregation behind `df` runs once. A larger
    table is returned unmarked and joins by shuffle.
    """
    stored = cut(df)
    return F.broadcast(stored) if stored.count() <= max_rows else stored
