"""Versioned snapshots of a table that changes as a whole.

Parquet files cannot be updated in place. A changed table is written to a new
directory; afterwards a row in the `log` table makes it the current one. A job that
dies in between leaves the old version current.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOG = T.StructType(
    [T.StructField("version", T.LongType()), T.StructField("folder", T.StringType())]
)


def _current(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, str | None]:
    try:
        log = spark.read.schema(_LOG).parquet(f"{root}/log")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, None  # no snapshot yet
    if version is not None:
        log = log.filter(F.col("version") == version)
    row = log.agg(F.max(F.struct("version", "folder")).alias("top")).first()
    return (row.top.version, row.top.folder) if row.top else (0, None)


def current_version(spark: SparkSession, root: str) -> int:
    """Number of the current snapshot, 0 if there is none."""
    return _current(spark, root)[0]


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The current snapshot, or an earlier one by number."""
    number, folder = _current(spark, root, version)
    if folder is None:
        raise FileNotFoundError(f"no snapshot {version or number} below {root}")
    return spark.read.parquet(f"{root}/{folder}")


def write_snapshot(table: DataFrame, root: str) -> int:
    """Write the next snapshot and switch to it; returns its number.

    One writer at a time. Every attempt writes a directory of its own, so a retry does
    not meet the files of a failed one.
    """
    spark = table.sparkSession
    number = current_version(spark, root) + 1
    folder = f"v{number}-{uuid.uuid4().hex}"
    table.write.mode("errorifexists").parquet(f"{root}/{folder}")
    entry = spark.createDataFrame([(number, folder)], _LOG)
    entry.coalesce(1).write.mode("append").parquet(f"{root}/log")
    return number
