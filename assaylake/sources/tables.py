"""Scans with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.USER).parquet(path)


def read_audit(
    spark: SparkSession, path: str, first: str | None = None, last: str | None = None
) -> DataFrame:
    """Audit rows written by sinks.append_audit, of the days first..last only.

    The day is a directory, so other days are not listed as input.
    """
    audit = spark.read.parquet(path)
    if first is not None:
        audit = audit.filter(F.col("dt") >= F.lit(first).cast("date"))
    if last is not None:
        audit = audit.filter(F.col("dt") <= F.lit(last).cast("date"))
    return audit


def read_database_table(
    spark: SparkSession, url: str, table: str, last_id: int, parts: int = 64, **options: str
) -> DataFrame:
    """A database table read in `parts` ranges of its `id` (needs a JDBC driver)."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn="id", **options)
        .option("lowerBound", 1)
        .option("upperBound", last_id)
        .option("numPartitions", parts)
        .load()
    )


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EXPERIMENT).parquet(path)


def read_experiment_json(spark: SparkSession, path: str) -> DataFrame:
    """Experiments from JSON lines; unreadable lines end up in `_bad`."""
    schema = T.StructType(
        [
            *schemas.EXPERIMENT.fields,
            T.StructField("params", T.MapType(T.StringType(), T.DoubleType())),
            T.StructField("_bad", T.StringType()),
        ]
    )
    return (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad")
        .json(path)
    )


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Documents (doc_id, text) on disk, as one Parquet table."""
    return spark.read.parquet(path).select("doc_id", "text")


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file, whole, with its path as id."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text")
    )
