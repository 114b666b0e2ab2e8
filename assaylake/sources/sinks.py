"""Appends and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def append_audit(audit: DataFrame, path: str) -> None:
    """Append audit rows in one directory per day."""
    dated = audit.withColumn("dt", F.to_date("created_at"))
    dated.write.mode("append").partitionBy("dt").parquet(path)


def write_literature(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("data_type").parquet(path)


def save_bucketed(rows: DataFrame, table: str, key: str, buckets: int, path: str) -> None:
    """Save as a table bucketed and sorted by `key`.

    Tables saved with equal key and bucket count join and group on the key without an
    exchange.
    """
    (
        rows.write.bucketBy(buckets, key)
        .sortBy(key)
        .option("path", path)
        .mode("overwrite")
        .saveAsTable(table)
    )


def export(rows: DataFrame, path: str, kind: str) -> None:
    """Write results as csv (with header), json or parquet files."""
    writer = rows.write.mode("errorifexists")
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "json":
        writer.json(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"cannot export to {kind}")
