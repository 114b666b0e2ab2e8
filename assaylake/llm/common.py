"""What the text operators share: settings, scans, stored tables, Arrow columns."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, discard, tune

# Rows and bytes of text that a Python task holds at once.
ARROW = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}

# White space of the word rule: blank, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


@lru_cache(maxsize=4)
def _ship(application: str) -> None:
    """Give this package to the Python workers of a Spark application."""
    root = Path(__file__).resolve().parents[2]
    archive = Path(os.path.realpath(tempfile.mkdtemp())) / "assaylake-code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted((root / "assaylake").rglob("*.py")):
            out.write(source, source.relative_to(root))
    SparkSession.active().sparkContext.addPyFile(str(archive))


def prepare(spark: SparkSession) -> SparkSession:
    tune(spark)
    _ship(spark.sparkContext.applicationId)
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a whole table."""
    scan = prepare(spark).read.parquet(f"{folder}/{name}.parquet")
    return scan.select(*columns) if columns else scan


def store(df: DataFrame, *by: str) -> DataFrame:
    """Write to the cluster's shared folder and read back; survives lost executors.

    Columns `by` become folders, so a filter on them reads only its own files.
    """
    return cut(df, *by)


def free(df: DataFrame, name: str) -> str:
    """A column name that `df` does not use yet: `name`, with underscores behind it if need be."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def texts(column: pa.Array) -> list[str]:
    """Texts of an Arrow column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def record(names: Iterable[str], arrays: Iterable) -> pa.RecordBatch:
    made = [a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a) for a in arrays]
    return pa.RecordBatch.from_arrays(made, names=list(names))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys, one table each, from a partition sorted by the keys.

    Holds one group and one batch.
    """
    import numpy as np

    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns))
        starts = [i for i in range(1, len(rows)) if rows[i] != rows[i - 1]]
        if kept and rows[0] != last:
            yield pa.Table.from_batches(kept)
            kept = []
        for begin, end in zip([0, *starts], [*starts, len(rows)]):
            if begin:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(begin, end - begin))
        last = rows[-1]
    if kept:
        yield pa.Table.from_batches(kept)


def n_words(text: Column) -> Column:
    """Words of a text as a column; null has none."""
    trimmed = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(0)).otherwise(
        F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    )


def running_sums(df: DataFrame, groups: list[str], order: str, value: str, fan: int = 4096) -> DataFrame:
    """groups, order, `before`: the sum of `value` over smaller `order` in the group.

    `order` is a whole number from 0, unique in its group. Sums are made over stretches of
    `fan` numbers, then over the stretches, so a window holds rows / fan rows at most.
    """
    spans = df.select(*groups, order, value).withColumn("_span", F.floor(F.col(order) / fan))
    inner = Window.partitionBy(*groups, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*groups).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        spans.groupBy(*groups, "_span").agg(F.sum(value).alias("_sum"))
        .withColumn("_ahead", F.coalesce(F.sum("_sum").over(outer), F.lit(0)))
    )
    for name in [*groups, "_span"]:
        totals = totals.withColumnRenamed(name, f"_of_{name}")
    same = F.lit(True)
    for name in [*groups, "_span"]:
        same = same & F.col(name).eqNullSafe(F.col(f"_of_{name}"))
    return (
        spans.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(totals, same)
        .select(*groups, order, (F.col("_inner") + F.col("_ahead")).alias("before"))
    )
