"""Dense numbering of rows in the order of a unique long column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

# Rows of one bucket, and buckets that one running sum may cover.
BITS = 20


def _rows_before(counts: DataFrame, bits: int) -> DataFrame:
    """counts(b, n): one row per bucket -> (b, before): rows in all earlier buckets.

    The counts are stored, being read several times. Up to 2**bits of them are summed in
    one window. More are summed inside groups of 2**bits neighbouring buckets, and the
    groups the same way one level up.
    """
    counts = cut(counts)
    if counts.count() <= 2**bits:
        order = Window.partitionBy(F.lit(0)).orderBy("b")
        earlier = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
        before = counts.select("b", F.coalesce(earlier, F.lit(0)).alias("before"))
        return F.broadcast(before)
    grouped = counts.withColumn("up", F.shiftright("b", bits))
    order = Window.partitionBy("up").orderBy("b")
    earlier = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    local = grouped.select("b", "up", F.coalesce(earlier, F.lit(0)).alias("local"))
    totals = grouped.groupBy(F.col("up").alias("b")).agg(F.sum("n").alias("n"))
    upper = _rows_before(totals, bits).withColumnRenamed("b", "up")
    return local.join(upper, "up").select("b", (F.col("local") + F.col("before")).alias("before"))


def number_rows(
    df: DataFrame, order: str, name: str, start: int | Column = 0, bits: int = BITS
) -> DataFrame:
    """Add `name` = start + 1, 2, 3 ... in the order of the unique long `order`.

    Rows are put in buckets of 2**bits consecutive order values, so no task sorts more
    than that many rows however `order` is spread; rows are numbered per bucket and
    shifted by the number of rows in earlier buckets. `df` is read twice, the first time
    for `order` alone.
    """
    keyed = df.withColumn("_bucket", F.shiftright(order, bits))
    counts = keyed.groupBy(F.col("_bucket").alias("b")).agg(F.count("*").alias("n"))
    before = _rows_before(counts, bits).withColumnRenamed("b", "_bucket")
    position = F.row_number().over(Window.partitionBy("_bucket").orderBy(order))
    base = start if isinstance(start, Column) else F.lit(start)
    return (
        keyed.withColumn("_position", position)
        .join(before, "_bucket")
        .withColumn(name, (base + F.col("before") + F.col("_position")).cast("long"))
        .drop("_bucket", "_position", "before")
    )
