"""Validity intervals of entity versions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, discard

BUCKET = "history_bucket"


def versions(changes: DataFrame, key: str, seq: str, seconds: int = 3600) -> DataFrame:
    """Changes (key, valid_from, seq, ...) with `valid_to` and `is_current`.

    A version ends where the next one of its key starts. The next start is looked up
    inside time slices of `seconds` and, for the last version of a slice, from the first
    start of the key's next slice; one key with very many changes is therefore sorted
    slice by slice in many tasks. NULL keys are a key, and changes without `valid_from`
    come before all others of their key.
    """
    slice_of = F.floor(F.unix_seconds("valid_from") / seconds)
    sliced = changes.withColumn("_slice", slice_of)
    within = Window.partitionBy(key, "_slice").orderBy("valid_from", seq)
    firsts = sliced.groupBy(key, "_slice").agg(F.min("valid_from").alias("_first"))
    following = firsts.select(
        F.col(key).alias("_key"),
        F.col("_slice").alias("_at"),
        F.lead("_first").over(Window.partitionBy(key).orderBy("_slice")).alias("_following"),
    )
    return (
        sliced.withColumn("_next", F.lead("valid_from").over(within))
        .join(following, F.col(key).eqNullSafe(F.col("_key")) & F.col("_slice").eqNullSafe(F.col("_at")))
        .withColumn("valid_to", F.coalesce("_next", "_following"))
        .withColumn("is_current", F.col("valid_to").isNull())
        .select(*changes.columns, "valid_to", "is_current")
    )


def read_history(spark: SparkSession, root: str) -> DataFrame:
    """The history that `merge_changes` keeps below `root`."""
    return spark.read.parquet(root).drop(BUCKET)


def merge_changes(changes: DataFrame, root: str, key: str, seq: str, buckets: int = 256) -> int:
    """Merge a batch of changes into the history below `root`; returns how many buckets it touched.

    The history is stored in `buckets` folders by a hash of the key, and every batch must
    be merged with the same number. Only folders of keys in the batch are read and
    written again, so a late change splits the version it falls into and all other files
    stay. A change is known by key and `seq` (NULLs are values): repeating a batch changes
    nothing, and a change given again replaces the stored one. Rows of a batch that repeat both
    count once, the one that sorts last by all columns.

    One writer at a time. A batch that dies while folders are switched must be merged
    again before the next.
    """
    spark = changes.sparkSession
    names = changes.columns
    taken = {"valid_to", "is_current", BUCKET} & {c.lower() for c in names}
    if taken:
        raise ValueError(f"changes must not have the columns {sorted(taken)}")
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
    batch = cut(
        changes.groupBy(key, seq)
        .agg(F.max(F.struct(*[c for c in names if c not in (key, seq)])).alias("_row"))
        .select(key, seq, "_row.*")
        .select(*names, bucket.alias(BUCKET))
    )
    # At most `buckets` numbers; with them in the filter only their folders are listed and read.
    touched = [row[0] for row in batch.select(BUCKET).distinct().collect()]
    whole = batch
    try:
        stored = spark.read.parquet(root).where(F.col(BUCKET).isin(touched)).select(*names, BUCKET)
        same = F.col("n.k").eqNullSafe(F.col(key)) & F.col("n.s").eqNullSafe(F.col(seq))
        given = batch.select(F.col(key).alias("k"), F.col(seq).alias("s")).alias("n")
        whole = stored.join(given, same, "left_anti").unionByName(batch)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise  # otherwise the first batch
    if touched:
        merged = cut(versions(whole, key, seq))
        (
            # Splits the bucket of a key with very many changes over several tasks.
            merged.hint("rebalance", BUCKET)
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy(BUCKET).parquet(root)
        )
        discard(merged)
    discard(batch)
    return len(touched)
