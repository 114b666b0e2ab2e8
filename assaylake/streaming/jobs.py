"""Login decisions, usage and dashboard counts, and feedback as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.feedback import read_feedback
from ..operators.learning import moments
from ..operators.logins import (
    audit_rows,
    decide_logins,
    login_answers,
    number_attempts,
    usage,
)
from ..sources.tables import read_audit


USAGE_KEYS = ["window_start", "window_end", "username"]
DASHBOARD_KEYS = ["window_start", "user_id"]


def dashboard_counts(results: DataFrame, width: str = "1 hour") -> DataFrame:
    """Experiments and successes per window and user.

    results: user_id, success, created_at. The windows of a user add up to the
    `counts` that operators.experiments.dashboard takes.
    """
    return (
        results.groupBy(F.window("created_at", width).alias("w"), "user_id")
        .agg(F.count("*").alias("experiments"), F.count_if("success").alias("successes"))
        .select(
            F.col("w.start").alias("window_start"), "user_id", "experiments", "successes"
        )
    )


def usage_stream(
    audit: DataFrame, folder: str, width: str = "1 hour", trigger: dict | None = None
) -> StreamingQuery:
    """Partial usage counts of every micro-batch below `folder`; read with `summed`."""
    return _count_stream(audit, folder, lambda batch: usage(batch, width), trigger)


def dashboard_stream(
    results: DataFrame, folder: str, width: str = "1 hour", trigger: dict | None = None
) -> StreamingQuery:
    """Partial dashboard counts of every micro-batch; read with `summed`."""
    return _count_stream(results, folder, lambda batch: dashboard_counts(batch, width), trigger)


def _count_stream(
    stream: DataFrame, folder: str, count: Callable[[DataFrame], DataFrame], trigger: dict | None
) -> StreamingQuery:
    """A batch that is repeated replaces its own counts, so nothing counts twice; no state
    is kept and no row is ever too late."""

    def write(batch: DataFrame, number: int) -> None:
        count(batch).write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    return _each_batch(stream, folder, write, trigger)


def summed(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The counts of all micro-batches so far, added up per key."""
    parts = spark.read.parquet(f"{folder}/counts").drop("batch")
    counts = [c for c in parts.columns if c not in keys]
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])


def _each_batch(
    stream: DataFrame,
    folder: str,
    write: Callable[[DataFrame, int], None],
    trigger: dict | None = None,
) -> StreamingQuery:
    """`trigger` as for writeStream.trigger, by default until the input is read."""
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/state")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _last_id(spark: SparkSession, folder: str, batch: int) -> int:
    """Last id given out by the batch before; every batch leaves one row."""
    if batch == 0:
        return 0
    return spark.read.parquet(f"{folder}/last_id/batch={batch - 1}").first()["last_id"]


def _merged_logins(spark: SparkSession, folder: str, latest: DataFrame, batch: int) -> None:
    """The last login of every user after `batch`: that of the snapshot before, or later.

    Snapshot n is made of snapshot n - 1 and batch n alone, so a batch that is repeated
    after a failure writes the same snapshot again. Two older ones are kept, no more.
    """
    path = f"{folder}/last_logins/batch="
    merged = latest
    if batch:
        merged = latest.unionByName(spark.read.schema(latest.schema).parquet(f"{path}{batch - 1}"))
    newest = F.max_by(F.struct("last_login_at", "seq"), "seq").alias("newest")
    merged.groupBy("user_id").agg(newest).select("user_id", "newest.*").write.mode("overwrite").parquet(f"{path}{batch}")
    if batch > 2:
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}{batch - 3}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


def latest_logins(spark: SparkSession, folder: str) -> DataFrame:
    """user_id, last_login_at after the last batch of a `login_stream`; none before the first."""
    kinds = "user_id long, last_login_at timestamp, seq long, batch int"
    kept = spark.read.schema(kinds).parquet(f"{folder}/last_logins")
    last = kept.agg(F.max("batch").alias("batch")).first()["batch"]
    return kept.filter(F.col("batch") == F.lit(last)).select("user_id", "last_login_at")


def stream_audit(spark: SparkSession, folder: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Audit rows of a `login_stream`, of the days first..last only; other days are not read."""
    return read_audit(spark, f"{folder}/audit", first, last).drop("dt", "batch")


def login_stream(attempts: DataFrame, users: DataFrame, folder: str) -> StreamingQuery:
    """Decide a stream of login attempts: audit rows, answers and last logins.

    Audit rows land by day, in dt=<day>/batch=<n>; a micro-batch that is repeated after a
    failure replaces what it wrote and nothing else, so no attempt is recorded twice. Audit
    rows are written first. Their numbers continue those of earlier batches. A user's last
    login is that of the attempt of largest seq (see `latest_logins`).
    """

    def write(batch_rows: DataFrame, batch: int) -> None:
        spark = batch_rows.sparkSession
        last_id = _last_id(spark, folder, batch)
        decided = decide_logins(number_attempts(batch_rows, last_id), users).persist()
        try:
            dated = audit_rows(decided).withColumns({"dt": F.to_date("created_at"), "batch": F.lit(batch)})
            by_day = dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            by_day.partitionBy("dt", "batch").parquet(f"{folder}/audit")
            answers = login_answers(decided)
            answers.write.mode("overwrite").parquet(f"{folder}/answers/batch={batch}")
            newest = F.max_by(F.struct(F.col("created_at").alias("last_login_at"), "seq"), "seq").alias("newest")
            granted = decided.filter("ok").groupBy("user_id").agg(newest)
            _merged_logins(spark, folder, granted.select("user_id", "newest.*"), batch)
            given = spark.createDataFrame([(last_id + decided.count(),)], "last_id long")
            given.coalesce(1).write.mode("overwrite").parquet(f"{folder}/last_id/batch={batch}")
        finally:
            decided.unpersist()

    return _each_batch(attempts, folder, write)


def feedback_stream(messages: DataFrame, folder: str) -> StreamingQuery:
    """Sort JSON feedback messages (`body`) into a table and a table of rejects."""

    def write(batch_rows: DataFrame, batch: int) -> None:
        rows, rejected = read_feedback(batch_rows)
        rows.write.mode("overwrite").parquet(f"{folder}/feedback/batch={batch}")
        rejected.write.mode("overwrite").parquet(f"{folder}/rejected/batch={batch}")

    return _each_batch(messages, folder, write)


def learning_stream(
    messages: DataFrame, predictions: DataFrame, features: list[str], folder: str
) -> StreamingQuery:
    """Learn ratings from JSON feedback messages: sums of every micro-batch, one row each.

    A batch that is repeated replaces its own row, so no rating counts twice. The model is
    solved from the rows when it is asked for (see `learned`).
    """

    def write(batch_rows: DataFrame, batch: int) -> None:
        rows, _ = read_feedback(batch_rows)
        sums = moments(rows, predictions, features)
        sums.write.mode("overwrite").parquet(f"{folder}/moments/batch={batch}")

    return _each_batch(messages, folder, write)


def learned(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of sums of a `learning_stream`, with their `batch`."""
    return spark.read.parquet(f"{folder}/moments")
