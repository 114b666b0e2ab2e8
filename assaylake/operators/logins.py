"""Login batches: decision, audit rows, last login, answers, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import look_up_names
from ..functions.requests import TOKEN_MINUTES, token_expiry, token_subject
from .numbering import number_rows

# Answers to a login request.
GRANTED, REFUSED = 200, 401


def decide_logins(attempts: DataFrame, users: DataFrame) -> DataFrame:
    """Attempts with `user_id`, `ok` and `status`.

    A login succeeds if the user exists, is active and the password was right. All
    failures get the same status. Every attempt is kept: a name nobody has keeps a
    NULL `user_id`.

    """
    known = users.select(
        F.col("id").alias("user_id"), F.col("username").alias("_known"), "is_active"
    )
    ok = F.coalesce(
        F.col("user_id").isNotNull() & F.col("is_active") & F.col("password_ok"), F.lit(False)
    )
    return look_up_names(attempts, known, "username", "_known").select(
        *attempts.columns,
        "user_id",
        ok.alias("ok"),
        F.when(ok, GRANTED).otherwise(REFUSED).alias("status"),
    )


def number_attempts(attempts: DataFrame, last_id: int = 0) -> DataFrame:
    """Attempts with the `id` of their audit row, behind `last_id` in arrival order.

    Every attempt gets an audit row, so rows are numbered before they are decided:
    counting them reads `seq` alone and no join.
    """
    return number_rows(attempts, "seq", "id", last_id)


def audit_rows(decisions: DataFrame) -> DataFrame:
    """Audit rows of numbered and decided attempts."""
    return decisions.select("id", "user_id", "username", "ip", "ok", "created_at")


def last_logins(decisions: DataFrame) -> DataFrame:
    """Time of each user's last successful attempt in the batch."""
    return (
        decisions.filter("ok")
        .groupBy("user_id")
        .agg(F.max_by("created_at", "seq").alias("last_login_at"))
    )


def set_last_logins(users: DataFrame, latest: DataFrame) -> DataFrame:
    fresh = latest.select(
        F.col("user_id").alias("id"), F.col("last_login_at").alias("_fresh")
    )
    return (
        users.join(fresh, "id", "left")
        .withColumn("last_login_at", F.coalesce("_fresh", "last_login_at"))
        .select(*users.columns)
    )


def login_answers(decisions: DataFrame, minutes: int = TOKEN_MINUTES) -> DataFrame:
    """Status per attempt; subject and expiry of the token for granted ones."""
    granted = F.col("ok")
    return decisions.select(
        "seq",
        "status",
        F.when(granted, token_subject(F.col("user_id"))).alias("subject"),
        F.when(granted, token_expiry(F.col("created_at"), minutes)).alias("expires_at"),
    )


def usage(audit: DataFrame, width: str = "1 hour") -> DataFrame:
    """Attempts and failures per time window and name."""
    return (
        audit.groupBy(F.window("created_at", width).alias("w"), "username")
        .agg(F.count("*").alias("attempts"), F.count_if(~F.col("ok")).alias("failures"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "username",
            "attempts",
            "failures",
        )
    )
