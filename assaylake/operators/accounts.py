"""Account batches: registration, patches, deletions, lookups.

A batch is decided as a set. Names are compared with the users at the start of the
batch; among requests of the batch the first by `seq` gets a name. A name that is
given up and taken again inside one batch therefore needs two batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.checks import failed
from ..functions.names import MAX_LENGTH, email_valid, fits, join_by_name, look_up_names, name_key
from ..session import cut
from .numbering import number_rows

# Answers to account requests, and the role of a new user.
CREATED, CHANGED, DELETED = 201, 200, 204
NAME_TAKEN, NOT_FOUND, INVALID = 400, 404, 422
NEW_ROLE = "user"

PATCH_FIELDS = ["username", "email", "password_hash", "role", "is_active", "last_login_at"]


# --- lookups -----------------------------------------------------------------


def public_view(users: DataFrame) -> DataFrame:
    return users.select(*schemas.PUBLIC_USER)


def find_by_id(requests: DataFrame, users: DataFrame) -> DataFrame:
    """requests(seq, id) with the public user columns and status 200 or 404."""
    seen = public_view(users).withColumn("_found", F.lit(True))
    return requests.join(seen, "id", "left").select(
        *requests.columns,
        F.when(F.col("_found"), CHANGED).otherwise(NOT_FOUND).alias("status"),
        *[c for c in schemas.PUBLIC_USER if c != "id"],
    )


def find_by_name(requests: DataFrame, users: DataFrame) -> DataFrame:
    """requests(..., username) with the id of the user of that name or NULL."""
    known = users.select("id", F.col("username").alias("_known"))
    found = look_up_names(requests, known, "username", "_known")
    return found.select(*requests.columns, "id")


# --- registration ------------------------------------------------------------


def registration_errors() -> Column:
    name, mail = F.col("username"), F.col("email")
    return failed(
        {
            "username_missing": name.isNull(),
            "username_too_long": ~fits(name, MAX_LENGTH["username"]),
            "email_invalid": ~email_valid(mail),
            "email_too_long": ~fits(mail, MAX_LENGTH["email"]),
            "password_missing": F.col("password_hash").isNull(),
        }
    )


def _first_claims(requests: DataFrame, *columns: str) -> DataFrame:
    """First request by `seq` for every name.

    Reduced on the map side: a name claimed by a third of the batch sends one row per
    map task, and no task holds all its requests.
    """
    first = F.min_by(F.struct("seq", "username", *columns), "seq")
    return requests.groupBy(name_key("username").alias("_key")).agg(first.alias("r")).select("r.*")


def _free(claims: DataFrame, users: DataFrame) -> DataFrame:
    """Claims (one per name) on names that no user has."""
    taken = users.select(F.col("username").alias("_taken"))
    return join_by_name(claims, taken, "username", "_taken", "left_anti")


def _granted(checked: DataFrame, users: DataFrame) -> DataFrame:
    """`seq` of the valid requests that get their name."""
    return _free(_first_claims(checked.filter(F.size("errors") == 0)), users).select("seq")


def register(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Rows to append to the users table, with the `seq` of their request."""
    # Numbering reads the granted requests twice, so their `seq` is stored; e-mail and
    # password hash stay in the requests.
    granted = cut(_granted(requests.withColumn("errors", registration_errors()), users))
    last_id = F.coalesce(users.agg(F.max("id")).scalar(), F.lit(0))
    return requests.join(number_rows(granted, "seq", "id", last_id), "seq").select(
        "seq",
        "id",
        "username",
        "email",
        "password_hash",
        F.lit(NEW_ROLE).alias("role"),
        F.lit(True).alias("is_active"),
        "created_at",
        F.lit(None).cast("timestamp").alias("last_login_at"),
    )


def registration_answers(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Status and error codes of every registration request."""
    checked = requests.withColumn("errors", registration_errors())
    granted = _granted(checked, users).withColumn("_granted", F.lit(True))
    return checked.join(granted, "seq", "left").select(
        *requests.columns,
        "errors",
        F.when(F.size("errors") > 0, INVALID)
        .when(F.col("_granted"), CREATED)
        .otherwise(NAME_TAKEN)
        .alias("status"),
    )


# --- patches -----------------------------------------------------------------


def patch_errors() -> Column:
    name, mail, role = F.col("username"), F.col("email"), F.col("role")
    return failed(
        {
            "username_too_long": ~fits(name, MAX_LENGTH["username"]),
            "email_invalid": mail.isNotNull() & ~email_valid(mail),
            "email_too_long": ~fits(mail, MAX_LENGTH["email"]),
            "role_too_long": ~fits(role, MAX_LENGTH["role"]),
        }
    )


def decide_patches(patches: DataFrame, users: DataFrame) -> DataFrame:
    """Patches with `status`: 422 malformed, 404 no such user, 400 name taken, 200.

    A name that differs from the user's own byte for byte is a rename. It is refused
    if any user, the sender included, has an equal name, and the whole patch with it.
    Of several renames to one name the first wins; the same user may repeat it as
    spelled the first time.
    """
    own = users.select(F.col("id").alias("user_id"), F.col("username").alias("_own"))
    known = patches.withColumn("_errors", patch_errors()).join(own, "user_id", "left")
    rename = (
        (F.size("_errors") == 0)
        & F.col("_own").isNotNull()
        & F.coalesce(F.col("username") != "", F.lit(False))
        & (F.col("username") != F.col("_own"))
    )
    known = known.withColumn("_rename", F.coalesce(rename, F.lit(False)))
    # Winners have one row per name, and user and spelling identify the requests
    # they allow, so the many requests for one hot name spread over their users.
    winners = _free(_first_claims(known.filter("_rename"), "user_id"), users).select(
        "user_id", "username", F.lit(True).alias("_won")
    )
    decided = known.join(winners, ["user_id", "username"], "left")
    status = (
        F.when(F.size("_errors") > 0, INVALID)
        .when(F.col("_own").isNull(), NOT_FOUND)
        .when(F.col("_rename") & F.col("_won").isNull(), NAME_TAKEN)
        .otherwise(CHANGED)
    )
    return decided.select(*patches.columns, status.alias("status"))


def latest_fields(decided: DataFrame) -> DataFrame:
    """Per user the last value given for each field by accepted patches."""
    given = {field: F.col(field).isNotNull() for field in PATCH_FIELDS}
    given["username"] = F.col("username") != ""
    return (
        decided.filter(F.col("status") == CHANGED)
        .groupBy("user_id")
        .agg(*[F.max_by(f, F.when(given[f], F.col("seq"))).alias(f) for f in PATCH_FIELDS])
    )


def apply_patches(users: DataFrame, decided: DataFrame) -> DataFrame:
    """Users table after a decided batch of patches."""
    latest = latest_fields(decided)
    latest = latest.select(
        F.col("user_id").alias("id"), *[F.col(f).alias(f"_new_{f}") for f in PATCH_FIELDS]
    )
    return (
        users.join(latest, "id", "left")
        .withColumns({f: F.coalesce(f"_new_{f}", f) for f in PATCH_FIELDS})
        .select(*users.columns)
    )


# --- deletions ---------------------------------------------------------------


def decide_deletes(requests: DataFrame, users: DataFrame) -> DataFrame:
    """204 for the first request per existing user, 404 for all others."""
    first = requests.groupBy("user_id").agg(F.min("seq").alias("seq"))
    existing = users.select(F.col("id").alias("user_id"))
    done = first.join(existing, "user_id", "left_semi").select(
        "seq", F.lit(True).alias("_done")
    )
    return requests.join(done, "seq", "left").select(
        *requests.columns,
        F.when(F.col("_done"), DELETED).otherwise(NOT_FOUND).alias("status"),
    )


def apply_deletes(users: DataFrame, requests: DataFrame) -> DataFrame:
    gone = requests.select(F.col("user_id").alias("id")).distinct()
    return users.join(gone, "id", "left_anti")


def release_audit(audit: DataFrame, requests: DataFrame) -> DataFrame:
    """Audit rows outlive their user; only the reference to the user is cleared."""
    gone = requests.select("user_id").distinct().withColumn("_gone", F.lit(True))
    return (
        audit.join(gone, "user_id", "left")
        .withColumn("user_id", F.when(F.col("_gone").isNull(), F.col("user_id")))
        .select(*audit.columns)
    )
