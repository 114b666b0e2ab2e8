"""User names: equality, length limits, e-mail shape, avatar initial."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column widths of the account tables.
MAX_LENGTH = {"username": 64, "email": 255, "role": 32, "ip": 45}

# Shortest password the sign-up form takes.
MIN_PASSWORD = 6

EMAIL_SHAPE = r"^[^@\s]+@[^@\s]+\.[^@\s]+\z"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def name_key(c: str | Column) -> Column:
    """Names are equal without regard to case and accents; blanks count."""
    return F.collate(_col(c), "UNICODE_CI_AI")


def join_by_name(
    left: DataFrame, right: DataFrame, left_name: str, right_name: str, how: str
) -> DataFrame:
    """Join on equal names.

    The keys are columns of their own: joined on columns, names are hashed by their
    collation key, and a small side can be broadcast. Compared inside the condition they
    would always be sorted on both sides.
    """
    keyed = left.withColumn("_left_key", name_key(left_name))
    other = right.withColumn("_right_key", name_key(right_name))
    joined = keyed.join(other, F.col("_left_key") == F.col("_right_key"), how)
    return joined.drop("_left_key", "_right_key")


def look_up_names(requests: DataFrame, known: DataFrame, name: str, known_name: str) -> DataFrame:
    """All requests, each with the columns of the one row of `known` of equal name.

    Collation keys are costly, and one name may make up much of a batch. So every
    spelling is looked up once, and requests meet the result by plain equality. A stream
    would have to remember the spellings; it is joined directly.
    """
    if requests.isStreaming:
        return join_by_name(requests, known, name, known_name, "left")
    spellings = requests.select(name).distinct()
    return requests.join(join_by_name(spellings, known, name, known_name, "inner"), name, "left")


def email_valid(c: str | Column) -> Column:
    return F.coalesce(_col(c).rlike(EMAIL_SHAPE), F.lit(False))


def fits(c: str | Column, limit: int) -> Column:
    """NULL fits; a value fits if it has at most `limit` characters."""
    return F.coalesce(F.length(_col(c)) <= limit, F.lit(True))


def form_accepts(password: str | Column, confirmation: str | Column) -> Column:
    """The sign-up form's rule: both inputs equal and long enough."""
    first = _col(password)
    return first.eqNullSafe(_col(confirmation)) & F.coalesce(
        F.length(first) >= MIN_PASSWORD, F.lit(False)
    )


def initial(c: str | Column) -> Column:
    return F.upper(F.substring(_col(c), 1, 1))
