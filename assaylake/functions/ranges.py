"""Range text as typed in the query form, and null-safe range predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _piece(text: Column, position: int) -> Column:
    return F.coalesce(F.get(F.split(text, "-"), F.lit(position)), F.lit(""))


def range_min(text: Column) -> Column:
    """Text before the first hyphen; a leading minus sign leaves it blank."""
    return _piece(text, 0)


def range_max(text: Column) -> Column:
    """Text between the first and the second hyphen, blank if there is none."""
    return _piece(text, 1)


def range_text(low: Column, high: Column) -> Column:
    blank = F.lit("")
    return F.concat_ws("-", F.coalesce(low, blank), F.coalesce(high, blank))


def bound(text: Column) -> Column:
    """Number in a bound's text; blank or unreadable text is no bound."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def within(value: Column, low: Column, high: Column) -> Column:
    """Inclusive on both ends; a NULL bound does not restrict."""
    return (low.isNull() | (value >= low)) & (high.isNull() | (value <= high))
