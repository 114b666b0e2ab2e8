"""Row checks: every failed rule adds its code to an array column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failed(rules: dict[str, Column]) -> Column:
    """Array of the codes whose condition is true, in the order given; codes hold no comma.

    A lambda over the codes would have every rule interpreted row by row; joined text is compiled.
    """
    codes = [F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in rules.items()]
    joined = F.concat_ws(",", *codes)
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, ","))


def split_rows(df: DataFrame, errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    """(good rows without the error column, rejected rows with it)."""
    return df.filter(F.size(errors) == 0).drop(errors), df.filter(F.size(errors) > 0)
