"""Linear models from sums that can be added up: no rating is read twice."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT = "decimal(18,4)"


def _pairs(features: list[str]) -> list[tuple[int, int]]:
    return list(combinations_with_replacement(range(len(features)), 2))


def moments(feedback: DataFrame, predictions: DataFrame, features: list[str]) -> DataFrame:
    """One row of sums over the ratings of predictions: n, y, yy, x<i>, x<i>y, x<i>x<j>.

    feedback: prediction_id, rating. predictions: prediction_id, unique, and the features.
    Ratings are summed per prediction before they meet its features, so a prediction with
    very many ratings is one row in the join. Values count to four places and sums are
    exact. Ratings that are NULL, or whose prediction is unknown or lacks a feature, take
    no part. Without any rating all sums are 0.
    """
    y = F.col("rating").cast(EXACT)
    per_prediction = feedback.filter(y.isNotNull()).groupBy("prediction_id").agg(
        F.count("*").alias("_n"), F.sum(y).alias("_y"), F.sum(y * y).alias("_yy")
    )
    x = [F.col(name).cast(EXACT) for name in features]
    given = predictions.select("prediction_id", *[c.alias(f"_x{i}") for i, c in enumerate(x)]).dropna()
    n, x = F.col("_n").cast("decimal(12,0)"), [F.col(f"_x{i}") for i in range(len(features))]

    def total(value: Column, name: str) -> Column:
        return F.coalesce(F.sum(value.cast("decimal(38,8)")), F.lit(0).cast("decimal(38,8)")).alias(name)

    return per_prediction.join(given, "prediction_id").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"),
        total(F.col("_y"), "y"),
        total(F.col("_yy"), "yy"),
        *[total(x[i] * n, f"x{i}") for i in range(len(x))],
        *[total(x[i] * F.col("_y").cast("decimal(20,4)"), f"x{i}y") for i in range(len(x))],
        *[total((x[i] * x[j]).cast("decimal(26,8)") * n, f"x{i}x{j}") for i, j in _pairs(features)],
    )


def added(parts: DataFrame, decay: float = 1.0) -> DataFrame:
    """The sums of numbered batches (`batch`) as one row.

    A batch counts `decay` times as much as the one after it; 1 gives exact sums.
    """
    names = [c for c in parts.columns if c != "batch"]
    if decay == 1.0:
        return parts.agg(*[F.sum(c).alias(c) for c in names])
    last = parts.agg(F.max("batch")).first()[0] or 0
    weight = F.pow(F.lit(decay), F.lit(last) - F.col("batch"))
    return parts.agg(*[F.sum(F.col(c).cast("double") * weight).alias(c) for c in names])


def solve(sums: DataFrame, features: list[str], ridge: float = 0.0) -> dict[str, float]:
    """Coefficients by least squares from one row of sums; `intercept` is one of them.

    The sums are centred first. Features that carry nothing of their own share what they
    explain (the solution of least norm). Without ratings all coefficients are 0.
    """
    row = sums.first()
    n = float(row["n"] or 0)
    if not n:
        return dict.fromkeys(["intercept", *features], 0.0)
    mean_x = np.array([float(row[f"x{i}"]) for i in range(len(features))]) / n
    mean_y = float(row["y"]) / n
    square = np.zeros((len(features), len(features)))
    for i, j in _pairs(features):
        square[i, j] = square[j, i] = float(row[f"x{i}x{j}"]) / n - mean_x[i] * mean_x[j]
    cross = np.array([float(row[f"x{i}y"]) / n - mean_x[i] * mean_y for i in range(len(features))])
    slopes = np.linalg.lstsq(square + ridge * np.eye(len(features)), cross, rcond=1e-12)[0]
    return {"intercept": mean_y - float(slopes @ mean_x), **dict(zip(features, map(float, slopes)))}


def add_expected(rows: DataFrame, model: dict[str, float], column: str = "expected") -> DataFrame:
    """Rows with the rating that the model expects."""
    value = F.lit(model["intercept"])
    for name, slope in model.items():
        if name != "intercept":
            value = value + F.col(name).cast("double") * F.lit(slope)
    return rows.withColumn(column, value)
