"""Feedback on predictions: effectiveness of parameters, agreement, intake."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.requests import parse_json
from ..functions.scoring import mean


def read_feedback(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(feedback rows, unreadable messages) from a `body` column of JSON texts."""
    parsed = messages.withColumn("_row", parse_json(F.col("body"), schemas.FEEDBACK))
    good = parsed.filter(F.col("_row").isNotNull())
    rows = good.select(*[F.col(f"_row.{name}").alias(name) for name in schemas.FEEDBACK.names])
    return rows, parsed.filter(F.col("_row").isNull()).drop("_row")


def effectiveness(
    feedback: DataFrame, bridge: DataFrame, parameters: DataFrame, width: float
) -> DataFrame:
    """Mean rating and success count per parameter name and value bin.

    Ratings are summed per prediction before they meet the predictions' parameters,
    so a prediction with very many ratings is one row in the join.
    """
    per_prediction = feedback.groupBy("prediction_id").agg(
        F.count("rating").alias("ratings"),
        F.sum("rating").alias("total"),
        F.count_if("success").alias("successes"),
    )
    links = bridge.select("prediction_id", "parameter_id").distinct()
    value_bin = F.floor(F.col("value").cast("double") / width).cast("long")
    rated = (
        links.join(per_prediction, "prediction_id")
        .join(parameters, "parameter_id")
        .groupBy("name", value_bin.alias("value_bin"))
        .agg(
            F.sum("ratings").alias("ratings"),
            F.sum("total").alias("total"),
            F.sum("successes").alias("successes"),
        )
    )
    return rated.select(
        "name",
        "value_bin",
        "ratings",
        "successes",
        F.round(mean(F.col("total"), F.col("ratings")), 4).alias("mean_rating"),
    )


def compare_feedback(feedback: DataFrame, predictions: DataFrame) -> DataFrame:
    """Feedback rows with the predicted success and whether it came true."""
    predicted = predictions.select("prediction_id", "predicted_success")
    return feedback.join(predicted, "prediction_id").withColumn(
        "matches", F.col("success").eqNullSafe(F.col("predicted_success"))
    )
