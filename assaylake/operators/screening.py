"""Which parameters matter: main effects, and scaling of measured values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import correlation, mean, spread
from ..session import cut, small_side

KEYS = ["experiment_type", "name"]


def main_effects(long: DataFrame, keep: int = 2) -> DataFrame:
    """Effect of every parameter on the outcome, strongest first per type.

    long: experiment_type, name, value, outcome. The effect is the mean outcome with
    the parameter in the upper half of its observed range minus the mean in the lower
    half. `selected` marks the `keep` parameters worth varying.

    The rows are read once and summed per distinct value; ranges, halves and the
    correlation come from the stored sums.
    """
    x, y = F.col("value"), F.col("outcome")
    sums = long.groupBy(*KEYS, "value").agg(
        F.count("*").alias("n"),
        F.sum(x).alias("sx"),
        F.sum(y).alias("sy"),
        F.sum(x * x).alias("sxx"),
        F.sum(y * y).alias("syy"),
        F.sum(x * y).alias("sxy"),
    )
    sums = cut(sums)
    edges = sums.groupBy(*KEYS).agg(
        ((F.min("value") + F.max("value")).cast("double") / 2.0).alias("middle")
    )
    high = F.col("value").cast("double") >= F.col("middle")

    def part(column: str, upper: bool):
        zero = F.lit(0).cast("decimal(38,4)") if column == "sy" else F.lit(0)
        return F.sum(F.when(high if upper else ~high, F.col(column)).otherwise(zero))

    halves = (
        sums.join(edges, KEYS)
        .groupBy(*KEYS)
        .agg(
            part("n", True).alias("n_high"),
            part("n", False).alias("n_low"),
            part("sy", True).alias("y_high"),
            part("sy", False).alias("y_low"),
            *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")],
        )
    )
    effect = mean(F.col("y_high"), F.col("n_high")) - mean(F.col("y_low"), F.col("n_low"))
    sums_of = [F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]
    measured = halves.select(
        *KEYS,
        "n_high",
        "n_low",
        F.round(effect, 4).alias("effect"),
        F.round(correlation(*sums_of), 6).alias("correlation"),
    )
    # As many rows per type as there are parameters.
    order = Window.partitionBy("experiment_type").orderBy(
        F.desc_nulls_last(F.abs("effect")), "name"
    )
    return measured.withColumn("strength_rank", F.row_number().over(order)).withColumn(
        "selected", F.col("strength_rank") <= keep
    )


def scale_statistics(long: DataFrame) -> DataFrame:
    """Count, mean, spread, minimum and maximum per type and parameter."""
    x = F.col("value")
    sums = long.groupBy(*KEYS).agg(
        F.count("value").alias("n"),
        F.sum(x).alias("total"),
        F.sum(x * x).alias("squares"),
        F.min(x).cast("double").alias("low"),
        F.max(x).cast("double").alias("high"),
    )
    n = F.col("n")
    return sums.select(
        *KEYS,
        mean(F.col("total"), n).alias("mean"),
        spread(F.col("total"), F.col("squares"), n).alias("spread"),
        "low",
        "high",
    )


def normalise(long: DataFrame) -> DataFrame:
    """Values with missing ones filled by the mean, as z-score and on [0, 1].

    The statistics have one row per type and parameter. They are broadcast after their
    size was checked, so the values themselves are not shuffled.
    """
    stats = small_side(scale_statistics(long))
    x = F.coalesce(F.col("value").cast("double"), F.col("mean"))
    width = F.col("high") - F.col("low")
    return long.join(stats, KEYS).select(
        *long.columns,
        F.round(x, 6).alias("filled"),
        F.when(F.col("spread") > 0, F.round((x - F.col("mean")) / F.col("spread"), 6)).alias(
            "z_score"
        ),
        F.when(width > 0, F.round((x - F.col("low")) / width, 6)).alias("unit_scale"),
    )
