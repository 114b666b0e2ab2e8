"""Experiment tables: lists, parameters, checks, dashboard numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import failed
from ..functions.scoring import whole_percent
from .numbering import number_rows

# The experiment types a query form offers.
EXPERIMENT_TYPES = ("solubility", "crystallization", "reaction", "extraction")


def create_experiments(requests: DataFrame, last_number: int = 0) -> DataFrame:
    """Requests (seq, ...) with an `experiment_id` like exp_001, in arrival order."""
    numbered = number_rows(requests, "seq", "_number", last_number)
    return numbered.withColumn(
        "experiment_id", F.format_string("exp_%03d", F.col("_number"))
    ).drop("_number")


def list_experiments(experiments: DataFrame, users: DataFrame) -> DataFrame:
    """All experiments, with the name of their user or NULL where there is none."""
    owners = users.select(F.col("id").alias("user_id"), "username")
    return experiments.join(owners, "user_id", "left").select(*experiments.columns, "username")


def to_long(wide: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """One row (keys..., name, value) per parameter column that has a value."""
    return wide.unpivot(keys, names, "name", "value").filter(F.col("value").isNotNull())


def to_wide(parameters: DataFrame, names: list[str], key: str = "experiment_id") -> DataFrame:
    """One row per experiment with a column per named parameter."""
    return parameters.groupBy(key).agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names]
    )


def parameter_map(wide: DataFrame, names: list[str], column: str = "params") -> DataFrame:
    """Named parameters as one map column, without entries for missing values."""
    entries = F.map_from_arrays(
        F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n) for n in names])
    )
    return wide.withColumn(column, F.map_filter(entries, lambda _, v: v.isNotNull()))


def with_parameters(
    experiments: DataFrame, parameters: DataFrame, results: DataFrame
) -> DataFrame:
    """One row per experiment and parameter, with the experiment's result.

    All three join on `experiment_id`: tables saved by sources.sinks.save_bucketed
    join without an exchange.
    """
    return experiments.join(results, "experiment_id").join(parameters, "experiment_id")


def prediction_parameters(
    predictions: DataFrame, bridge: DataFrame, parameters: DataFrame
) -> DataFrame:
    """Predictions with each of their parameters (N:M through the bridge table)."""
    links = bridge.select("prediction_id", "parameter_id").distinct()
    return links.join(predictions, "prediction_id").join(parameters, "parameter_id")


def check_rows(rows: DataFrame, types: tuple[str, ...] = EXPERIMENT_TYPES) -> DataFrame:
    """Typed experiment columns plus `errors` for rows of text fields.

    rows: experiment_id, experiment_type, temperature, pressure, outcome, all text.
    """

    def unreadable(name: str):
        text = F.trim(name)
        return (text != "") & text.try_cast("double").isNull()

    def blank(name: str):
        return F.coalesce(F.trim(name) == "", F.lit(True))

    errors = failed(
        {
            "id_missing": blank("experiment_id"),
            "type_missing": blank("experiment_type"),
            "type_unknown": ~blank("experiment_type") & ~F.col("experiment_type").isin(*types),
            "temperature_unreadable": unreadable("temperature"),
            "pressure_unreadable": unreadable("pressure"),
            "pressure_negative": F.trim("pressure").try_cast("double") < 0,
            "outcome_missing": blank("outcome"),
            "outcome_unreadable": unreadable("outcome"),
        }
    )
    numbers = {n: F.trim(n).try_cast("double") for n in ("temperature", "pressure", "outcome")}
    return rows.withColumn("errors", errors).withColumns(numbers)


def orphans(relations: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Keys of child rows without a parent, with the number of such rows.

    relations: name -> (child, child key, parent, parent key). Child rows are counted
    and parent rows reduced per key before the join, so a hot key on either side
    crosses the network as one row per task.
    """

    def report(name: str, child: DataFrame, child_key: str, parent: DataFrame, parent_key: str):
        keys = (
            child.filter(F.col(child_key).isNotNull())
            .groupBy(F.col(child_key).cast("string").alias("missing_key"))
            .agg(F.count("*").alias("n_rows"))
        )
        present = parent.select(F.col(parent_key).cast("string").alias("missing_key")).distinct()
        return keys.join(present, "missing_key", "left_anti").select(
            F.lit(name).alias("relation"), "missing_key", "n_rows"
        )

    parts = [report(name, *relation) for name, relation in relations.items()]
    return reduce(DataFrame.unionByName, parts)


def dashboard(counts: DataFrame, users: DataFrame) -> DataFrame:
    """Experiments, successes and success rate in whole percent for every user.

    counts: user_id, experiments, successes; any number of partial rows per user.
    """
    per_user = counts.groupBy("user_id").agg(
        F.sum("experiments").alias("experiments"), F.sum("successes").alias("successes")
    )
    people = users.select(F.col("id").alias("user_id"))
    n, good = (F.coalesce(c, F.lit(0)) for c in ("experiments", "successes"))
    return people.join(per_user, "user_id", "left").select(
        "user_id",
        n.alias("experiments"),
        good.alias("successes"),
        whole_percent(good, n).alias("success_rate"),
    )
