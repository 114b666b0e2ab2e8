"""Outcome and success models on Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import (
    Imputer,
    OneHotEncoder,
    PolynomialExpansion,
    QuantileDiscretizer,
    StandardScaler,
    StringIndexer,
    UnivariateFeatureSelector,
    VectorAssembler,
)
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, small_side

SEED = 17
FOLDS = 5
# Training folds whose rows are scored by models of the other training folds.
HALVES = ((1, 2), (3, 4))
# Trees split a parameter between at most this many bins (Spark's maxBins).
BINS = 32
# Experiments of equal fold, type and bins are summed in this many groups a fold.
GROUPS = 8


def fold_of(key: str) -> Column:
    """Fold of an experiment: 32 bits of md5 of its id, which SQL engines agree on."""
    number = F.conv(F.substring(F.md5(F.col(key)), 1, 8), 16, 10).cast("bigint")
    return (number % FOLDS).cast("int")


def model_rows(observations: DataFrame, params: list[str]) -> DataFrame:
    """Doubles for the learners, and a fold that depends on the experiment only.

    Missing parameters stay NULL; the learners fill them with the mean of the rows that
    they were fitted on.
    """
    fold = fold_of("experiment_id")
    return observations.select(
        "experiment_id",
        "experiment_type",
        *[F.col(p).cast("double").alias(p) for p in params],
        F.col("outcome").cast("double").alias("label"),
        F.col("success").cast("double").alias("success"),
        fold.alias("fold"),
    )


def training(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("fold") != 0)


def holdout(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("fold") == 0)


def binning(params: list[str]) -> Pipeline:
    """Missing parameters filled by the mean, and the number of each one's quantile bin."""
    filled = [f"{p}_known" for p in params]
    return Pipeline(
        stages=[
            Imputer(inputCols=params, outputCols=filled, strategy="mean"),
            QuantileDiscretizer(
                inputCols=filled, outputCols=binned(params), numBuckets=BINS, relativeError=0.001
            ),
        ]
    )


def binned(params: list[str]) -> list[str]:
    return [f"{p}_bin" for p in params]


def cells(rows: DataFrame, bins: PipelineModel, params: list[str]) -> DataFrame:
    """Sums of all `rows`: experiment_type, fold, <param>_bin, mean `label`, number `weight`.

    Trees see a parameter by its bin only, and the spread of labels inside a cell is the same
    before and after any split, so they grow from cells with weights as from the rows. A
    fold's rows of a cell are dealt to GROUPS groups by their id, and a forest draws
    groups: the mean of so drawn groups varies as that of drawn rows does.
    """
    keys = ["fold", "experiment_type", *binned(params)]
    group = F.pmod(F.xxhash64("experiment_id"), F.lit(GROUPS)).alias("group")
    summed = (
        bins.transform(rows).select(*keys, group, "label")
        .groupBy(*keys, "group")
        .agg(F.sum("label").alias("total"), F.count("label").alias("known"), F.count("*").alias("n"))
    )
    # A row without label makes its cell one, which the learners refuse as they refuse the row.
    total = F.when(F.col("known") == F.col("n"), F.col("total"))
    return summed.select(
        *keys, "group", (total / F.col("n")).alias("label"), F.col("n").cast("double").alias("weight")
    ).sort(*keys, "group")


class Trees:
    """Models fitted on the cells of the training rows.

    `learners`: functions such as `forest`. The rows are read three times, whatever the
    number of learners, trees and rounds. `known` holds the stored cells of all rows.
    """

    def __init__(self, rows: DataFrame, params: list[str], learners: dict[str, Callable[..., Pipeline]]):
        self.params = params
        self.pipelines = {name: learner(binned(params), weight="weight") for name, learner in learners.items()}
        self.bins = binning(params).fit(training(rows))
        self.known = cut(cells(rows, self.bins, params))
        self.models = {name: line.fit(training(self.known)) for name, line in self.pipelines.items()}

    def out_of_fold(self) -> DataFrame:
        return out_of_fold(training(self.known), self.pipelines)

    def predict(self, given: DataFrame, among: DataFrame | None = None) -> DataFrame:
        """`given` with the prediction of each model, which scores every cell once.

        `among`: a stored table with the cells of `given`, such as `known` for the rows that
        it was made of; without it they are found by one more pass over `given`.
        """
        keys = ["experiment_type", *binned(self.params)]
        placed = self.bins.transform(given).select(*given.columns, *binned(self.params))
        scored = (placed if among is None else among).select(*keys).distinct()
        for name, model in self.models.items():
            scored = add_prediction(model, scored, name)
        scored = small_side(scored.withColumnsRenamed({k: f"_{k}" for k in keys}))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        return placed.join(scored, same, "left").select(*given.columns, *self.models)


def feature_stages(params: list[str], degree: int = 1) -> list:
    """Type as one-hot columns beside the filled parameters, expanded to `degree`, scaled."""
    filled = [f"{p}_filled" for p in params]
    stages = [
        Imputer(inputCols=params, outputCols=filled, strategy="mean"),
        StringIndexer(
            inputCol="experiment_type",
            outputCol="type_index",
            handleInvalid="keep",
            stringOrderType="alphabetAsc",
        ),
        OneHotEncoder(inputCols=["type_index"], outputCols=["type_vector"]),
        VectorAssembler(inputCols=filled, outputCol="numbers"),
    ]
    numbers = "numbers"
    if degree > 1:
        stages.append(
            PolynomialExpansion(inputCol="numbers", outputCol="expanded", degree=degree)
        )
        numbers = "expanded"
    return [
        *stages,
        StandardScaler(inputCol=numbers, outputCol="scaled", withMean=True, withStd=True),
        VectorAssembler(inputCols=["type_vector", "scaled"], outputCol="features"),
    ]


def forest(params: list[str], trees: int = 20, depth: int = 5, weight: str = "") -> Pipeline:
    learner = RandomForestRegressor(
        labelCol="label", predictionCol="rf", numTrees=trees, maxDepth=depth, seed=SEED, weightCol=weight
    )
    return Pipeline(stages=[*feature_stages(params), learner])


def boosted(params: list[str], rounds: int = 10, depth: int = 4, weight: str = "") -> Pipeline:
    learner = GBTRegressor(
        labelCol="label", predictionCol="gbt", maxIter=rounds, maxDepth=depth, seed=SEED, weightCol=weight
    )
    return Pipeline(stages=[*feature_stages(params), learner])


def perceptron(params: list[str], types: int, hidden: int = 8, rounds: int = 30) -> Pipeline:
    """Success classifier; `types` is the number of experiment types in training."""
    learner = MultilayerPerceptronClassifier(
        labelCol="success",
        predictionCol="mlp",
        probabilityCol="mlp_probability",
        rawPredictionCol="mlp_raw",
        layers=[types + len(params), hidden, 2],
        maxIter=rounds,
        seed=SEED,
    )
    return Pipeline(stages=[*feature_stages(params), learner])


def add_prediction(model: PipelineModel, rows: DataFrame, column: str) -> DataFrame:
    """Rows with the model's prediction and none of its working columns.

    Models are applied to the same rows one after the other, so combining them needs
    no join.
    """
    return model.transform(rows).select(*rows.columns, column)


def regression_metrics(predicted: DataFrame, columns: list[str]) -> DataFrame:
    """One row per prediction column: n, rmse, mae, r2; one pass over the rows."""
    per_model = F.inline(
        F.array(
            *[F.struct(F.lit(c).alias("model"), F.col(c).alias("prediction")) for c in columns]
        )
    )
    error = F.col("prediction") - F.col("label")
    return (
        predicted.select("label", per_model)
        .groupBy("model")
        .agg(
            F.count("*").alias("n"),
            F.sqrt(F.avg(error * error)).alias("rmse"),
            F.avg(F.abs(error)).alias("mae"),
            (1.0 - F.avg(error * error) / F.var_pop("label")).alias("r2"),
        )
    )


def class_metrics(predicted: DataFrame, column: str = "mlp") -> DataFrame:
    """Accuracy, precision and recall of a success classifier."""
    hit, said, was = F.col(column) == F.col("success"), F.col(column) == 1, F.col("success") == 1
    both = F.count_if(said & was)
    return predicted.agg(
        F.count("*").alias("n"),
        (F.count_if(hit) / F.count("*")).alias("accuracy"),
        F.try_divide(both, F.count_if(said)).alias("precision"),
        F.try_divide(both, F.count_if(was)).alias("recall"),
    )


def out_of_fold(rows: DataFrame, learners: dict[str, Pipeline]) -> DataFrame:
    """Training rows with a prediction of each learner that never saw their fold.

    Each of `HALVES` is predicted by models of the other one.
    """
    parts = []
    for own in HALVES:
        others = [f for half in HALVES if half != own for f in half]
        known = rows.filter(F.col("fold").isin(others)).persist()
        part = rows.filter(F.col("fold").isin(list(own)))
        try:
            for column, pipeline in learners.items():
                part = add_prediction(pipeline.fit(known), part, column)
        finally:
            known.unpersist()
        parts.append(part)
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    return scored


def stacking_weights(
    scored: DataFrame, columns: list[str], ridge: float = 1e-6, weight: str = ""
) -> dict[str, float]:
    """Weights of the predictions that fit the label best, by the normal equations.

    `scored`: rows whose predictions come from models that did not see them. The sums are
    one row, whatever the number of rows; the driver solves one equation per model. `ridge`
    (relative to the mean square) keeps models with equal predictions solvable. Without rows
    all weights are equal. Rows that stand for several have their number in `weight`.
    """
    n = F.col(weight) if weight else F.lit(1.0)
    entries = [
        F.sum(n * F.col(a) * F.col(b)).alias(f"p{i}_{j}")
        for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j
    ]
    sums = scored.agg(*entries, *[F.sum(n * F.col(c) * F.col("label")).alias(f"y{i}") for i, c in enumerate(columns)]).first()
    size = len(columns)
    if sums["y0"] is None:
        return {c: 1.0 / size for c in columns}
    left = np.array([[sums[f"p{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)])
    left += np.eye(size) * ridge * np.trace(left) / size
    solved = np.linalg.lstsq(left, np.array([sums[f"y{i}"] for i in range(size)]), rcond=None)[0]
    return {c: float(w) for c, w in zip(columns, solved)}


def add_type_means(rows: DataFrame, known: DataFrame, column: str = "type_mean") -> DataFrame:
    """The baseline: mean label of the row's type in `known`, of all `known` for other types.

    One row per experiment type meets the rows.
    """
    sums = cut(known.groupBy("experiment_type").agg(F.sum("label").alias("total"), F.count("label").alias("n")))
    whole = sums.agg(F.sum("total").alias("total"), F.sum("n").alias("n")).first()
    overall = whole["total"] / whole["n"] if whole["n"] else None
    means = sums.select("experiment_type", F.try_divide("total", "n").alias(column))
    return rows.join(means, "experiment_type", "left").select(
        *rows.columns, F.coalesce(F.col(column), F.lit(overall).cast("double")).alias(column)
    )


def add_ensemble(predicted: DataFrame, weights: dict[str, float]) -> DataFrame:
    parts = [F.col(c) * w for c, w in weights.items()]
    return predicted.withColumn("ensemble", sum(parts[1:], parts[0]))


def tune_forest(
    train: DataFrame, params: list[str], trees: list[int], depths: list[int]
) -> CrossValidatorModel:
    """Random forest with the number and depth of trees chosen by cross-validation."""
    pipeline = forest(params)
    learner = pipeline.getStages()[-1]
    grid = (
        ParamGridBuilder()
        .addGrid(learner.numTrees, trees)
        .addGrid(learner.maxDepth, depths)
        .build()
    )
    score = RegressionEvaluator(labelCol="label", predictionCol="rf", metricName="rmse")
    return CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=grid,
        evaluator=score,
        foldCol="fold_of",
        numFolds=FOLDS - 1,
    ).fit(train.withColumn("fold_of", F.col("fold") - 1))


def importances(model: PipelineModel, params: list[str], spark: SparkSession) -> DataFrame:
    """Importance of each numeric parameter in a fitted forest; one row per parameter."""
    weights = model.stages[-1].featureImportances.toArray()[-len(params) :]
    rows = [(name, float(weight)) for name, weight in zip(params, weights)]
    return spark.createDataFrame(rows, "name string, importance double")


def select_parameters(rows: DataFrame, params: list[str], keep: int) -> list[str]:
    """The `keep` parameters that depend most on the outcome by an F test."""
    whole = VectorAssembler(inputCols=params, outputCol="numbers", handleInvalid="skip")
    assembled = whole.transform(rows)
    selector = UnivariateFeatureSelector(
        featuresCol="numbers", labelCol="label", outputCol="chosen", selectionMode="numTopFeatures"
    )
    selector.setFeatureType("continuous").setLabelType("continuous").setSelectionThreshold(keep)
    return [params[i] for i in sorted(selector.fit(assembled).selectedFeatures)]


def candidate_grid(observations: DataFrame, params: list[str], steps: int) -> DataFrame:
    """Evenly spaced parameter settings over each type's observed ranges."""
    edges = observations.groupBy("experiment_type").agg(
        *[F.min(p).cast("double").alias(f"{p}_low") for p in params],
        *[F.max(p).cast("double").alias(f"{p}_high") for p in params],
    )
    grid = edges
    for p in params:
        low, high = F.col(f"{p}_low"), F.col(f"{p}_high")
        points = F.transform(
            F.sequence(F.lit(0), F.lit(steps)), lambda i: low + (high - low) * i / F.lit(steps)
        )
        grid = grid.withColumn(p, F.explode(points))
    return grid.select("experiment_type", *params)


def recommend_settings(predicted: DataFrame, params: list[str], score: str, k: int) -> DataFrame:
    """The k settings of highest predicted outcome per experiment type."""
    order = Window.partitionBy("experiment_type").orderBy(F.desc(score), *params)
    return predicted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def radical_inverse(number: int, base: int) -> float:
    """The digits of `number` mirrored at the point: the Halton sequence in one dimension."""
    value, unit = 0.0, 1.0
    while number:
        unit /= base
        number, digit = divmod(number, base)
        value += digit * unit
    return value


# Bases of the Halton sequence, one for each parameter.
PRIMES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)


def _points(count: int, first: int, params: list[str]) -> Column:
    """`count` points of the unit cube as an array of structs, from number `first` on."""
    return F.array(
        *[
            F.struct(*[F.lit(radical_inverse(n, base)).alias(p) for p, base in zip(params, PRIMES)])
            for n in range(first, first + count)
        ]
    )


def allowed_ranges(queries: DataFrame, observations: DataFrame, params: list[str]) -> DataFrame:
    """query_id, experiment_type, <param>_low and <param>_high of every query.

    A bound that the query leaves open is the one observed for its type. Queries whose
    bounds cross, or that leave a bound of an unknown type open, have no setting and drop out.
    """
    edges = observations.groupBy("experiment_type").agg(
        *[F.min(p).cast("double").alias(f"_{p}_low") for p in params],
        *[F.max(p).cast("double").alias(f"_{p}_high") for p in params],
    )
    given = set(queries.columns)
    joined = queries.join(edges, "experiment_type", "left")
    ranges = {}
    for p in params:
        for end, limit in (("low", "min"), ("high", "max")):
            own = F.col(f"{p}_{limit}") if f"{p}_{limit}" in given else F.lit(None).cast("double")
            # An open end never lies beyond the given one.
            other = F.col(f"{p}_{'max' if limit == 'min' else 'min'}") if f"{p}_max" in given else F.lit(None).cast("double")
            bounded = F.least if end == "low" else F.greatest
            ranges[f"{p}_{end}"] = F.coalesce(own, bounded(F.col(f"_{p}_{end}"), other))
    fits = F.lit(True)
    for p in params:
        fits = fits & F.coalesce(F.col(f"{p}_low") <= F.col(f"{p}_high"), F.lit(False))
    return joined.withColumns(ranges).filter(fits).select("query_id", "experiment_type", *ranges)


def predict_settings(
    ranges: DataFrame, score: Callable[[DataFrame], DataFrame], params: list[str], k: int = 5,
    count: int = 64, rounds: int = 4, shrink: float = 0.4,
) -> DataFrame:
    """The k settings of highest `score` inside each query's ranges (`allowed_ranges`).

    Each round draws `count` Halton points from a box: the whole range first, then a box
    `shrink` times as wide around the best point so far, cut to the range. So a query costs
    count * rounds predictions, whatever the number of parameters. `score` adds a column
    `score` to rows with experiment_type and the parameters.
    """
    cores = ranges.sparkSession.sparkContext.defaultParallelism
    lows, highs = [f"{p}_low" for p in params], [f"{p}_high" for p in params]
    order = [F.desc("score"), *params]
    best = Window.partitionBy("query_id").orderBy(*order)
    boxes = ranges.withColumns({f"_{p}_{end}": F.col(f"{p}_{end}") for p in params for end in ("low", "high")})
    found = None
    for number in range(rounds):
        # Few bytes of queries become many rows to score, so every core gets a part.
        drawn = boxes.repartition(cores, "query_id").withColumn("_at", F.explode(_points(count, 1 + number * count, params)))
        for p in params:
            drawn = drawn.withColumn(p, F.col(f"_{p}_low") + (F.col(f"_{p}_high") - F.col(f"_{p}_low")) * F.col(f"_at.{p}"))
        scored = score(drawn.select("query_id", "experiment_type", *lows, *highs, *params))
        scored = cut(scored.select("query_id", "experiment_type", *lows, *highs, *params, "score"))
        found = scored if found is None else found.unionByName(scored)
        # k rows a query are kept, so what a round stores does not grow with the rounds.
        found = cut(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank"))
        centre = found.withColumn("rank", F.row_number().over(best)).filter("rank = 1")
        half = shrink ** (number + 1) / 2
        boxes = centre.select("query_id", "experiment_type", *lows, *highs, *params)
        for p in params:
            reach = (F.col(f"{p}_high") - F.col(f"{p}_low")) * half
            boxes = boxes.withColumns(
                {
                    f"_{p}_low": F.greatest(F.col(f"{p}_low"), F.col(p) - reach),
                    f"_{p}_high": F.least(F.col(f"{p}_high"), F.col(p) + reach),
                }
            )
        boxes = boxes.drop(*params)
    return found.withColumn("rank", F.row_number().over(best)).select(
        "query_id", "experiment_type", "rank", *params, "score"
    )
