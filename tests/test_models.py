import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.sql import functions as F

from assaylake.operators import modelling

PARAMS = ["temperature", "pressure"]


@pytest.fixture(scope="module")
def rows_of(spark):
    """Outcome rises with temperature, falls with pressure, and depends on the type."""
    i = F.col("id")
    t, p = i % 50, (i * 7) % 11
    observed = spark.range(3000).select(
        F.concat(F.lit("e"), i.cast("string")).alias("experiment_id"),
        F.when(i % 3 == 0, "reaction").otherwise("solubility").alias("experiment_type"),
        t.cast("decimal(18,4)").alias("temperature"),
        p.cast("decimal(18,4)").alias("pressure"),
        (t * 4 - p + F.when(i % 3 == 0, 50).otherwise(0)).cast("decimal(18,4)").alias("outcome"),
        (t > 25).alias("success"),
    )
    return modelling.model_rows(observed, PARAMS).persist()


@pytest.fixture(scope="module")
def fitted(rows_of):
    train = modelling.training(rows_of)
    return modelling.forest(PARAMS).fit(train), modelling.boosted(PARAMS).fit(train)


@pytest.fixture(scope="module")
def predicted(rows_of, fitted):
    rf, gbt = fitted
    both = modelling.add_prediction(rf, modelling.holdout(rows_of), "rf")
    return modelling.add_prediction(gbt, both, "gbt").persist()


def test_folds_do_not_depend_on_partitions(rows_of):
    def folds(df):
        return {r["experiment_id"]: r["fold"] for r in df.select("experiment_id", "fold").collect()}

    assert folds(rows_of) == folds(rows_of.repartition(13))
    shares = rows_of.groupBy("fold").count().collect()
    assert len(shares) == modelling.FOLDS and min(r["count"] for r in shares) > 400


@pytest.fixture(scope="module")
def scored(rows_of):
    return modelling.out_of_fold(rows_of, {"rf": modelling.forest(PARAMS), "gbt": modelling.boosted(PARAMS)}).persist()


def test_rows_are_scored_by_models_that_never_saw_them(rows_of):
    """Learners fitted on labels that give the half away predict the other half's label."""
    halves = rows_of.withColumn("label", F.when(F.col("fold").isin(1, 2), 10.0).otherwise(20.0))
    found = modelling.out_of_fold(halves, {"rf": modelling.forest(PARAMS, trees=2, depth=1)})
    values = {(r.fold, round(r.rf, 6)) for r in found.select("fold", "rf").distinct().collect()}
    assert values == {(1, 20.0), (2, 20.0), (3, 10.0), (4, 10.0)}


def test_weights_solve_the_normal_equations(scored):
    columns = ["rf", "gbt"]
    weights = modelling.stacking_weights(scored, columns)
    rows = scored.select(*columns, "label").collect()
    true = np.linalg.lstsq(np.array([r[:2] for r in rows]), np.array([r[2] for r in rows]), rcond=None)[0]
    assert [weights[c] for c in columns] == pytest.approx(true.tolist(), abs=1e-2)
    assert modelling.stacking_weights(scored.limit(0), columns) == {"rf": 0.5, "gbt": 0.5}
    same = scored.withColumn("gbt", F.col("rf"))
    assert sum(modelling.stacking_weights(same, columns).values()) == pytest.approx(
        float(np.sum(np.array([r[0] * r[2] for r in rows])) / np.sum(np.array([r[0] ** 2 for r in rows]))), rel=1e-3
    )


def test_type_means_and_unknown_types(spark, rows_of):
    known = modelling.training(rows_of)
    means = {r[0]: r[1] for r in known.groupBy("experiment_type").avg("label").collect()}
    overall = known.agg(F.avg("label")).first()[0]
    rows = modelling.holdout(rows_of).unionByName(rows_of.limit(1).withColumn("experiment_type", F.lit("brewing")))
    for r in modelling.add_type_means(rows, known).collect():
        assert r.type_mean == pytest.approx(means.get(r.experiment_type, overall))


def test_missing_parameters_are_filled_by_the_training_mean(rows_of):
    gaps = rows_of.withColumn("temperature", F.when(F.col("pressure") != 3, F.col("temperature")))
    model = modelling.forest(PARAMS).fit(gaps)
    mean = gaps.agg(F.avg("temperature")).first()[0]
    assert model.stages[0].surrogateDF.first()["temperature"] == pytest.approx(mean)
    assert modelling.add_prediction(model, gaps, "rf").filter("rf is null").count() == 0


def test_regressors_beat_the_mean(predicted, scored):
    weights = modelling.stacking_weights(scored, ["rf", "gbt"])
    full = modelling.add_ensemble(predicted, weights)
    got = {r["model"]: r for r in modelling.regression_metrics(full, ["rf", "gbt", "ensemble"]).collect()}
    assert all(r["r2"] > 0.8 for r in got.values())
    assert got["ensemble"]["rmse"] <= max(got["rf"]["rmse"], got["gbt"]["rmse"])
    check = RegressionEvaluator(labelCol="label", predictionCol="rf")
    assert got["rf"]["rmse"] == pytest.approx(check.evaluate(full), rel=1e-9)
    assert got["rf"]["r2"] == pytest.approx(check.setMetricName("r2").evaluate(full), rel=1e-9)


def test_forest_is_repeatable_and_survives_saving(rows_of, fitted, predicted, tmp_path):
    again = modelling.forest(PARAMS).fit(modelling.training(rows_of))
    path = str(tmp_path / "model")
    fitted[0].write().overwrite().save(path)
    loaded = PipelineModel.load(path)

    def of(model):
        out = modelling.add_prediction(model, modelling.holdout(rows_of), "rf")
        return {r["experiment_id"]: r["rf"] for r in out.collect()}

    first = {r["experiment_id"]: r["rf"] for r in predicted.collect()}
    assert of(again) == pytest.approx(first)
    assert of(loaded) == first


def test_success_classifier(rows_of):
    model = modelling.perceptron(PARAMS, types=2).fit(modelling.training(rows_of))
    out = modelling.add_prediction(model, modelling.holdout(rows_of), "mlp")
    row = modelling.class_metrics(out).first()
    check = MulticlassClassificationEvaluator(
        labelCol="success", predictionCol="mlp", metricName="accuracy"
    )
    assert row["accuracy"] == pytest.approx(check.evaluate(out))
    assert row["accuracy"] > 0.9 and row["precision"] > 0.8 and row["recall"] > 0.8


def test_unknown_type_gets_a_prediction(rows_of, fitted):
    strange = rows_of.limit(5).withColumn("experiment_type", F.lit("brewing"))
    assert modelling.add_prediction(fitted[0], strange, "rf").filter("rf is null").count() == 0


def test_screening(spark, rows_of, fitted):
    weight = {r["name"]: r["importance"] for r in modelling.importances(fitted[0], PARAMS, spark).collect()}
    assert weight["temperature"] > weight["pressure"]
    assert modelling.select_parameters(rows_of, PARAMS, 1) == ["temperature"]


def test_degree_two_features(rows_of):
    from pyspark.ml import Pipeline

    stages = modelling.feature_stages(PARAMS, degree=2)
    out = Pipeline(stages=stages).fit(rows_of).transform(rows_of)
    # two types and t, t*t, p, p*t, p*p
    assert out.select("features").first()[0].size == 7


def test_tuning(rows_of):
    tuned = modelling.tune_forest(modelling.training(rows_of), PARAMS, [3], [1, 5])
    assert tuned.bestModel.stages[-1].getMaxDepth() == 5


def test_recommended_settings(rows_of, fitted):
    grid = modelling.candidate_grid(rows_of, PARAMS, 5)
    assert grid.count() == 2 * 6 * 6
    scored = modelling.add_prediction(fitted[1], grid, "gbt")
    best = modelling.recommend_settings(scored, PARAMS, "gbt", 2).collect()
    assert len(best) == 4
    assert all(r["temperature"] > 35 for r in best if r["rank"] == 1)


BOUNDS = "query_id long, experiment_type string, temperature_min double, temperature_max double, pressure_min double, pressure_max double"


def peak(given):
    """A smooth score with its best at (31.7, 4.3, 6.1)."""
    gap = lambda name, at, width: F.pow((F.col(name) - at) / width, 2)
    score = -gap("temperature", 31.7, 50) - gap("pressure", 4.3, 10) - gap("duration", 6.1, 8)
    return given.withColumn("score", score)


def test_predicted_settings_keep_to_the_bounds(spark, rows_of):
    params = [*PARAMS, "duration"]
    observed = rows_of.withColumn("duration", F.pmod(F.xxhash64("experiment_id"), F.lit(9)).cast("double"))
    queries = spark.createDataFrame(
        [
            (1, "reaction", 10.0, 20.0, 2.0, 5.0), (2, "reaction", None, None, None, None), (3, "reaction", 20.0, 10.0, None, None),
            (4, "brewing", None, 5.0, None, None), (5, "brewing", 1.0, 2.0, 3.0, 3.0), (6, "solubility", None, -5.0, 4.0, 4.0),
            (7, "reaction", 90.0, None, None, None),
        ],
        BOUNDS,
    )
    ranges = modelling.allowed_ranges(queries, observed, params)
    of = {r.query_id: r for r in ranges.collect()}
    assert sorted(of) == [1, 2, 6, 7]  # crossed bounds and open bounds of unknown types have no setting
    assert (of[6].temperature_low, of[6].temperature_high, of[7].temperature_high) == (-5.0, -5.0, 90.0)
    seen = []

    def score(given):
        seen.append(given.count())
        return peak(given)

    found = modelling.predict_settings(ranges, score, params, k=3, count=64, rounds=4).collect()
    assert seen == [4 * 64] * 4  # linear in the queries
    assert sorted((r.query_id, r["rank"]) for r in found) == [(q, k) for q in (1, 2, 6, 7) for k in (1, 2, 3)]
    for r in found:
        assert all(of[r.query_id][f"{p}_low"] - 1e-9 <= r[p] <= of[r.query_id][f"{p}_high"] + 1e-9 for p in params)
    grid = peak(modelling.candidate_grid(observed, params, 10)).filter("experiment_type = 'reaction'")
    top = {r.query_id: r.score for r in found if r["rank"] == 1}
    assert top[2] >= grid.agg(F.max("score")).first()[0]
    assert modelling.predict_settings(ranges.limit(0), peak, params).count() == 0


def test_halton_points_fill_the_cube():
    points = [[modelling.radical_inverse(n, b) for b in (2, 3)] for n in range(1, 73)]
    assert points[0] == [0.5, pytest.approx(1 / 3)] and points[1] == [0.25, pytest.approx(2 / 3)]
    cells = {(int(x * 8 + 1e-9), int(y * 9 + 1e-9)) for x, y in points}
    assert len(cells) == 72


TREES = {"rf": modelling.forest, "gbt": modelling.boosted}


@pytest.fixture(scope="module")
def trees(rows_of):
    return modelling.Trees(rows_of, PARAMS, TREES)


def test_cells_hold_every_row_and_do_not_grow_with_copies(rows_of, trees):
    """What the learners read is bounded by types, bins, folds and groups, not by the rows."""
    sums = trees.known.groupBy("fold").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("y"))
    true = {r.fold: r for r in rows_of.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("y")).collect()}
    got = {r.fold: r for r in sums.collect()}
    assert {f: r.n for f, r in got.items()} == {f: r.n for f, r in true.items()}
    assert all(got[f].y == pytest.approx(true[f].y) for f in true)
    more = rows_of.crossJoin(rows_of.sparkSession.range(20))
    more = more.withColumn("experiment_id", F.concat("experiment_id", F.lit("-"), "id")).drop("id")
    cells = modelling.cells(more, trees.bins, PARAMS)
    most = trees.known.select("fold", "experiment_type", *modelling.binned(PARAMS)).distinct().count()
    assert cells.count() <= most * modelling.GROUPS < more.count() / 2


def test_boosted_trees_of_cells_are_those_of_the_binned_rows(rows_of, trees):
    """Weighted cells give the trees that one row per experiment gives."""
    placed = trees.bins.transform(rows_of)
    plain = modelling.boosted(modelling.binned(PARAMS)).fit(modelling.training(placed))
    of_rows = {r[0]: r[1] for r in modelling.add_prediction(plain, placed, "gbt").select("experiment_id", "gbt").collect()}
    of_cells = {r[0]: r[1] for r in trees.predict(rows_of).select("experiment_id", "gbt").collect()}
    assert of_cells == pytest.approx(of_rows, rel=1e-6)


def test_cells_are_scored_for_known_and_other_rows(spark, rows_of, trees):
    held = modelling.holdout(rows_of).withColumn("experiment_type", F.when(F.col("temperature") != 7, F.col("experiment_type")))
    strange = held.unionByName(held.limit(3).withColumn("experiment_type", F.lit("brewing")).withColumn("pressure", F.lit(None).cast("double")))
    found = trees.predict(strange)
    assert found.columns == [*strange.columns, "rf", "gbt"]
    assert found.count() == strange.count() and found.filter("rf is null or gbt is null").count() == 0
    known = trees.predict(modelling.holdout(rows_of), trees.known).collect()
    other = {r.experiment_id: (r.rf, r.gbt) for r in trees.predict(modelling.holdout(rows_of)).collect()}
    assert {r.experiment_id: (r.rf, r.gbt) for r in known} == other
    weights = modelling.stacking_weights(trees.out_of_fold(), list(TREES), weight="weight")
    full = modelling.add_ensemble(trees.predict(modelling.holdout(rows_of), trees.known), weights)
    assert all(r["r2"] > 0.8 for r in modelling.regression_metrics(full, [*TREES, "ensemble"]).collect())


def test_rows_without_label_are_refused_in_training_only(rows_of):
    def without(where):
        return rows_of.filter("experiment_id < 'e2'").withColumn("label", F.when(~where, F.col("label")))

    shallow = {"rf": lambda params, weight: modelling.forest(params, trees=1, depth=1, weight=weight)}
    judged = modelling.Trees(without(F.col("fold") == 0), PARAMS, shallow)
    assert judged.known.filter("fold = 0 and label is not null").count() == 0
    with pytest.raises(Exception, match="Labels MUST NOT be Null"):
        modelling.Trees(without((F.col("fold") == 1) & (F.col("temperature") == 5)), PARAMS, shallow)
