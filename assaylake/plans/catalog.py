"""Every operator as a named query over the test tables: name -> (spark, folder)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ranges, requests
from ..functions.names import initial
from ..operators import (
    accounts,
    experiments,
    feedback,
    history,
    learning,
    literature,
    logins,
    modelling,
    recommend,
    retrieval,
    screening,
)
from ..session import cut, shared_folder, tune
from ..sources import uploads
from ..streaming import jobs
from . import roles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

KEYWORDS = ["heat", "license", "with", "pour", "sich", "para"]
TYPE_WORDS = {
    "solubility": ("heat",),
    "crystallization": ("license",),
    "reaction": ("sich", "nicht"),
    "material": ("pour",),
}
BIN_WIDTHS = {"temperature": 10.0, "pressure": 2.0}
TOP = 5


def _plain_types(df: DataFrame) -> DataFrame:
    """Timestamps without zone and doubles for decimals, as the SQL side has them."""
    out = []
    for field in df.schema:
        column = F.col(field.name)
        if isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        out.append(column.alias(field.name))
    return df.select(*out)


def query(build: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _plain_types(build(tune(spark), folder))

    QUERIES[build.__name__] = run
    return run


def _joined(codes: str) -> Column:
    return F.concat_ws(",", codes).alias(codes)


# --- logins ------------------------------------------------------------------


def _decided(spark, folder):
    return logins.decide_logins(roles.attempts(spark, folder), roles.users(spark, folder))


@query
def login_decision(spark, folder):
    return _decided(spark, folder).select("seq", "username", "user_id", "ok", "status")


def _audit(spark, folder):
    numbered = logins.number_attempts(roles.attempts(spark, folder))
    return logins.audit_rows(logins.decide_logins(numbered, roles.users(spark, folder)))


@query
def login_audit(spark, folder):
    return _audit(spark, folder)


@query
def last_login(spark, folder):
    latest = logins.last_logins(_decided(spark, folder))
    return logins.set_last_logins(roles.users(spark, folder), latest).select("id", "last_login_at")


@query
def login_usage_hourly(spark, folder):
    return logins.usage(_decided(spark, folder))


@query
def token_expiry(spark, folder):
    return logins.login_answers(_decided(spark, folder))


# --- accounts ----------------------------------------------------------------


@query
def user_lookup(spark, folder):
    return accounts.find_by_id(roles.id_requests(spark, folder), roles.users(spark, folder))


@query
def user_lookup_by_name(spark, folder):
    names = roles.attempts(spark, folder).select("seq", "username")
    return accounts.find_by_name(names, roles.users(spark, folder))


@query
def user_public(spark, folder):
    return accounts.public_view(roles.users(spark, folder))


@query
def register_accept(spark, folder):
    return accounts.register(roles.registrations(spark, folder), roles.users(spark, folder))


@query
def register_reject(spark, folder):
    answers = accounts.registration_answers(
        roles.registrations(spark, folder), roles.users(spark, folder)
    )
    refused = answers.filter(F.col("status") != accounts.CREATED)
    return refused.select("seq", "username", "status", _joined("errors"))


def _patched(spark, folder):
    return accounts.decide_patches(roles.patches(spark, folder), roles.users(spark, folder))


@query
def patch_status(spark, folder):
    return _patched(spark, folder).select("seq", "user_id", "username", "status")


@query
def user_patch(spark, folder):
    return accounts.apply_patches(roles.users(spark, folder), _patched(spark, folder))


@query
def delete_status(spark, folder):
    return accounts.decide_deletes(roles.deletions(spark, folder), roles.users(spark, folder))


def _remaining(spark, folder):
    return accounts.apply_deletes(roles.users(spark, folder), roles.deletions(spark, folder))


@query
def user_delete(spark, folder):
    return accounts.public_view(_remaining(spark, folder))


@query
def audit_after_delete(spark, folder):
    return accounts.release_audit(_audit(spark, folder), roles.deletions(spark, folder))


@query
def user_history(spark, folder):
    return history.versions(roles.user_changes(spark, folder), "user_id", "seq")


@query
def history_merge(spark, folder):
    """The same history, kept up in two batches of which the second brings late changes."""
    root = f"{_work(spark)}/history"
    changes = roles.user_changes(spark, folder)
    late = F.coalesce(F.dayofweek("valid_from") % 2 == 0, F.lit(True))
    for batch in (changes.where(~late), changes.where(late)):
        history.merge_changes(batch, root, "user_id", "seq", 16)
    return history.read_history(spark, root)


# --- form values -------------------------------------------------------------


@query
def range_parse(spark, folder):
    text = F.col("range_text")
    low, high = ranges.range_min(text), ranges.range_max(text)
    return roles.range_texts(spark, folder).select(
        "experiment_id",
        "range_text",
        low.alias("min_text"),
        high.alias("max_text"),
        ranges.bound(low).alias("min_value"),
        ranges.bound(high).alias("max_value"),
        ranges.range_text(low, high).alias("printed"),
    )


@query
def upload_names(spark, folder):
    taken = F.filter("files", lambda f: requests.accepted_name(f["name"]))
    listed = requests.append_names(F.col("names"), taken)
    left = requests.drop_position(listed, F.col("position"))
    return roles.upload_lists(spark, folder).select(
        "p_partkey",
        F.concat_ws("|", listed).alias("listed"),
        F.concat_ws("|", left).alias("remaining"),
    )


@query
def avatar_initial(spark, folder):
    return roles.table(spark, folder, "part").select(
        "p_partkey", initial("p_name").alias("initial")
    )


@query
def json_roundtrip(spark, folder):
    row = requests.parse_json(F.col("body"), T.StructType([T.StructField("k", T.LongType())]))
    return roles.json_messages(spark, folder).select(
        "event_id",
        row.isNotNull().alias("readable"),
        row["k"].alias("k"),
        F.to_json(row).alias("printed"),
    )


# --- experiments -------------------------------------------------------------


@query
def experiment_create(spark, folder):
    return experiments.create_experiments(roles.experiment_requests(spark, folder))


@query
def experiment_list(spark, folder):
    return experiments.list_experiments(
        roles.experiments(spark, folder), roles.users(spark, folder)
    )


@query
def experiment_params(spark, folder):
    return experiments.with_parameters(
        roles.typed_experiments(spark, folder),
        roles.parameters(spark, folder),
        roles.results(spark, folder),
    )


@query
def experiment_wide(spark, folder):
    wide = experiments.to_wide(roles.parameters(spark, folder), roles.PARAMS)
    mapped = experiments.parameter_map(wide, roles.PARAMS)
    return mapped.select(
        "experiment_id", *roles.PARAMS, F.size("params").alias("n_params")
    )


@query
def param_predictions(spark, folder):
    return experiments.prediction_parameters(
        roles.predictions(spark, folder).drop("predicted_success"),
        roles.prediction_bridge(spark, folder),
        roles.prediction_params(spark, folder),
    )


@query
def experiment_validate(spark, folder):
    checked = experiments.check_rows(roles.raw_rows(spark, folder))
    return checked.select(
        "experiment_id", "experiment_type", "temperature", "pressure", "outcome", _joined("errors")
    )


@query
def upload_process(spark, folder):
    """Rows written as files, taken, and sent again under other names, which adds nothing."""
    work = _work(spark)
    rows = cut(roles.uploaded(spark, folder))  # so that both writes give the same bytes
    for name in ("first", "again"):
        rows.write.option("header", True).csv(f"{work}/in/{name}")
        uploads.ingest_uploads(spark, f"{work}/in", f"{work}/out")
    good = spark.read.parquet(f"{work}/out/rows").withColumn("errors", F.lit(""))
    bad = spark.read.parquet(f"{work}/out/rejected").withColumn("errors", F.concat_ws(",", "errors"))
    columns = ["experiment_id", F.coalesce("experiment_type", F.lit("")).alias("experiment_type"), "errors"]
    numbers = [F.trim(F.col(n).cast("string")).try_cast("double").alias(n) for n in ("temperature", "pressure", "outcome")]
    return good.select(*columns, *numbers).unionByName(bad.select(*columns, *numbers))


@query
def orphans(spark, folder):
    left = _remaining(spark, folder)
    return experiments.orphans(
        {
            "experiment_user": (roles.table(spark, folder, "orders"), "o_custkey", left, "id"),
            "event_user": (roles.table(spark, folder, "events"), "user_id", left, "id"),
            "feedback_prediction": (
                roles.feedback(spark, folder),
                "prediction_id",
                roles.prediction_bridge(spark, folder),
                "prediction_id",
            ),
            "unused_parameter": (
                roles.table(spark, folder, "part"),
                "p_partkey",
                roles.prediction_bridge(spark, folder),
                "parameter_id",
            ),
        }
    )


@query
def dashboard_stats(spark, folder):
    return experiments.dashboard(roles.counts_per_user(spark, folder), roles.users(spark, folder))


# --- recommendations ---------------------------------------------------------


def _queries(spark, folder):
    return recommend.parse_queries(roles.query_forms(spark, folder))


def _matches(spark, folder):
    return recommend.match(
        _queries(spark, folder), recommend.settings(roles.observations(spark, folder))
    )


def _cells(spark, folder):
    return recommend.build_cells(recommend.settings(roles.observations(spark, folder)), BIN_WIDTHS, TOP)


def _ranked(spark, folder):
    return recommend.best_bins(_queries(spark, folder), _cells(spark, folder))


@query
def constraint_rows(spark, folder):
    return recommend.constraint_rows(_queries(spark, folder))


@query
def constraint_match(spark, folder):
    return _matches(spark, folder).drop("squares")


@query
def recommend_topk(spark, folder):
    return _ranked(spark, folder)


@query
def constraint_totals(spark, folder):
    return recommend.totals(_queries(spark, folder), _cells(spark, folder))


@query
def prediction_envelope(spark, folder):
    answers = recommend.envelopes(_queries(spark, folder), _ranked(spark, folder))
    line = F.transform(
        "predictions",
        lambda p: F.concat_ws(":", p["rank"], p["temperature_bin"], p["pressure_bin"], p["n"]),
    )
    return answers.select(
        "query_id", "experiment_type", F.concat_ws("|", line).alias("predictions"), "confidence"
    )


@query
def param_histogram(spark, folder):
    return recommend.histogram(roles.long_observations(spark, folder))


@query
def main_effects(spark, folder):
    return screening.main_effects(roles.long_observations(spark, folder))


@query
def normalise(spark, folder):
    long = roles.long_observations(spark, folder, missing=True).drop("outcome")
    return screening.normalise(long)


# --- feedback ----------------------------------------------------------------


@query
def effectiveness(spark, folder):
    return feedback.effectiveness(
        roles.feedback(spark, folder),
        roles.prediction_bridge(spark, folder),
        roles.prediction_params(spark, folder),
        10.0,
    )


@query
def feedback_match(spark, folder):
    compared = feedback.compare_feedback(
        roles.feedback(spark, folder), roles.predictions(spark, folder)
    )
    return compared.select("event_id", "prediction_id", "predicted_success", "success", "matches")


# --- literature --------------------------------------------------------------


@query
def lit_search(spark, folder):
    return literature.search(roles.documents(spark, folder), KEYWORDS, 50)


@query
def lit_ranked(spark, folder):
    index = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    retrieval.index_documents(roles.documents(spark, folder), index)
    return retrieval.ranked_search(spark, index, KEYWORDS, 50)


@query
def page_text(spark, folder):
    return literature.read_pages(roles.spread_table(spark, folder, "pages", "page_id", "url", "html"))


@query
def lit_params(spark, folder):
    return literature.extract_values(roles.literature(spark, folder))


@query
def lit_validate(spark, folder):
    checked = literature.check_values(literature.extract_values(roles.literature(spark, folder)))
    return checked.select("doc_id", "position", "value", _joined("errors"))


@query
def lit_entities(spark, folder):
    return literature.find_entities(
        roles.documents(spark, folder), roles.dictionary(spark, folder)
    )


@query
def lit_longest(spark, folder):
    return literature.find_longest(roles.documents(spark, folder), roles.phrases(spark, folder))


@query
def lit_dedup(spark, folder):
    return literature.drop_copies(roles.documents(spark, folder)).withColumn(
        "text", F.sha2("text", 256)
    )


@query
def lit_types(spark, folder):
    return literature.classify(roles.documents(spark, folder), TYPE_WORDS)


@query
def lit_type_terms(spark, folder):
    return literature.type_terms(roles.typed_documents(spark, folder))


@query
def lit_trained(spark, folder):
    """Types of all documents by naive Bayes, learnt from those whose type is known."""
    docs = roles.typed_documents(spark, folder)
    return literature.classify_trained(docs, literature.train_types(docs))


@query
def lit_rows(spark, folder):
    return literature.literature_rows(roles.literature(spark, folder), TYPE_WORDS)


@query
def page_values(spark, folder):
    pages = literature.read_pages(
        roles.spread_table(spark, folder, "pages", "page_id", "url", "html")
    )
    texts = pages.select(F.col("page_id").alias("doc_id"), "text")
    return literature.extract_values(texts).withColumnRenamed("doc_id", "page_id")


# --- models ------------------------------------------------------------------


def _rows(spark, folder):
    return modelling.model_rows(roles.observations(spark, folder), roles.PARAMS)


def _trees(spark, folder, **learners):
    """(stored rows, models fitted on the training rows)."""
    rows = cut(_rows(spark, folder))
    return rows, modelling.Trees(rows, roles.PARAMS, learners)


def _stacked(spark, folder):
    """(rows, models, weights of their ensemble): weights come from training rows that were
    scored by models of other folds, so fold 0 is neither fitted nor weighted."""
    rows, trees = _trees(spark, folder, rf=modelling.forest, gbt=modelling.boosted)
    return rows, trees, modelling.stacking_weights(trees.out_of_fold(), ["rf", "gbt"], weight="weight")


@query
def rf_predict(spark, folder):
    rows, trees = _trees(spark, folder, rf=modelling.forest)
    return trees.predict(rows, trees.known)


@query
def param_importance(spark, folder):
    _, trees = _trees(spark, folder, rf=modelling.forest)
    return modelling.importances(trees.models["rf"], roles.PARAMS, spark)


@query
def gbt_predict(spark, folder):
    rows, trees = _trees(spark, folder, gbt=modelling.boosted)
    return trees.predict(rows, trees.known)


def _fit_success(rows):
    train = modelling.training(rows)
    types = train.select("experiment_type").distinct().count()
    return modelling.perceptron(roles.PARAMS, types).fit(train)


@query
def mlp_predict(spark, folder):
    rows = cut(_rows(spark, folder))
    return modelling.add_prediction(_fit_success(rows), rows, "mlp")


@query
def ensemble(spark, folder):
    rows, trees, weights = _stacked(spark, folder)
    return modelling.add_ensemble(trees.predict(rows, trees.known), weights)


@query
def model_eval(spark, folder):
    rows, trees, weights = _stacked(spark, folder)
    held = modelling.add_ensemble(trees.predict(modelling.holdout(rows), trees.known), weights)
    judged = modelling.add_type_means(held, modelling.training(rows))
    return modelling.regression_metrics(judged, ["type_mean", "rf", "gbt", "ensemble"])


@query
def baseline_eval(spark, folder):
    """The mean per type, judged on fold 0."""
    rows = _rows(spark, folder)
    judged = modelling.add_type_means(modelling.holdout(rows), modelling.training(rows))
    metrics = modelling.regression_metrics(judged, ["type_mean"])
    return metrics.select("model", "n", *[F.round(c, 4).alias(c) for c in ("rmse", "mae", "r2")])


@query
def model_folds(spark, folder):
    """Rows and mean outcome of every type in every fold."""
    return _rows(spark, folder).groupBy("experiment_type", "fold").agg(
        F.count("*").alias("n"), F.round(F.avg("label"), 4).alias("mean_outcome")
    )


@query
def success_eval(spark, folder):
    rows = cut(_rows(spark, folder))
    predicted = modelling.add_prediction(_fit_success(rows), modelling.holdout(rows), "mlp")
    return modelling.class_metrics(predicted)


@query
def model_recommend(spark, folder):
    rows, trees, weights = _stacked(spark, folder)
    grid = modelling.candidate_grid(rows, roles.PARAMS, 10)
    predicted = modelling.add_ensemble(trees.predict(grid), weights)
    return modelling.recommend_settings(predicted, roles.PARAMS, "ensemble", TOP)


@query
def predict_parameters(spark, folder):
    """The best settings that the models predict inside each constraint query's bounds."""
    rows, trees, weights = _stacked(spark, folder)
    ranges = modelling.allowed_ranges(_queries(spark, folder), rows, roles.PARAMS)

    def score(given):
        return modelling.add_ensemble(trees.predict(given), weights).withColumnRenamed("ensemble", "score")

    return modelling.predict_settings(ranges, score, roles.PARAMS, TOP)


# --- streams -----------------------------------------------------------------


def _stream_of(spark, folder, name):
    """A table as a stream; it may be one file or a folder of files."""
    scan = roles.table(spark, folder, name)
    source = spark.readStream.schema(scan.schema)
    if scan.inputFiles()[0].endswith(f"/{name}.parquet"):
        return source.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return source.parquet(f"{folder}/{name}.parquet")


def _work(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query
def stream_login(spark, folder):
    work = _work(spark)
    attempts = roles.attempts_of(_stream_of(spark, folder, "events"))
    jobs.login_stream(attempts, roles.users(spark, folder), work).awaitTermination()
    return jobs.stream_audit(spark, work)


@query
def stream_last_login(spark, folder):
    """Users with the last login that the stream of attempts leaves."""
    work = _work(spark)
    users = roles.users(spark, folder)
    attempts = roles.attempts_of(_stream_of(spark, folder, "events"))
    jobs.login_stream(attempts, users, work).awaitTermination()
    return logins.set_last_logins(users, jobs.latest_logins(spark, work)).select("id", "last_login_at")


@query
def stream_usage(spark, folder):
    work = _work(spark)
    attempts = roles.attempts_of(_stream_of(spark, folder, "events"))
    decided = logins.decide_logins(attempts, roles.users(spark, folder))
    jobs.usage_stream(decided, work).awaitTermination()
    return jobs.summed(spark, work, jobs.USAGE_KEYS)


@query
def stream_dashboard(spark, folder):
    work = _work(spark)
    results = roles.results_of(_stream_of(spark, folder, "events"))
    jobs.dashboard_stream(results, work).awaitTermination()
    return jobs.summed(spark, work, jobs.DASHBOARD_KEYS)


@query
def stream_feedback(spark, folder):
    work = _work(spark)
    messages = roles.feedback_messages_of(_stream_of(spark, folder, "events"))
    jobs.feedback_stream(messages, work).awaitTermination()
    return spark.read.parquet(f"{work}/feedback").drop("batch", "created_at")


RATING_FEATURES = ["amount", "finished"]


@query
def stream_learning(spark, folder):
    """What the stream of feedback teaches: the rating by amount and state of an order."""
    work = _work(spark)
    messages = roles.feedback_messages_of(_stream_of(spark, folder, "events"))
    predictions = roles.predictions(spark, folder).select(
        "prediction_id", (F.col("score") / 100000).alias("amount"),
        F.col("predicted_success").cast("int").alias("finished"),
    )
    jobs.learning_stream(messages, predictions, RATING_FEATURES, work).awaitTermination()
    sums = learning.added(jobs.learned(spark, work))
    model = learning.solve(sums, RATING_FEATURES)
    return sums.select(
        "n", F.col("y").alias("total"), *[F.lit(round(slope, 6)).alias(name) for name, slope in model.items()]
    )
