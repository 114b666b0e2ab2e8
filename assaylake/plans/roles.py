"""The test tables in the roles of account, experiment and literature tables.

Every role reads its whole table. Variants (spelling, missing fields, unknown ids) come
from the values of a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.requests import parse_json
from ..functions.text import ngrams, words
from ..schemas import MEASURE
from ..session import spread

c = F.col


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str, key: str, *columns: str) -> DataFrame:
    """Columns of a table for work that is costly per row."""
    return spread(table(spark, folder, name).select(key, *columns), key)


def _text(value: Column) -> Column:
    return value.cast("string")


def _whole(value: Column) -> Column:
    return _text(F.floor(value).cast("long"))


def _customer_name(key: Column) -> Column:
    return F.concat(F.lit("Customer#"), F.lpad(_text(key), 9, "0"))


# --- accounts ----------------------------------------------------------------


def users(spark: SparkSession, folder: str) -> DataFrame:
    first_day = F.lit("2020-01-01 00:00:00").cast("timestamp")
    return table(spark, folder, "customer").select(
        c("c_custkey").alias("id"),
        c("c_name").alias("username"),
        F.concat(_text(c("c_custkey")), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("hash-"), _text(c("c_custkey"))).alias("password_hash"),
        c("c_mktsegment").alias("role"),
        (c("c_acctbal") >= 0).alias("is_active"),
        (first_day + F.make_dt_interval(c("c_nationkey"))).alias("created_at"),
        F.lit(None).cast("timestamp").alias("last_login_at"),
    )


def attempts_of(events: DataFrame) -> DataFrame:
    """Login attempts; also for a stream of events."""
    name = _customer_name(c("user_id"))
    kind = c("event_type")
    typed = (
        F.when(kind == "click", F.upper(name))
        .when(kind == "view", F.replace(name, F.lit("u"), F.lit("ü")))
        .when(kind == "purchase", F.lower(name))
        .when((kind == "signup") & (c("value") < 5), F.concat(name, F.lit(" ")))
        .otherwise(name)
    )
    return events.select(
        c("event_id").alias("seq"),
        typed.alias("username"),
        F.concat(F.lit("10.0.0."), _text(c("user_id"))).alias("ip"),
        (kind != "error").alias("password_ok"),
        c("ts").cast("timestamp").alias("created_at"),
    )


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    columns = ("ts", "user_id", "event_type", "value")
    return attempts_of(spread_table(spark, folder, "events", "event_id", *columns))


def registrations(spark: SparkSession, folder: str) -> DataFrame:
    rank, price, status = c("o_orderpriority"), c("o_totalprice"), c("o_orderstatus")
    who = _text(c("o_custkey"))
    name = (
        F.when(rank == "1-URGENT", _customer_name(c("o_custkey")))
        .when(rank == "2-HIGH", F.concat(F.lit("APPLICANT#"), who))
        .when(rank == "3-MEDIUM", F.concat(F.lit("applicant#"), who))
        .when(rank == "4-NOT SPECIFIED", F.concat(F.lit("Ápplicant#"), who))
        .when(price < 20000, F.repeat(F.lit("x"), F.lit(65)))
        .otherwise(F.concat(F.lit("Guest#"), _text(c("o_orderkey"))))
    )
    broken = (status == "P") & (price > 400000)
    no_password = (status == "O") & (price < 40000)
    columns = ("o_custkey", "o_orderpriority", "o_totalprice", "o_orderstatus", "o_orderdate")
    return spread_table(spark, folder, "orders", "o_orderkey", *columns).select(
        c("o_orderkey").alias("seq"),
        name.alias("username"),
        F.when(broken, "no-address")
        .otherwise(F.concat(who, F.lit("@example.com")))
        .alias("email"),
        F.when(~no_password, F.concat(F.lit("hash-"), _text(c("o_orderkey")))).alias(
            "password_hash"
        ),
        c("o_orderdate").cast("timestamp").alias("created_at"),
    )


def patches(spark: SparkSession, folder: str) -> DataFrame:
    kind, value, who = c("event_type"), c("value"), _text(c("user_id"))
    name = (
        F.when(kind == "signup", F.concat(F.lit("Member#"), who))
        .when((kind == "purchase") & (value > 40), F.concat(F.lit("MEMBER#"), who))
        .when(kind == "purchase", F.concat(F.lit("Shared#"), _whole(value)))
        .when(kind == "view", "")
        .when((kind == "click") & (value > 60), _customer_name(c("user_id")))
        .when((kind == "click") & (value < 5), F.upper(_customer_name(c("user_id"))))
        .when((kind == "error") & (value > 60), "customer#000000001")
    )
    mail = F.when((kind == "click") & (value > 100), "broken").when(
        kind.isin("click", "signup", "error"),
        F.concat(F.lit("m"), _text(c("event_id")), F.lit("@example.com")),
    )
    view = kind == "view"
    return table(spark, folder, "events").select(
        c("event_id").alias("seq"),
        F.when((kind == "error") & (value < 20), -1 - c("event_id"))
        .otherwise(c("user_id"))
        .alias("user_id"),
        name.alias("username"),
        mail.alias("email"),
        F.when(kind == "signup", F.concat(F.lit("new-"), _text(c("event_id")))).alias(
            "password_hash"
        ),
        F.when(view & (value > 50), "admin").alias("role"),
        F.when(view & (value > 30), value > 60).alias("is_active"),
        F.when(kind == "purchase", c("ts").cast("timestamp")).alias("last_login_at"),
    )


def deletions(spark: SparkSession, folder: str) -> DataFrame:
    """Every order is a request: large ones close their account, others name none."""
    unknown = (c("o_orderstatus") == "P") | (c("o_totalprice") <= 450000)
    return table(spark, folder, "orders").select(
        c("o_orderkey").alias("seq"),
        F.when(unknown, -1 - c("o_orderkey"))
        .otherwise(c("o_custkey"))
        .alias("user_id"),
    )


def id_requests(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        c("p_partkey").alias("seq"), c("p_partkey").alias("id")
    )


def json_messages(spark: SparkSession, folder: str) -> DataFrame:
    body = F.when(c("event_type") == "error", F.replace(c("props"), F.lit("}"), F.lit("")))
    return table(spark, folder, "events").select(
        "event_id", body.otherwise(c("props")).alias("body")
    )


# --- experiments -------------------------------------------------------------


def experiment_id() -> Column:
    parts = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return F.concat_ws("-", F.lit("exp"), *[_text(c(p)) for p in parts])


def _measures() -> dict[str, Column]:
    return {
        "temperature": c("l_quantity").cast(MEASURE),
        "pressure": F.round(c("l_discount") * 100).cast(MEASURE),
        "duration": F.when(c("l_tax") > 0, F.round(c("l_tax") * 100)).cast(MEASURE),
    }


PARAMS = ["temperature", "pressure", "duration"]


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    rest = [n for n in table(spark, folder, "lineitem").columns if n != "l_orderkey"]
    return spread_table(spark, folder, "lineitem", "l_orderkey", *rest)


def _typed_lines(spark: SparkSession, folder: str) -> DataFrame:
    types = table(spark, folder, "part").select(
        c("p_partkey").alias("l_partkey"), c("p_type").alias("experiment_type")
    )
    return _lines(spark, folder).join(types, "l_partkey")


def experiments(spark: SparkSession, folder: str) -> DataFrame:
    owners = table(spark, folder, "orders").select(
        c("o_orderkey").alias("l_orderkey"), c("o_custkey").alias("user_id")
    )
    return (
        _typed_lines(spark, folder)
        .join(owners, "l_orderkey")
        .select(
            experiment_id().alias("experiment_id"),
            "user_id",
            "experiment_type",
            c("l_shipdate").cast("timestamp").alias("created_at"),
        )
    )


def experiment_requests(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        c("o_orderkey").alias("seq"),
        c("o_custkey").alias("user_id"),
        c("o_orderpriority").alias("experiment_type"),
    )


def typed_experiments(spark: SparkSession, folder: str) -> DataFrame:
    """Experiments without their user, for jobs that do not need one."""
    return _typed_lines(spark, folder).select(
        experiment_id().alias("experiment_id"), "experiment_type"
    )


def parameters(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.experiments import to_long

    wide = table(spark, folder, "lineitem").select(
        experiment_id().alias("experiment_id"), *[m.alias(n) for n, m in _measures().items()]
    )
    return to_long(wide, PARAMS, ["experiment_id"])


def results(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        experiment_id().alias("experiment_id"), *_result()
    )


def _result() -> list[Column]:
    return [
        c("l_extendedprice").cast(MEASURE).alias("outcome"),
        (c("l_returnflag") == "N").alias("success"),
    ]


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Experiments with their parameters as columns and their result."""
    return _typed_lines(spark, folder).select(
        experiment_id().alias("experiment_id"),
        "experiment_type",
        *[m.alias(n) for n, m in _measures().items()],
        *_result(),
    )


def long_observations(spark: SparkSession, folder: str, missing: bool = False) -> DataFrame:
    """One row per experiment and parameter, with the result of the experiment."""
    wide = observations(spark, folder)
    long = wide.unpivot(
        ["experiment_id", "experiment_type", "outcome"], PARAMS, "name", "value"
    )
    return long if missing else long.filter(c("value").isNotNull())


def counts_per_user(spark: SparkSession, folder: str) -> DataFrame:
    """Experiments and successes, summed per order before they meet their user."""
    per_order = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count("*").alias("experiments"),
            F.count_if(c("l_returnflag") == "N").alias("successes"),
        )
    )
    owners = table(spark, folder, "orders").select(
        c("o_orderkey").alias("l_orderkey"), c("o_custkey").alias("user_id")
    )
    return per_order.join(owners, "l_orderkey").select("user_id", "experiments", "successes")


def raw_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Experiment rows as somebody typed them."""
    flag, status, line = c("l_returnflag"), c("l_linestatus"), c("l_linenumber")
    kind = (
        F.when(flag == "A", "solubility")
        .when(flag == "R", "reaction")
        .when(status == "F", "crystallization")
        .when(line > 5, "")
        .otherwise("distillation")
    )
    heat = _whole(c("l_quantity"))
    pressure = _whole(F.round(c("l_discount") * 100))
    return _lines(spark, folder).select(
        experiment_id().alias("experiment_id"),
        kind.alias("experiment_type"),
        F.when(line == 7, "n/a")
        .when(line == 6, F.concat(F.lit(" "), heat, F.lit(" ")))
        .otherwise(heat)
        .alias("temperature"),
        F.when(F.round(c("l_tax") * 100) == 8, F.concat(F.lit("-"), pressure))
        .otherwise(pressure)
        .alias("pressure"),
        F.when(F.round(c("l_tax") * 100) == 7, F.lit(""))
        .otherwise(_whole(c("l_extendedprice")))
        .alias("outcome"),
    )


def range_texts(spark: SparkSession, folder: str) -> DataFrame:
    heat, limit = _whole(c("l_quantity")), _text(c("l_suppkey"))
    flag, status = c("l_returnflag"), c("l_linestatus")
    text = (
        F.when(flag == "A", F.concat_ws("-", heat, limit))
        .when((flag == "R") & (status == "O"), F.concat_ws("-", F.lit(""), heat, limit))
        .when(flag == "R", heat)
        .when(status == "O", F.concat_ws("- ", heat, limit, F.lit("x")))
        .when(c("l_linenumber") > 4, F.lit(""))
        .otherwise("warm-hot")
    )
    return _lines(spark, folder).select(
        experiment_id().alias("experiment_id"), text.alias("range_text")
    )


def upload_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Per part: files chosen for an upload and the position removed afterwards."""
    endings = [("p_name", ".csv"), ("p_brand", ".XLSX"), ("p_type", ".txt"), ("p_name", ".csv")]
    files = F.array(
        *[F.struct(F.concat(c(column), F.lit(end)).alias("name")) for column, end in endings]
    )
    return table(spark, folder, "part").select(
        "p_partkey",
        F.array(F.lit("old.csv")).alias("names"),
        files.alias("files"),
        F.floor(c("p_size") / 10).cast("int").alias("position"),
    )


def query_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Constraint queries with ranges as text, one per supplier."""
    nation, balance = c("s_nationkey"), c("s_acctbal")
    kind = (
        F.when(nation < 4, "STANDARD")
        .when(nation < 8, "MEDIUM")
        .when(nation < 12, "PROMO")
        .when(nation < 16, "LARGE")
        .when(nation < 20, "SMALL")
        .when(nation < 24, "ECONOMY")
        .otherwise("")
    )
    upper = _whole(nation + F.floor(balance / 200))
    heat = F.when(balance < 0, F.concat(_text(nation), F.lit("-"))).otherwise(
        F.concat_ws("-", _text(nation), upper)
    )
    pressure = (
        F.when(balance > 5000, F.concat(F.lit("2-"), _whole(balance / 1000)))
        .when(balance > 2000, "")
        .otherwise("-5")
    )
    return table(spark, folder, "supplier").select(
        c("s_suppkey").alias("query_id"),
        kind.alias("experiment_type"),
        heat.alias("temperature_range"),
        pressure.alias("pressure_range"),
    )


# --- predictions and feedback ------------------------------------------------


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        c("o_orderkey").alias("prediction_id"),
        c("o_totalprice").alias("score"),
        (c("o_orderstatus") == "F").alias("predicted_success"),
    )


def prediction_bridge(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        c("l_orderkey").alias("prediction_id"), c("l_partkey").alias("parameter_id")
    )


def prediction_params(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        c("p_partkey").alias("parameter_id"),
        c("p_brand").alias("name"),
        c("p_size").cast("double").alias("value"),
    )


def feedback(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import types as T

    key = T.StructType([T.StructField("k", T.LongType())])
    return table(spark, folder, "events").select(
        "event_id",
        parse_json(c("props"), key)["k"].alias("prediction_id"),
        "user_id",
        c("value").cast(MEASURE).alias("rating"),
        (c("event_type") == "purchase").alias("success"),
        c("ts").cast("timestamp").alias("created_at"),
    )


def feedback_messages_of(events: DataFrame) -> DataFrame:
    """Feedback as JSON texts, those of errors without their closing brace."""
    body = F.to_json(
        F.struct(
            F.get_json_object("props", "$.k").cast("long").alias("prediction_id"),
            "user_id",
            c("value").alias("rating"),
            (c("event_type") == "purchase").alias("success"),
        )
    )
    broken = F.replace(body, F.lit("}"), F.lit(""))
    return events.select(
        F.when(c("event_type") == "error", broken).otherwise(body).alias("body")
    )


def results_of(events: DataFrame) -> DataFrame:
    """Experiments as they finish; also for a stream of events."""
    return events.select(
        "user_id",
        (c("event_type") == "purchase").alias("success"),
        c("ts").cast("timestamp").alias("created_at"),
    )


def user_changes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "user_id",
        c("event_id").alias("seq"),
        c("event_type").alias("state"),
        c("ts").cast("timestamp").alias("valid_from"),
    )


# --- literature --------------------------------------------------------------


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread_table(spark, folder, "documents", "doc_id", "text")


def typed_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the language as their type; it is unknown for a quarter of them."""
    docs = spread_table(spark, folder, "documents", "doc_id", "text", "lang")
    hidden = F.substring(F.md5(_text(c("doc_id")).cast("binary")), 1, 1).isin(*"0123")
    return docs.select("doc_id", "text", F.when(~hidden, c("lang")).alias("data_type"))


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """Short laboratory reports, one per part, with values in every unit, ranges, values that
    no measurement has, and numbers without a unit; ids are negative."""
    size, price = c("p_size"), _whole(c("p_retailprice"))

    def times(factor: int) -> Column:
        return _text(size * factor)

    text = F.concat(
        F.when(size % 3 == 0, "heat was applied: ").when(size % 3 == 1, "sich ").otherwise(""),
        times(1), F.lit("-"), times(2), F.lit(" °C, "), times(9), F.lit(" K, "), times(150), F.lit("°C at "),
        price, F.lit(" atm or -"), times(1), F.lit(" bar, "), times(400), F.lit(" bar; "), times(3), F.lit(".5 mg/mL, "),
        times(2), F.lit(" g/L, 0."), times(1), F.lit(" mol/L, "), times(1), F.lit(" %, batch "), price, F.lit("0000000."),
    )
    return spread_table(spark, folder, "part", "p_partkey", "p_size", "p_retailprice").select(
        (-c("p_partkey") - 1).cast("long").alias("doc_id"), text.alias("text")
    )


def literature(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and reports."""
    return documents(spark, folder).unionByName(reports(spark, folder))


def dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """Long words and all word pairs of the benchmark texts, with their first item."""
    tokens = table(spark, folder, "benchmark").select(
        "item_id", words(c("text")).alias("tokens")
    )
    long_words = F.filter(c("tokens"), lambda w: F.length(w) >= 9)
    return (
        tokens.select("item_id", F.explode(F.concat(long_words, ngrams(c("tokens"), 2))).alias("entity"))
        .groupBy("entity")
        .agg(F.min("item_id").alias("item_id"))
    )


def phrases(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of one to five words of the benchmark texts, cut at every fifth word, whose length
    follows from their place; each with its first item."""
    tokens = table(spark, folder, "benchmark").select("item_id", words(c("text")).alias("tokens"))
    places = F.sequence(F.lit(0), F.size("tokens") - 1, F.lit(5))
    runs = F.transform(
        F.when(F.size("tokens") > 0, places),
        lambda i: F.array_join(F.slice("tokens", i + 1, F.pmod(i.cast("int") / 5, F.lit(5)).cast("int") + 1), " "),
    )
    return (
        tokens.select("item_id", F.explode(runs).alias("entity"))
        .groupBy("entity")
        .agg(F.min("item_id").alias("item_id"))
    )


def uploaded(spark: SparkSession, folder: str) -> DataFrame:
    """Experiment rows as text in the layout of an uploaded file."""
    return raw_rows(spark, folder).select(
        "experiment_id", F.lit(None).cast("string").alias("user_id"), "experiment_type",
        "temperature", "pressure", "outcome", F.lit("true").alias("success"),
    )
