import pytest
from decimal import Decimal

from pyspark.sql import functions as F

from assaylake import schemas
from assaylake.operators import experiments, feedback, history
from test_accounts import make_users
from test_logins import PEOPLE


def raw(spark, *items):
    return spark.createDataFrame(
        list(items),
        "experiment_id string, experiment_type string, temperature string, pressure string, outcome string",
    )


def test_check_rows(spark):
    checked = experiments.check_rows(
        raw(
            spark,
            ("e1", "reaction", " 20 ", "1.5", "7"),
            ("e2", "", "x", "-1", ""),
            ("e3", "brewing", None, "", "seven"),
            (None, None, "1", "1", None),
            ("e5", "reaction", "1", "1", "2"),
        )
    )
    got = {r["experiment_id"]: r for r in checked.collect()}
    assert got["e1"]["errors"] == [] and got["e1"]["temperature"] == 20.0
    assert got["e2"]["errors"] == [
        "type_missing", "temperature_unreadable", "pressure_negative", "outcome_missing"
    ]
    assert got["e3"]["errors"] == ["type_unknown", "outcome_unreadable"]
    assert got[None]["errors"] == ["id_missing", "type_missing", "outcome_missing"]
    from assaylake.functions.checks import split_rows

    good, bad = split_rows(checked)
    assert (good.count(), bad.count()) == (2, 3)
    assert "errors" not in good.columns


def test_create(spark, rows):
    asked = spark.createDataFrame([(30, "reaction"), (10, "solubility")], "seq long, experiment_type string")
    assert rows(experiments.create_experiments(asked), "seq", "experiment_id") == [(10, "exp_001"), (30, "exp_002")]
    assert rows(experiments.create_experiments(asked, 999), "experiment_id") == [("exp_1000",), ("exp_1001",)]


def test_long_wide_map(spark, rows):
    wide = spark.createDataFrame(
        [("e1", Decimal("20"), None), ("e2", Decimal("30"), Decimal("2"))],
        "experiment_id string, temperature decimal(18,4), pressure decimal(18,4)",
    )
    long = experiments.to_long(wide, ["temperature", "pressure"], ["experiment_id"])
    assert rows(long) == [
        ("e1", "temperature", Decimal("20.0000")),
        ("e2", "pressure", Decimal("2.0000")),
        ("e2", "temperature", Decimal("30.0000")),
    ]
    back = experiments.to_wide(long, ["temperature", "pressure"])
    assert rows(back) == rows(wide)
    mapped = experiments.parameter_map(wide, ["temperature", "pressure"])
    got = {r["experiment_id"]: r["params"] for r in mapped.collect()}
    assert got == {
        "e1": {"temperature": Decimal("20.0000")},
        "e2": {"temperature": Decimal("30.0000"), "pressure": Decimal("2.0000")},
    }


def test_lists_and_joins(spark, rows):
    users = make_users(spark, PEOPLE)
    table = spark.createDataFrame(
        [("e1", 1, "reaction", None), ("e2", 9, "reaction", None)], schemas.EXPERIMENT
    )
    assert rows(experiments.list_experiments(table, users), "experiment_id", "username") == [("e1", "bob"), ("e2", None)]
    params = spark.createDataFrame([("e1", "t", Decimal(1)), ("e1", "p", Decimal(2))], schemas.PARAMETER)
    results = spark.createDataFrame([("e1", Decimal(5), True)], schemas.RESULT)
    joined = experiments.with_parameters(table, params, results)
    assert rows(joined, "experiment_id", "name", "success") == [("e1", "p", True), ("e1", "t", True)]
    predictions = spark.createDataFrame([(1, 0.5)], "prediction_id long, score double")
    bridge = spark.createDataFrame([(1, 7), (1, 8), (1, 7), (2, 7)], schemas.PREDICTION_PARAMETER)
    names = spark.createDataFrame([(7, "t"), (8, "p")], "parameter_id long, name string")
    linked = experiments.prediction_parameters(predictions, bridge, names)
    assert rows(linked, "prediction_id", "name") == [(1, "p"), (1, "t")]


def test_orphans(spark, rows):
    child = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long")
    parent = spark.createDataFrame([(2,), (2,), (3,)], "id long")
    assert rows(experiments.orphans({"child": (child, "k", parent, "id")})) == [("child", "1", 2)]


def test_dashboard(spark, rows):
    users = make_users(spark, [(1, "a", "user", True), (2, "b", "user", True), (3, "c", "user", True)])
    counts = spark.createDataFrame(
        [(1, 10, 7), (1, 2, 1), (2, 3, 0)], "user_id long, experiments long, successes long"
    )
    assert rows(experiments.dashboard(counts, users)) == [(1, 12, 8, 67), (2, 3, 0, 0), (3, 0, 0, None)]


def test_feedback(spark, rows):
    messages = spark.createDataFrame(
        [('{"prediction_id": 1, "user_id": 2, "rating": 4.5, "success": true}',), ("{",), ("",)],
        "body string",
    )
    good, bad = feedback.read_feedback(messages)
    assert good.schema.names == schemas.FEEDBACK.names
    assert rows(good, "prediction_id", "rating", "success") == [(1, Decimal("4.5000"), True)]
    assert bad.count() == 2
    rated = spark.createDataFrame(
        [(1, 1, Decimal(4), True, None), (1, 2, Decimal(2), False, None), (2, 1, Decimal(1), None, None)],
        schemas.FEEDBACK,
    )
    predictions = spark.createDataFrame(
        [(1, True), (2, None)], "prediction_id long, predicted_success boolean"
    )
    assert rows(feedback.compare_feedback(rated, predictions), "prediction_id", "success", "matches") == [
        (1, False, False), (1, True, True), (2, None, True)
    ]
    bridge = spark.createDataFrame([(1, 7), (1, 7), (2, 7), (2, 8)], schemas.PREDICTION_PARAMETER)
    params = spark.createDataFrame(
        [(7, "t", 25.0), (8, "t", 31.0)], "parameter_id long, name string, value double"
    )
    assert rows(feedback.effectiveness(rated, bridge, params, 10.0)) == [
        ("t", 2, 3, 1, round(7 / 3, 4)), ("t", 3, 1, 0, 1.0)
    ]


def test_history_over_slices(spark, rows):
    changes = spark.createDataFrame(
        [(1, 1, "2024-01-01 10:00"), (1, 2, "2024-01-01 10:00"), (1, 3, "2024-01-01 23:59"),
         (1, 4, "2024-01-09 00:00"), (2, 5, "2024-01-02 00:00")],
        "user_id long, seq long, t string",
    ).selectExpr("user_id", "seq", "cast(t as timestamp) as valid_from")
    for seconds in (60, 3600, 86400 * 365):
        out = history.versions(changes, "user_id", "seq", seconds)
        got = [
            (s, str(v) if v else None, c) for s, v, c in rows(out, "seq", "valid_to", "is_current")
        ]
        assert got == [
            (1, "2024-01-01 10:00:00", False), (2, "2024-01-01 23:59:00", False),
            (3, "2024-01-09 00:00:00", False), (4, None, True), (5, None, True),
        ]


def test_versions_keep_null_rows(spark):
    changes = spark.createDataFrame(
        [(1, None, 1), (1, "2020-01-02", 2), (1, "2020-01-03", 3), (None, "2020-01-01", 4), (2, None, 5)],
        "user_id long, valid_from string, seq long",
    ).withColumn("valid_from", F.col("valid_from").cast("timestamp"))
    out = {r.seq: (str(r.valid_to)[:10], r.is_current) for r in history.versions(changes, "user_id", "seq").collect()}
    assert out == {
        1: ("2020-01-02", False), 2: ("2020-01-03", False), 3: ("None", True), 4: ("None", True), 5: ("None", True),
    }


def test_merged_changes_equal_the_whole_history(spark, tmp_path, rows):
    root = str(tmp_path / "history")

    def made(*given):
        return spark.createDataFrame(given, "user_id long, valid_from string, seq long, state string").withColumn(
            "valid_from", F.col("valid_from").cast("timestamp")
        )

    def files():
        return {str(f.relative_to(root)): f.stat().st_mtime_ns for f in (tmp_path / "history").rglob("*.parquet")}

    first = made(*[(k, f"2024-01-0{d}", 10 * k + d, f"s{d}") for k in range(20) for d in (1, 5)], (None, "2024-01-01", 900, "n"))
    late = made((3, "2024-01-03", 999, "late"), (3, "2024-01-03", 999, "last"), (3, None, 998, "open"), (None, "2024-01-02", 901, "n"))
    assert history.merge_changes(first, root, "user_id", "seq", 8) <= 8
    before = files()
    assert history.merge_changes(late, root, "user_id", "seq", 8) <= 2
    after = files()
    folders = {f.split("/")[0] for f in after if after.get(f) != before.get(f)}
    assert len(folders) <= 2 and all(after[f] == t for f, t in before.items() if f.split("/")[0] not in folders)
    columns = ["user_id", "seq", "valid_from", "state", "valid_to", "is_current"]
    whole = first.unionByName(late.where("state <> 'last'"))
    expected = rows(history.versions(whole, "user_id", "seq"), *columns)
    assert rows(history.read_history(spark, root), *columns) == expected
    history.merge_changes(late, root, "user_id", "seq", 8)
    history.merge_changes(late.limit(0), root, "user_id", "seq", 8)
    assert rows(history.read_history(spark, root), *columns) == expected
    split = {r.seq: str(r.valid_to) for r in history.read_history(spark, root).where("user_id = 3").collect()}
    assert split == {998: "2024-01-01 00:00:00", 31: "2024-01-03 00:00:00", 999: "2024-01-05 00:00:00", 35: "None"}


def test_merge_refuses_clashing_columns(spark, tmp_path):
    changes = spark.range(1).selectExpr("id", "id as seq", "current_timestamp() as valid_from", "id as VALID_TO")
    with pytest.raises(ValueError, match="valid_to"):
        history.merge_changes(changes, str(tmp_path / "h"), "id", "seq")
