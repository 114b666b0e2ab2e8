from datetime import timedelta

import pytest

from assaylake import schemas
from assaylake.operators import logins
from assaylake.streaming import jobs
from test_accounts import T0, make_users
from test_logins import PEOPLE, make_attempts


@pytest.fixture
def incoming(spark, tmp_path):
    """A folder of attempts in four files, read one file per micro-batch."""
    folder = str(tmp_path / "in")
    parts = [
        [(1, "bob", True, 0), (2, "nobody", True, 5)],
        [(3, "BOB", False, 70), (4, "elan", True, 75)],
        [(5, "bob", True, 200)],
        [(6, "bob", True, 3)],
    ]
    for part in parts:
        make_attempts(spark, part).coalesce(1).write.mode("append").parquet(folder)
    stream = (
        spark.readStream.schema(schemas.LOGIN_REQUEST).option("maxFilesPerTrigger", 1).parquet(folder)
    )
    return folder, stream


def test_login_stream_equals_batch(spark, rows, incoming, tmp_path):
    folder, stream = incoming
    users = make_users(spark, PEOPLE)
    out = str(tmp_path / "out")
    jobs.login_stream(stream, users, out).awaitTermination()
    decided = logins.decide_logins(spark.read.schema(schemas.LOGIN_REQUEST).parquet(folder), users)
    audit = spark.read.parquet(f"{out}/audit")
    assert audit.select("batch").distinct().count() == 4
    assert rows(audit, "user_id", "username", "ok") == rows(decided, "user_id", "username", "ok")
    assert rows(audit, "id") == [(i,) for i in range(1, 7)]
    assert rows(spark.read.parquet(f"{out}/answers"), "seq", "status") == rows(decided, "seq", "status")
    latest = logins.last_logins(decided)
    assert rows(jobs.latest_logins(spark, out), "user_id", "last_login_at") == rows(latest, "user_id", "last_login_at")
    # Nothing new: a second run adds nothing.
    jobs.login_stream(stream, users, out).awaitTermination()
    assert spark.read.parquet(f"{out}/audit").count() == 6


def test_a_repeated_batch_changes_nothing(spark, rows, tmp_path):
    """A batch that is written again, as after a failure, replaces its own output."""
    users, out = make_users(spark, PEOPLE), str(tmp_path / "out")
    batches = [[(1, "bob", True, 0), (2, "elan", True, 5)], [(3, "bob", True, 70), (4, "nobody", True, 75)], [(5, "bob", True, 3000)]]
    written = []

    def each(stream, folder, write, trigger=None):
        written.append(write)

    before = jobs._each_batch
    jobs._each_batch = each
    try:
        jobs.login_stream(None, users, out)
    finally:
        jobs._each_batch = before

    def state():
        return (
            rows(jobs.latest_logins(spark, out), "user_id", "last_login_at"), rows(jobs.stream_audit(spark, out)),
            rows(spark.read.parquet(f"{out}/audit"), "dt", "batch"),
        )

    for number, batch in enumerate(batches):
        written[0](make_attempts(spark, batch), number)
        once = state()
        written[0](make_attempts(spark, batch), number)
        assert state() == once
    latest = dict(state()[0])
    assert latest == {1: T0 + timedelta(minutes=3000)}
    days = {r.dt for r in spark.read.parquet(f"{out}/audit").select("dt").distinct().collect()}
    assert len(days) == 2
    first = str(min(days))
    assert jobs.stream_audit(spark, out, last=first).count() == 4
    plan = jobs.stream_audit(spark, out, first=first, last=first)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan


def test_usage_stream_counts_late_rows(spark, rows, incoming, tmp_path):
    folder, stream = incoming
    decided = logins.decide_logins(stream, make_users(spark, PEOPLE))
    out = str(tmp_path / "use")
    jobs.usage_stream(decided, out).awaitTermination()
    names = ["window_start", "username", "attempts", "failures"]
    # Attempt 6 belongs to the first hour but comes after later hours.
    batch = logins.decide_logins(spark.read.schema(schemas.LOGIN_REQUEST).parquet(folder), make_users(spark, PEOPLE))
    want = rows(logins.usage(batch), *names)
    assert sum(r[2] for r in want) == 6
    assert rows(jobs.summed(spark, out, jobs.USAGE_KEYS), *names) == want
    jobs.usage_stream(decided, out).awaitTermination()
    assert rows(jobs.summed(spark, out, jobs.USAGE_KEYS), *names) == want


def test_dashboard_stream(spark, rows, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame(
        [(1, True, T0), (1, False, T0), (2, True, T0 + timedelta(hours=5))],
        "user_id long, success boolean, created_at timestamp",
    ).write.parquet(folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    jobs.dashboard_stream(stream, str(tmp_path / "d"), trigger={"processingTime": "1 second"}).processAllAvailable()
    for query in spark.streams.active:
        query.stop()
    found = jobs.summed(spark, str(tmp_path / "d"), jobs.DASHBOARD_KEYS)
    assert rows(found, "window_start", "user_id", "experiments", "successes") == [
        (T0, 1, 2, 1), (T0 + timedelta(hours=5), 2, 1, 1)
    ]


def test_feedback_stream(spark, rows, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text('{"prediction_id": 1, "rating": 2}\nbroken\n{"prediction_id": 3}\n')
    stream = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "body")
    out = str(tmp_path / "out")
    jobs.feedback_stream(stream, out).awaitTermination()
    assert rows(spark.read.parquet(f"{out}/feedback"), "prediction_id") == [(1,), (3,)]
    assert rows(spark.read.parquet(f"{out}/rejected"), "body") == [("broken",)]
