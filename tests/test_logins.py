from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import serial
from assaylake import schemas
from assaylake.operators import logins
from test_accounts import NAMES, T0, make_users


def make_attempts(spark, items):
    """items: (seq, name, password_ok, minute)"""
    full = [(s, n, "10.0.0.1", p, T0 + timedelta(minutes=m)) for s, n, p, m in items]
    return spark.createDataFrame(full, schemas.LOGIN_REQUEST)


PEOPLE = [(1, "bob", "user", True), (2, "Élan", "user", False)]


def test_login_edges(spark, rows):
    users = make_users(spark, PEOPLE)
    attempts = make_attempts(
        spark,
        [(1, "nobody", True, 1), (2, "elan", True, 2), (3, "bob", False, 3), (4, "BOB", True, 4),
         (5, "bob", True, 5), (6, "bob", None, 6), (7, None, True, 7), (8, "bob ", True, 8)],
    )
    numbered = logins.number_attempts(attempts, last_id=100)
    decided = logins.decide_logins(numbered, users)
    assert rows(decided, "seq", "user_id", "ok", "status") == [
        (1, None, False, 401), (2, 2, False, 401), (3, 1, False, 401), (4, 1, True, 200),
        (5, 1, True, 200), (6, 1, False, 401), (7, None, False, 401), (8, None, False, 401),
    ]
    audit = logins.audit_rows(decided)
    assert audit.schema.names == schemas.AUDIT.names
    assert rows(audit, "id", "username") == [
        (101, "nobody"), (102, "elan"), (103, "bob"), (104, "BOB"), (105, "bob"), (106, "bob"),
        (107, None), (108, "bob "),
    ]
    after = logins.set_last_logins(users, logins.last_logins(decided))
    assert rows(after, "id", "last_login_at") == [(1, T0 + timedelta(minutes=5)), (2, None)]
    answers = logins.login_answers(decided).filter("status = 200")
    assert rows(answers, "seq", "subject", "expires_at") == [
        (4, "1", T0 + timedelta(minutes=64)), (5, "1", T0 + timedelta(minutes=65))
    ]


def test_usage(spark, rows):
    decided = logins.decide_logins(
        make_attempts(spark, [(1, "bob", True, 0), (2, "bob", False, 59), (3, "bob", True, 60)]),
        make_users(spark, PEOPLE),
    )
    hour = timedelta(hours=1)
    assert rows(logins.usage(decided)) == [
        (T0, T0 + hour, "bob", 2, 1), (T0 + hour, T0 + 2 * hour, "bob", 1, 0)
    ]


people = st.lists(
    st.tuples(st.sampled_from(NAMES), st.booleans()), min_size=1, max_size=4,
    unique_by=lambda p: serial.key(p[0]),
)
tries = st.lists(
    st.tuples(st.sampled_from(NAMES), st.booleans(), st.integers(0, 500)), max_size=8
)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(people, tries), min_size=60, max_size=60))
def test_logins_like_one_by_one(spark, cases):
    users, items, expected, expected_last = [], [], [], {}
    for number, (names, tried) in enumerate(cases):
        tag = f"{number}:"
        mine = {number * 100 + i: (tag + n, a) for i, (n, a) in enumerate(names)}
        users += [(i, n, "user", a) for i, (n, a) in mine.items()]
        attempts = [(number * 1000 + s, tag + n, p, m) for s, (n, p, m) in enumerate(tried)]
        items += attempts
        audit, last = serial.login(mine, attempts)
        expected += audit
        expected_last |= last
    decided = logins.decide_logins(make_attempts(spark, items), make_users(spark, users))
    got = [tuple(r) for r in decided.select("seq", "user_id", "ok").orderBy("seq").collect()]
    assert got == sorted(expected)
    latest = logins.last_logins(decided).collect()
    assert {r["user_id"]: r["last_login_at"] for r in latest} == {
        who: T0 + timedelta(minutes=m) for who, m in expected_last.items()
    }


def test_hot_name(spark):
    """A third of all attempts under one name: nothing lost, one user row each."""
    users = make_users(spark, [(i, f"user{i}", "user", True) for i in range(50)])
    attempts = spark.range(30_000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") < 10_000, "USER7")
        .otherwise(F.concat(F.lit("user"), (F.col("id") % 60).cast("string")))
        .alias("username"),
        F.lit("::1").alias("ip"),
        F.lit(True).alias("password_ok"),
        F.lit(datetime(2024, 1, 1)).cast("timestamp").alias("created_at"),
    )
    decided = logins.decide_logins(attempts, users)
    assert decided.count() == 30_000
    assert decided.filter("user_id = 7").count() == 10_000 + sum(i % 60 == 7 for i in range(10_000, 30_000))
    assert decided.filter("user_id is null").count() == sum(i % 60 >= 50 for i in range(10_000, 30_000))
