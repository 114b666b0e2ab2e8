"""A third of all rows under one key: results stay whole."""

from decimal import Decimal

from pyspark.sql import functions as F

from assaylake import schemas
from assaylake.operators import accounts, experiments, feedback, recommend
from test_accounts import T0, make_users

N = 30_000
HOT = N // 3


def spell(i):
    return F.when(i < HOT, F.lit("Hot")).otherwise(F.concat(F.lit("n"), (i % 500).cast("string")))


def test_registrations_for_one_name(spark):
    i = F.col("id")
    requests = spark.range(N).select(
        i.alias("seq"),
        F.when(i % 2 == 0, F.upper(spell(i))).otherwise(spell(i)).alias("username"),
        F.lit("a@b.c").alias("email"),
        F.lit("h").alias("password_hash"),
        F.lit(T0).cast("timestamp").alias("created_at"),
    )
    users = make_users(spark, [(1, "N7", "user", True)])
    new = accounts.register(requests, users)
    assert new.count() == 500  # hot and n0..n499 without n7
    assert new.filter("seq = 0").select("username", "id").first() == ("HOT", 2)
    status = {
        r["status"]: r["count"]
        for r in accounts.registration_answers(requests, users).groupBy("status").count().collect()
    }
    assert status == {201: 500, 400: N - 500}


def test_patches_of_one_user(spark):
    i = F.col("id")
    users = make_users(spark, [(u, f"u{u}", "user", True) for u in range(100)])
    fields = {
        "seq": i,
        "user_id": F.when(i < HOT, 0).otherwise(i % 120),
        "username": F.when(i % 10 == 0, F.lit("Wanted")),
        "email": F.lit(None),
        "password_hash": F.lit(None),
        "role": F.concat(F.lit("r"), i.cast("string")),
        "is_active": F.lit(None),
        "last_login_at": F.lit(None),
    }
    patches = spark.range(N).select(
        *[fields[f.name].cast(f.dataType).alias(f.name) for f in schemas.PATCH_REQUEST]
    )
    decided = accounts.decide_patches(patches, users)
    got = {r["status"]: r["count"] for r in decided.groupBy("status").count().collect()}
    unknown = sum(n % 120 >= 100 for n in range(HOT, N))
    refused = sum(
        n % 10 == 0 and n % 120 != 0 and n % 120 < 100 for n in range(HOT, N)
    )
    assert got == {404: unknown, 400: refused, 200: N - unknown - refused}
    after = accounts.apply_patches(users, decided)
    assert after.filter("username = 'Wanted'").select("id").collect() == [(0,)]
    last = max(n for n in range(HOT, N) if n % 120 == 0)
    assert after.filter("id = 0").first()["role"] == f"r{last}"


def test_feedback_on_one_prediction(spark):
    i = F.col("id")
    rated = spark.range(N).select(
        F.when(i < HOT, 1).otherwise(i % 50 + 2).cast("long").alias("prediction_id"),
        F.lit(Decimal("2.5000")).cast(schemas.MEASURE).alias("rating"),
        (i % 2 == 0).alias("success"),
    )
    links = spark.range(1, 52).select(i.alias("prediction_id"), F.lit(9).cast("long").alias("parameter_id"))
    params = spark.createDataFrame([(9, "t", 5.0)], "parameter_id long, name string, value double")
    row = feedback.effectiveness(rated, links, params, 10.0).collect()
    assert [tuple(r) for r in row] == [("t", 0, N, N // 2, 2.5)]
    report = experiments.orphans(
        {"f": (rated, "prediction_id", links.filter("prediction_id <> 1"), "prediction_id")}
    )
    assert [tuple(r) for r in report.collect()] == [("f", "1", HOT)]


def test_one_setting_and_one_bucket(spark):
    i = F.col("id")
    observed = spark.range(N).select(
        F.lit("reaction").alias("experiment_type"),
        F.when(i < HOT, 20).otherwise(i % 90).cast(schemas.MEASURE).alias("temperature"),
        F.when(i < HOT, 1).otherwise(i % 7).cast(schemas.MEASURE).alias("pressure"),
        F.lit(1).cast(schemas.MEASURE).alias("outcome"),
        F.lit(True).alias("success"),
    )
    queries = spark.range(300).select(
        i.alias("query_id"),
        F.lit("reaction").alias("experiment_type"),
        F.lit(20.0).alias("temperature_min"),
        F.when(i >= 100, 20.0).otherwise(i + 20.0).alias("temperature_max"),
        F.lit(None).cast("double").alias("pressure_min"),
        F.lit(None).cast("double").alias("pressure_max"),
    )
    met = recommend.match(queries, recommend.settings(observed)).groupBy("query_id").agg(F.sum("n").alias("n"))
    got = {r["query_id"]: r["n"] for r in met.collect()}
    per_degree = [HOT * (t == 20) + sum(n % 90 == t for n in range(HOT, N)) for t in range(90)]
    assert got == {
        q: sum(per_degree[20 : (q + 21 if q < 100 else 21)]) for q in range(300)
    }


def test_hot_join_partitions_are_split(spark):
    """With thresholds scaled down to the test, the hot side is read by several tasks."""
    low = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    i = F.col("id")
    users = spark.range(2000).select(
        i, F.concat(F.lit("u"), i.cast("string")).alias("username"), F.lit("e").alias("email"),
        F.lit("r").alias("role"), F.lit(True).alias("is_active"),
        F.lit(T0).alias("created_at"), F.lit(None).cast("timestamp").alias("last_login_at"),
    )
    # Several map tasks, as a hot partition is split between their outputs.
    many = spark.range(0, 200_000, 1, 16)
    owned = many.select(
        F.when(i < 70_000, 5).otherwise(i % 2000).cast("long").alias("user_id"),
        F.sha2(i.cast("string"), 256).alias("experiment_id"),
    )
    asked = owned.select(F.col("user_id").alias("id"), F.col("experiment_id").alias("seq"))
    for key, value in low.items():
        spark.conf.set(key, value)
    try:
        for joined in (
            experiments.list_experiments(owned, users),
            accounts.find_by_id(asked, users),
        ):
            assert joined.count() == 200_000
            joined.write.format("noop").mode("overwrite").save()
            joined.collect()
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "skew=true" in plan or "isSkewJoin=true" in plan or "AQEShuffleRead coalesced and skewed" in plan
    finally:
        for key in low:
            spark.conf.unset(key)
