import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from assaylake.operators import recommend, screening

random.seed(11)
OBSERVATIONS = [
    (
        f"e{i}",
        random.choice(["reaction", "solubility"]),
        Decimal(random.randint(-300, 900)) / 10,
        Decimal(random.randint(0, 50)) / 10,
        Decimal(random.randint(0, 10000)) / 100,
        random.random() < 0.6,
    )
    for i in range(400)
]
QUERIES = [
    (1, "reaction", 0.0, 40.0, 1.0, 3.0),
    (2, "reaction", None, None, None, None),
    (3, "solubility", None, 10.0, 2.0, None),
    (4, "solubility", 55.5, None, None, 2.5),
    (5, "reaction", 50.0, 20.0, None, None),
    (6, "brewing", None, None, None, None),
    (7, "reaction", -1e6, 1e6, None, None),
    (8, "reaction", 500.0, None, None, None),
]
KIND = (
    "query_id long, experiment_type string, temperature_min double, temperature_max double, "
    "pressure_min double, pressure_max double"
)


@pytest.fixture(scope="module")
def observed(spark):
    return spark.createDataFrame(
        OBSERVATIONS,
        "experiment_id string, experiment_type string, temperature decimal(18,4), "
        "pressure decimal(18,4), outcome decimal(18,4), success boolean",
    )


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, KIND)


def inside(query, row):
    _, kind, t0, t1, p0, p1 = query
    _, k, t, p, _, _ = row
    return (
        k == kind
        and (t0 is None or t >= t0)
        and (t1 is None or t <= t1)
        and (p0 is None or p >= p0)
        and (p1 is None or p <= p1)
    )


@pytest.mark.parametrize("width", [0.7, 5.0, 1000.0])
def test_match_like_nested_loops(observed, queries, width):
    met = recommend.match(queries, recommend.settings(observed), width)
    counted = met.groupBy("query_id").agg(
        F.sum("n").alias("n"), F.sum("successes").alias("s"), F.sum("total").alias("t")
    )
    got = {r["query_id"]: (r["n"], r["s"], r["t"]) for r in counted.collect()}
    expected = {}
    for q in QUERIES:
        hits = [o for o in OBSERVATIONS if inside(q, o)]
        if hits:
            expected[q[0]] = (len(hits), sum(o[5] for o in hits), sum(o[4] for o in hits))
    assert got == expected
    assert set(got) == {1, 2, 3, 4, 7}


def test_ranking_and_envelopes(observed, queries):
    scored = recommend.score_bins(
        recommend.match(queries, recommend.settings(observed)),
        {"temperature": 20.0, "pressure": 1.0},
    )
    all_rows = scored.collect()
    assert sum(r["n"] for r in all_rows if r["query_id"] == 2) == sum(
        o[1] == "reaction" for o in OBSERVATIONS
    )
    best = recommend.best(scored, 3)
    by_query = {}
    for r in best.collect():
        by_query.setdefault(r["query_id"], []).append(r)
    for number, kept in by_query.items():
        mine = sorted(
            (r for r in all_rows if r["query_id"] == number),
            key=lambda r: (-r["score"], -r["confidence"], r["temperature_bin"], r["pressure_bin"]),
        )
        kept.sort(key=lambda r: r["rank"])
        assert [(r["temperature_bin"], r["pressure_bin"]) for r in kept] == [
            (r["temperature_bin"], r["pressure_bin"]) for r in mine[:3]
        ]
    single = recommend.best_of_one(scored, 2, 3).collect()
    assert [r["score"] for r in single] == [r["score"] for r in by_query[2]]
    answers = {r["query_id"]: r for r in recommend.envelopes(queries, best).collect()}
    assert set(answers) == {q[0] for q in QUERIES}
    assert answers[6]["predictions"] == [] and answers[6]["confidence"] == 0.0
    assert [p["rank"] for p in answers[1]["predictions"]] == [1, 2, 3]
    assert answers[1]["confidence"] == answers[1]["predictions"][0]["confidence"]


def test_forms(spark, rows):
    forms = spark.createDataFrame(
        [(1, "reaction", "20-80", "1-"), (2, "", "1-2", ""), (3, None, "", ""), (4, "x", "-10-20", "hot")],
        "query_id long, experiment_type string, temperature_range string, pressure_range string",
    )
    parsed = recommend.parse_queries(forms)
    assert rows(parsed) == [(1, "reaction", 20.0, 80.0, 1.0, None), (4, "x", None, 10.0, None, None)]
    assert rows(recommend.constraint_rows(parsed)) == [
        (1, "reaction", "pressure", 1.0, None),
        (1, "reaction", "temperature", 20.0, 80.0),
        (4, "x", "pressure", None, None),
        (4, "x", "temperature", None, 10.0),
    ]


def long_form(observed):
    return observed.unpivot(
        ["experiment_id", "experiment_type", "outcome"], ["temperature", "pressure"], "name", "value"
    )


def test_histogram(observed):
    got = recommend.histogram(long_form(observed), 7).collect()
    for kind in ("reaction", "solubility"):
        values = [float(o[2]) for o in OBSERVATIONS if o[1] == kind]
        low, high = min(values), max(values)
        expected = {}
        for v in values:
            bucket = min(int((v - low) * 7 / (high - low)), 6) + 1
            expected[bucket] = expected.get(bucket, 0) + 1
        mine = [r for r in got if r["experiment_type"] == kind and r["name"] == "temperature"]
        assert {r["bucket"]: r["n"] for r in mine} == expected


def test_histogram_of_one_value(spark, rows):
    long = spark.createDataFrame([("r", "t", 5.0)] * 3, "experiment_type string, name string, value double")
    assert rows(recommend.histogram(long), "bucket", "n") == [(1, 3)]


def test_main_effects(observed):
    got = {(r["experiment_type"], r["name"]): r for r in screening.main_effects(long_form(observed), 1).collect()}
    for kind in ("reaction", "solubility"):
        for place, name in ((2, "temperature"), (3, "pressure")):
            mine = [(float(o[place]), float(o[4])) for o in OBSERVATIONS if o[1] == kind]
            xs = [x for x, _ in mine]
            middle = (min(xs) + max(xs)) / 2
            high = [y for x, y in mine if x >= middle]
            low = [y for x, y in mine if x < middle]
            effect = sum(high) / len(high) - sum(low) / len(low)
            row = got[kind, name]
            assert row["effect"] == pytest.approx(effect, abs=1e-3)
            assert (row["n_high"], row["n_low"]) == (len(high), len(low))
            mx, my = sum(xs) / len(xs), sum(y for _, y in mine) / len(mine)
            top = sum((x - mx) * (y - my) for x, y in mine)
            bottom = (sum((x - mx) ** 2 for x in xs) * sum((y - my) ** 2 for _, y in mine)) ** 0.5
            assert row["correlation"] == pytest.approx(top / bottom, abs=1e-5)
        pair = [got[kind, "temperature"], got[kind, "pressure"]]
        strongest = max(pair, key=lambda r: abs(r["effect"]))
        assert strongest["strength_rank"] == 1 and strongest["selected"]
        assert sum(r["selected"] for r in pair) == 1


def test_normalise(spark):
    long = spark.createDataFrame(
        [("r", "t", Decimal(1)), ("r", "t", Decimal(3)), ("r", "t", None), ("r", "p", Decimal(2))],
        "experiment_type string, name string, value decimal(18,4)",
    )
    got = screening.normalise(long).collect()
    t = sorted((r["filled"], r["z_score"], r["unit_scale"]) for r in got if r["name"] == "t")
    assert t == [(1.0, -0.707107, 0.0), (2.0, 0.0, 0.5), (3.0, 0.707107, 1.0)]
    p = [r for r in got if r["name"] == "p"][0]
    assert p["filled"] == 2.0 and p["z_score"] is None and p["unit_scale"] is None


def test_null_temperatures_and_outliers_are_matched(spark, queries):
    rows = [
        ("a", "reaction", None, Decimal("2"), Decimal("1"), True),
        ("b", "reaction", Decimal("90000000000000"), Decimal("2"), Decimal("1"), True),
        ("c", "reaction", Decimal("20.1234"), Decimal("2"), Decimal("1"), False),
        ("d", "reaction", Decimal("21"), None, Decimal("1"), False),
    ]
    observed = spark.createDataFrame(
        rows,
        "experiment_id string, experiment_type string, temperature decimal(18,4), "
        "pressure decimal(18,4), outcome decimal(18,4), success boolean",
    )
    met = recommend.match(queries, recommend.settings(observed)).collect()
    got = sorted((r.query_id, r.temperature is None, r.pressure is None, int(r.temperature or 0)) for r in met)
    assert got == sorted(
        [(1, False, False, 20), (7, False, False, 20), (7, False, True, 21), (8, False, False, 90000000000000)]
        + [(2, True, False, 0), (2, False, False, 90000000000000), (2, False, False, 20), (2, False, True, 21)]
    )


# --- answers from cells ------------------------------------------------------------


@pytest.fixture(scope="module")
def scattered(spark):
    """Continuous values, some missing, and queries with bounds on, off and beyond bins."""
    chance = random.Random(5)
    rows = [
        (
            chance.choice(["a", "b", None]),
            None if chance.random() < 0.1 else Decimal(round(chance.gauss(20, 60), 4)).quantize(Decimal("0.0001")),
            None if chance.random() < 0.1 else Decimal(round(chance.random() * 9, 4)).quantize(Decimal("0.0001")),
            None if chance.random() < 0.1 else Decimal(chance.randint(0, 9999)) / 100,
            chance.choice([True, False, None]),
        )
        for _ in range(3000)
    ]
    rows.append(("a", Decimal("1000000.5"), Decimal("3.5"), Decimal("5"), True))

    def bounds():
        low, high = sorted(round(chance.gauss(20, 60), chance.choice([0, -1, 2])) for _ in range(2))
        return (None if chance.random() < 0.3 else float(low)), (None if chance.random() < 0.3 else float(high))

    asked = []
    for i in range(60):
        t, p = bounds(), tuple(None if v is None else abs(v) / 10 for v in bounds())
        asked.append((i, chance.choice(["a", "b", "c"]), *t, *p))
    asked += [(100, "a", 10.0, 20.0, None, None), (101, "a", 10.0, 10.0, 2.0, 4.0), (102, "b", 30.0, 5.0, None, None)]
    observed = spark.createDataFrame(
        rows, "experiment_type string, temperature decimal(18,4), pressure decimal(18,4), outcome decimal(18,4), success boolean"
    )
    return spark.createDataFrame(asked, KIND), recommend.settings(observed), rows, asked


WIDTHS = {"temperature": 10.0, "pressure": 2.0}


def test_bins_from_cells_equal_bins_from_settings(scattered, rows):
    queries, summed, _, _ = scattered
    cells = recommend.build_cells(summed, WIDTHS, 4)
    got = recommend.best_bins(queries, cells)
    true = recommend.best(recommend.score_bins(recommend.match(queries, summed), WIDTHS), 4)
    assert rows(got) == rows(true.select(*got.columns)) and got.count() > 100


def test_totals_from_cells(scattered, rows):
    queries, summed, data, asked = scattered
    found = {r.query_id: r for r in recommend.totals(queries, recommend.build_cells(summed, WIDTHS, 4)).collect()}
    assert len(found) == len(asked)
    for number, kind, t0, t1, p0, p1 in asked:
        def within(v, low, high):
            return low is None and high is None if v is None else (low is None or v >= low) and (high is None or v <= high)

        met = [r for r in data if r[0] == kind and within(r[1], t0, t1) and within(r[2], p0, p1)]
        given = [float(r[3]) for r in met if r[3] is not None]
        assert (found[number].n, found[number].successes) == (len(met), sum(r[4] is True for r in met))
        if met:
            assert found[number].mean_outcome == pytest.approx(sum(given) / len(met), abs=1e-3)


def test_a_query_meets_few_rows(spark):
    """64 x 64 occupied bins of 100 settings: all but the bins on the edge come summed up."""
    summed = spark.range(64 * 64 * 100).selectExpr(
        "'a' AS experiment_type", "cast(id % 6400 / 10 AS decimal(18,4)) AS temperature",
        "cast(floor(id / 6400) * 2 + 1 AS decimal(18,4)) AS pressure", "1L AS n", "1L AS successes",
        "cast(1 AS decimal(18,4)) AS total", "cast(1 AS decimal(38,8)) AS squares",
    )
    cells = recommend.build_cells(summed, WIDTHS, 3)
    queries = spark.createDataFrame([(1, "a", 15.0, 615.0, 3.0, 119.5), (2, "a", None, None, None, None)], KIND)
    pieces = {r.query_id: r["count"] for r in recommend.covering(queries, cells).groupBy("query_id").count().collect()}
    assert pieces[1] <= (2 * 6) ** 2 and pieces[2] <= 4
    edge = recommend.edge_settings(queries, cells)
    assert edge.filter("query_id = 2").count() == 0
    n_edge = edge.count()
    assert 0 < n_edge <= 2 * 64 * 100 + 2 * 64 * 100
    whole = recommend.totals(queries, cells).filter("query_id = 1").first()
    assert whole.n == recommend.match(queries, summed).filter("query_id = 1").count() > 10 * n_edge
    plan = edge._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Join Inner" in plan


def test_cells_of_nothing(spark, queries, observed):
    cells = recommend.build_cells(recommend.settings(observed.limit(0)), WIDTHS, 3)
    assert recommend.best_bins(queries, cells).count() == 0
    assert {r.n for r in recommend.totals(queries, cells).collect()} == {0}
