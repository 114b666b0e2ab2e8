import json
from decimal import Decimal

import numpy as np
import pytest

from assaylake.operators import learning
from assaylake.streaming import jobs

FEATURES = ["heat", "pressure"]


@pytest.fixture
def known(spark):
    rows = [(p, float(p % 7), float((p * p) % 5) / 4) for p in range(40)]
    return spark.createDataFrame([*rows, (40, None, 1.0)], "prediction_id long, heat double, pressure double")


def ratings(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        p = int(rng.integers(0, 42))  # 40 lacks a feature, 41 is unknown
        out.append((p, round(2 + 0.5 * (p % 7) - 3 * ((p * p) % 5) / 4 + float(rng.normal(0, 0.1)), 4)))
    return out


def least_squares(rated, weights=None):
    used = [(p, y, w) for (p, y), w in zip(rated, weights or [1.0] * len(rated)) if p < 40]
    x = np.array([[1.0, p % 7, ((p * p) % 5) / 4] for p, _, _ in used])
    w = np.sqrt(np.array([w for _, _, w in used]))
    return np.linalg.lstsq(x * w[:, None], np.array([y for _, y, _ in used]) * w, rcond=None)[0]


def frame(spark, rated):
    return spark.createDataFrame([(p, Decimal(str(y))) for p, y in rated], "prediction_id long, rating decimal(18,4)")


def test_sums_add_up(spark, known):
    rated = ratings(600, 1)
    whole = learning.moments(frame(spark, rated), known, FEATURES)
    parts = [learning.moments(frame(spark, rated[i::3]), known, FEATURES) for i in range(3)]
    added = learning.added(parts[0].union(parts[1]).union(parts[2]))
    assert tuple(added.first()) == tuple(whole.first())
    assert np.allclose(list(learning.solve(whole, FEATURES).values()), least_squares(rated), atol=1e-8)
    hot = learning.moments(frame(spark, [(3, 1.5)] * 2000), known, FEATURES).first()
    assert (hot.n, hot.y, hot.x0) == (2000, Decimal(3000), Decimal(6000))


def test_nothing_to_learn(spark, known):
    none = learning.moments(frame(spark, [(41, 1.0), (40, 2.0)]), known, FEATURES)
    assert none.first().n == 0
    assert set(learning.solve(none, FEATURES).values()) == {0.0}
    # Equal features share what they explain.
    twice = known.selectExpr("prediction_id", "heat", "heat as pressure")
    model = learning.solve(learning.moments(frame(spark, ratings(200, 2)), twice, FEATURES), FEATURES)
    assert model["heat"] == pytest.approx(model["pressure"])


def test_stream_learns_like_a_batch_and_forgets(spark, known, tmp_path):
    batches, source, out = [ratings(150, s) for s in (3, 4, 5)], tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for number, rated in enumerate(batches):
        lines = [json.dumps({"prediction_id": p, "rating": y}) for p, y in rated] + ["{broken"]
        (source / f"{number}.txt").write_text("\n".join(lines))

        stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(str(source))
        jobs.learning_stream(stream.withColumnRenamed("value", "body"), known, FEATURES, out).awaitTermination()
    parts = jobs.learned(spark, out)
    assert sorted(r.batch for r in parts.select("batch").collect()) == [0, 1, 2]
    whole = learning.moments(frame(spark, sum(batches, [])), known, FEATURES)
    assert tuple(learning.added(parts).first()) == tuple(whole.first())
    decayed = learning.solve(learning.added(parts, 0.5), FEATURES)
    weights = [0.5 ** (2 - number) for number, rated in enumerate(batches) for _ in rated]
    assert np.allclose(list(decayed.values()), least_squares(sum(batches, []), weights), atol=1e-6)
    shown = learning.add_expected(known.filter("prediction_id = 8"), decayed).first()
    assert shown.expected == pytest.approx(2 + 0.5 - 3, abs=0.1)


def test_a_repeated_batch_counts_once(spark, known, tmp_path, monkeypatch):
    written = []
    monkeypatch.setattr(jobs, "_each_batch", lambda stream, folder, write, trigger=None: written.append(write))
    out = str(tmp_path / "out")
    jobs.learning_stream(None, known, FEATURES, out)
    rated = ratings(50, 6)
    body = spark.createDataFrame([(json.dumps({"prediction_id": p, "rating": y}),) for p, y in rated], "body string")
    for number in (0, 1, 1, 0):
        written[0](body, number)
    twice = learning.added(jobs.learned(spark, out)).first()
    once = learning.moments(frame(spark, rated), known, FEATURES).first()
    assert (twice.n, twice.yy) == (2 * once.n, 2 * once.yy)
