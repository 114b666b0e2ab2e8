import random

from assaylake.operators.numbering import number_rows


def test_sparse_and_negative_order(spark):
    random.seed(3)
    values = sorted({random.getrandbits(63) - 2**62 for _ in range(300)})
    values += [0, -1, 1, 2**20, 2**20 - 1, 2**40, 2**60, 2**63 - 1, -(2**63)]
    values += list(range(5 * 2**20 - 40, 5 * 2**20 + 40))
    df = spark.createDataFrame([(v, str(v)) for v in values], "seq long, tag string")
    place = {v: 1001 + i for i, v in enumerate(sorted(values))}
    # Small buckets make the counts themselves too many for one running sum.
    for bits in (20, 5):
        got = number_rows(df, "seq", "id", 1000, bits).collect()
        assert len(got) == len(values)
        assert {r["seq"]: r["id"] for r in got} == place
        assert all(r["tag"] == str(r["seq"]) for r in got)
