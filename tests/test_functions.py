import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylake.functions import names, ranges, requests, scoring, text


def one(spark, column, **values):
    kinds = {str: "string", float: "double", int: "bigint", bool: "boolean", type(None): "string"}
    schema = ", ".join(f"{n} {kinds[type(v)]}" for n, v in values.items()) or "x bigint"
    df = spark.createDataFrame([tuple(values.values()) or (0,)], schema)
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    "typed, low, high",
    [
        ("20-80", "20", "80"),
        ("20", "20", ""),
        ("", "", ""),
        ("-10-20", "", "10"),
        ("1-2-3", "1", "2"),
        ("-", "", ""),
        (" 5 - 6 ", " 5 ", " 6 "),
    ],
)
def test_range_text(spark, typed, low, high):
    c = F.col("t")
    pair = one(spark, F.struct(ranges.range_min(c), ranges.range_max(c)), t=typed)
    assert tuple(pair) == (low, high)


@pytest.mark.parametrize(
    "low, high, printed", [("", "", "-"), ("20", "80", "20-80"), ("20", "", "20-"), (None, None, "-")]
)
def test_range_printed(spark, low, high, printed):
    assert one(spark, ranges.range_text(F.col("a"), F.col("b")), a=low, b=high) == printed


@pytest.mark.parametrize(
    "typed, number",
    [("20", 20.0), (" 2.5 ", 2.5), ("1e3", 1000.0), ("", None), ("1d", None), ("NaN", None),
     ("20abc", None), ("-3", -3.0), (".5", 0.5)],
)
def test_bound(spark, typed, number):
    assert one(spark, ranges.bound(F.col("t")), t=typed) == number


@pytest.mark.parametrize(
    "value, low, high, inside",
    [(5.0, 5.0, 9.0, True), (9.0, 5.0, 9.0, True), (9.1, 5.0, 9.0, False), (4.9, 5.0, 9.0, False)],
)
def test_within(spark, value, low, high, inside):
    assert one(spark, ranges.within(F.col("v"), F.col("a"), F.col("b")), v=value, a=low, b=high) is inside
    assert one(spark, ranges.within(F.col("v"), F.lit(None), F.lit(None)), v=value) is True


@pytest.mark.parametrize(
    "a, b, equal",
    [("Alice", "alicé", True), ("Bob", "Bob ", False), ("BOB", "bob", True), ("", "", True),
     ("bob", "rob", False)],
)
def test_name_equality(spark, a, b, equal):
    assert one(spark, names.name_key("a") == names.name_key("b"), a=a, b=b) is equal


@pytest.mark.parametrize(
    "mail, valid",
    [("a@b.c", True), ("a@b", False), ("a b@c.d", False), ("@b.c", False), ("a@b.c\n", False),
     ("a@@b.c", False), (None, False)],
)
def test_email(spark, mail, valid):
    assert one(spark, names.email_valid("m"), m=mail) is valid


def test_form_rules(spark):
    rule = names.form_accepts("a", "b")
    assert one(spark, rule, a="secret", b="secret") is True
    assert one(spark, rule, a="short", b="short") is False
    assert one(spark, rule, a="secret", b="secreT") is False


@pytest.mark.parametrize("name, letter", [("bob", "B"), ("élan", "É"), ("", ""), ("X", "X")])
def test_initial(spark, name, letter):
    assert one(spark, names.initial("n"), n=name) == letter


def test_length_limits(spark):
    assert one(spark, names.fits("n", 64), n="x" * 64) is True
    assert one(spark, names.fits("n", 64), n="x" * 65) is False
    assert one(spark, names.fits("n", 64), n=None) is True


@pytest.mark.parametrize(
    "good, n, percent", [(8, 12, 67), (0, 5, 0), (5, 5, 100), (1, 8, 13), (0, 0, None), (1, 200, 1)]
)
def test_whole_percent(spark, good, n, percent):
    assert one(spark, scoring.whole_percent(F.col("g"), F.col("n")), g=good, n=n) == percent


def test_wilson(spark):
    low = lambda s, n: one(spark, scoring.wilson_low(F.col("s"), F.col("n")), s=s, n=n)
    assert low(0, 0) == 0.0
    # (0.8 + 0.19208 - 1.96 * sqrt(0.016 + 0.009604)) / 1.38416
    assert low(8, 10) == pytest.approx(0.490157, abs=1e-6)
    assert low(80, 100) > low(8, 10)
    assert low(0, 10) == pytest.approx(0.0, abs=1e-12)


def test_json(spark):
    schema = T.StructType([T.StructField("k", T.LongType())])
    row = requests.parse_json(F.col("t"), schema)
    assert one(spark, F.to_json(row), t='{"k": 69}') == '{"k":69}'
    assert one(spark, row.isNull(), t='{"k": ') is True
    assert one(spark, row.isNull(), t="no json") is True
    assert one(spark, row.isNull(), t=None) is True
    assert one(spark, row.isNull(), t="") is True
    assert one(spark, row.isNull(), t=" ") is True
    assert one(spark, row["k"], t='{"z": 1}') is None
    assert one(spark, row.isNull(), t='{"z": 1}') is False


def test_upload_list(spark):
    df = spark.createDataFrame(
        [(["a.csv"], [("a.csv",), ("b.csv",)])], "names array<string>, files array<struct<name:string>>"
    )
    listed = requests.append_names(F.col("names"), F.col("files"))
    assert df.select(listed).first()[0] == ["a.csv", "a.csv", "b.csv"]
    assert df.select(requests.drop_position(listed, F.lit(1))).first()[0] == ["a.csv", "b.csv"]
    assert df.select(requests.drop_position(listed, F.lit(9))).first()[0] == ["a.csv", "a.csv", "b.csv"]


@pytest.mark.parametrize(
    "name, taken", [("a.csv", True), ("a.XLSX", True), ("a.xls", True), ("a.txt", False), ("csv", False)]
)
def test_accepted_name(spark, name, taken):
    assert one(spark, requests.accepted_name(F.col("n")), n=name) is taken


def test_token(spark):
    ts = F.lit("2024-01-01 23:30:00").cast("timestamp")
    assert one(spark, requests.token_expiry(ts).cast("string")) == "2024-01-02 00:30:00"
    assert one(spark, requests.token_expiry(ts, 30).cast("string")) == "2024-01-02 00:00:00"
    assert one(spark, requests.token_subject(F.lit(7))) == "7"


def test_page_text(spark):
    html = (
        "<html><head><title>A &amp; B</title><style>p{}</style><script>var t='</p>';</script></head>"
        "<body><!-- note --><p>x &lt; y</p>\n<p>&amp;lt; stays</p></body></html>"
    )
    assert one(spark, text.page_title(F.col("h")), h=html) == "A & B"
    assert one(spark, text.page_text(F.col("h")), h=html) == "x < y &lt; stays"


def test_words_and_runs(spark):
    tokens = text.words(F.col("t"))
    assert one(spark, tokens, t="Heat, the Lösung: 25 °C!") == ["heat", "the", "lösung", "25", "c"]
    assert one(spark, text.ngrams(tokens, 2), t="a b c") == ["a b", "b c"]
    assert one(spark, text.ngrams(tokens, 2), t="a") == []
    assert one(spark, text.copy_key(F.col("a")) == text.copy_key(F.col("b")), a=" A\n b", b="a B") is True


def test_row_checks_are_compiled(spark):
    from assaylake.functions.checks import failed

    n = F.col("id")
    df = spark.range(4).select("id", failed({"odd": n % 2 == 1, "none": F.lit(None).cast("boolean"), "big": n > 2}).alias("errors"))
    assert [r.errors for r in df.orderBy("id").collect()] == [[], ["odd"], [], ["odd", "big"]]
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
