import math
import random
import re

from pyspark.sql import functions as F

from assaylake.operators import literature


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_values(spark, rows):
    texts = docs(
        spark,
        "heated to 25 °C at 1.5 atm, -5 °C",
        "298.15K then 2 bar; 7 Kelvin, page 12",
        "no numbers",
        None,
    )
    got = literature.extract_values(texts)
    assert rows(got) == [
        (0, 0, 25.0, "°C", "temperature", 25.0),
        (0, 1, 1.5, "atm", "pressure", 1.5),
        (0, 2, -5.0, "°C", "temperature", -5.0),
        (1, 0, 298.15, "K", "temperature", 25.0),
        (1, 1, 2.0, "bar", "pressure", 1.973846),
        (1, 2, 7.0, None, None, None),
        (1, 3, 12.0, None, None, None),
    ]
    checked = literature.check_values(
        docs(spark, "5000 °C 3 atm 9999999999 x").transform(literature.extract_values)
    )
    assert rows(checked, "position", "errors") == [
        (0, ["temperature_implausible"]), (1, []), (2, ["no_unit", "number_too_large"])
    ]


def test_ranges_and_solubility_units(spark, rows):
    texts = docs(spark, "20-80 °C", "5 g/L, 40 % or 3%", "-5–10 K on 2020-01-02", "2 mg/mL; 1.5 mol/L")
    assert rows(literature.extract_values(texts), "doc_id", "position", "value", "unit") == [
        (0, 0, 20.0, "°C"), (0, 1, 80.0, "°C"),
        (1, 0, 5.0, "g/L"), (1, 1, 40.0, "%"), (1, 2, 3.0, "%"),
        (2, 0, -5.0, "K"), (2, 1, 10.0, "K"), (2, 2, 2020.0, None), (2, 3, 1.0, None), (2, 4, 2.0, None),
        (3, 0, 2.0, "mg/mL"), (3, 1, 1.5, "mol/L"),
    ]
    page = spark.createDataFrame([(1, "u", "<p>25 &deg;C, 30&#176;C")], "page_id long, url string, html string")
    assert literature.read_pages(page).first()["text"] == "25 °C, 30°C"


def test_search(spark, rows):
    texts = docs(spark, "heat heat", "Heat, crystal", "nothing", "crystal; heat", None)
    found = literature.search(texts, ["Heat", "crystal"], 2).collect()
    assert [tuple(r) for r in found] == [(1, 2, 2), (3, 2, 2)]


def test_entities(spark, rows):
    names = spark.createDataFrame(
        [("acetic acid", "acid"), ("water", "solvent"), ("acid", "class")], "entity string, kind string"
    )
    texts = docs(spark, "Acetic acid and water, water", "acetic; acid", "wateracid", "")
    assert rows(literature.find_entities(texts, names)) == [
        (0, "acetic acid", "acid", 1), (0, "acid", "class", 1), (0, "water", "solvent", 2),
        (1, "acetic acid", "acid", 1), (1, "acid", "class", 1),
    ]


def test_entities_like_loops(spark, data):
    texts = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    local = [(r["doc_id"], re.findall(r"[^\W_]+", r["text"].lower())) for r in texts.collect()]
    wanted = sorted({w for _, tokens in local[:20] for w in tokens[:30]} | {
        f"{a} {b}" for _, tokens in local[:20] for a, b in zip(tokens[:30], tokens[1:31])
    })
    expected = {}
    for doc, tokens in local:
        for run in tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]:
            if run in set(wanted[:200]):
                expected[doc, run] = expected.get((doc, run), 0) + 1
    names = spark.createDataFrame([(w,) for w in wanted[:200]], "entity string")
    got = literature.find_entities(texts, names).collect()
    assert {(r["doc_id"], r["entity"]): r["mentions"] for r in got} == expected


def test_copies(spark, rows):
    texts = docs(spark, "A b", "a  B", "c", "C ", "c\n", "d")
    kept = literature.drop_copies(texts)
    assert rows(kept, "doc_id", "text", "copies") == [(0, "A b", 2), (2, "c", 3), (5, "d", 1)]


def test_hot_copy(spark):
    texts = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") < 1000, "same text").otherwise(F.col("id").cast("string")).alias("text"),
    )
    kept = literature.drop_copies(texts)
    assert kept.count() == 2001
    assert kept.filter("copies = 1000").select("doc_id").first()[0] == 0


def test_types(spark, rows):
    texts = docs(spark, "Solubility of salt", "the yield", "crystals in a solvent", "poem", None)
    assert rows(literature.classify(texts)) == [
        (0, "solubility"), (1, "reaction"), (2, "solubility"), (3, "other"), (4, "other")
    ]
    mined = literature.literature_rows(docs(spark, "solubility at 25 °C, page 3", "5 atm"))
    assert rows(mined) == [
        (0, "solubility", "temperature", 25.0, "°C"), (1, "other", "pressure", 5.0, "atm")
    ]


def test_documents_without_text_are_no_copies(spark):
    docs = spark.createDataFrame([(1, None), (2, None), (3, "a b"), (4, "A  b")], "doc_id long, text string")
    found = sorted((r.doc_id, r.copies) for r in literature.drop_copies(docs).collect())
    assert found == [(1, 1), (2, 1), (3, 2)]


def test_the_longest_entity_wins(spark, rows):
    names = spark.createDataFrame(
        [(e, i) for i, e in enumerate(["sodium", "sodium dodecyl", "dodecyl sulfate", "sodium dodecyl sulfate in cold water",
                                       "cold", "water bath", "a b", "b c", "c d", "d"])] + [(None, 99)],
        "entity string, number int",
    )
    texts = docs(
        spark, "Sodium dodecyl sulfate in cold water bath", "sodium dodecyl; sulfate", "a b c d a b", "none", "", None,
        "sodium sodium dodecyl sulfate in cold",
    )
    assert rows(literature.find_longest(texts, names), "doc_id", "entity", "mentions") == [
        (0, "sodium dodecyl sulfate in cold water", 1), (1, "sodium dodecyl", 1), (2, "a b", 2), (2, "c d", 1),
        (6, "cold", 1), (6, "sodium dodecyl", 1), (6, "sodium", 1),
    ]
    assert rows(literature.longest_mentions(texts, names).filter("doc_id = 2"), "position", "entity") == [
        (0, "a b"), (2, "c d"), (4, "a b")
    ]
    assert literature.find_longest(texts, names.limit(0)).count() == 0


def test_longest_entities_like_a_loop(spark, data):
    texts = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    local = [(r["doc_id"], re.findall(r"[^\W_]+", r["text"].lower())) for r in texts.collect()]
    wanted = {" ".join(tokens[i : i + 1 + i % 5]) for _, tokens in local[:30] for i in range(0, min(40, len(tokens)), 3)}
    expected = {}
    for doc, tokens in local:
        at = 0
        while at < len(tokens):
            n = next((n for n in (5, 4, 3, 2, 1) if at + n <= len(tokens) and " ".join(tokens[at : at + n]) in wanted), 0)
            if n:
                key = doc, " ".join(tokens[at : at + n])
                expected[key] = expected.get(key, 0) + 1
            at += n or 1
    names = spark.createDataFrame([(w,) for w in sorted(wanted)], "entity string")
    got = literature.find_longest(texts, names).collect()
    assert {(r["doc_id"], r["entity"]): r["mentions"] for r in got} == expected


def test_trained_types_equal_hand_count(spark):
    labelled = spark.createDataFrame(
        [(1, "melt melt cool", "m"), (2, "cool", "c"), (3, None, "c"), (4, "melt", None)], "doc_id long, text string, data_type string"
    )
    model = literature.train_types(labelled)
    assert model.types == ("c", "m") and model.priors == (round(1e6 * math.log(2 / 3)), round(1e6 * math.log(1 / 3)))
    weights = {r.term: (r.w0, r.w1) for r in model.weights.collect()}
    expected = {"melt": (1 / 3, 3 / 5), "cool": (2 / 3, 2 / 5)}
    assert weights == {t: tuple(round(1e6 * math.log(x)) for x in w) for t, w in expected.items()}
    asked = spark.createDataFrame(
        [(1, "MELT, melt!"), (2, "cool"), (3, None), (4, ""), (5, "unknown words"), (None, "melt melt melt")], "doc_id long, text string"
    )
    found = {r.doc_id: r.data_type for r in literature.classify_trained(asked, model).collect()}
    assert found == {1: "m", 2: "c", 3: "c", 4: "c", 5: "c", None: "m"}
    nothing = literature.train_types(labelled.limit(0))
    assert {r.data_type for r in literature.classify_trained(asked, nothing).collect()} == {None}


def test_trained_types_beat_the_word_list(spark):
    """Held-out documents of a type rarely name it, but use its words."""
    rng = random.Random(3)
    own = {"solubility": "dissolve saturated solvent clear", "crystallization": "seed nucleus crystal grow", "reaction": "yield catalyst reagent product"}
    common = "the sample was kept at room temperature and then measured twice".split()
    rows = []
    for i in range(300):
        kind = rng.choice(sorted(own))
        rows.append((i, " ".join(rng.choices(common, k=12) + rng.choices(own[kind].split(), k=3)), kind))
    docs = spark.createDataFrame(rows, "doc_id long, text string, data_type string")
    held = docs.where("doc_id % 3 = 0")
    model = literature.train_types(docs.where("doc_id % 3 <> 0"))

    def accuracy(found):
        both = held.select("doc_id", F.col("data_type").alias("truth")).join(found, "doc_id")
        return both.where("truth = data_type").count() / both.count()

    trained = accuracy(literature.classify_trained(held, model))
    assert trained >= 0.95 and trained > accuracy(literature.classify(held))


def test_longest_matches_are_sorted_once(spark):
    """One shuffle and one sort by document; strings are not aggregated by a sort of their own."""
    texts = spark.createDataFrame([(1, "a b c d"), (1, "a b x"), (2, "b c a b")], "doc_id long, text string")
    names = spark.createDataFrame([("a",), ("a b",), ("b c d",), ("c",)], "entity string")
    found = literature.longest_mentions(texts, names)
    got = sorted((r.doc_id, r.position, r.n_words, r.entity) for r in found.collect())
    # Rows that repeat a doc_id are one document.
    assert got == [(1, 0, 2, "a b"), (1, 2, 1, "c"), (2, 1, 1, "c"), (2, 2, 2, "a b")]
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "SortAggregate" not in plan and plan.count("Sort [") == 1
