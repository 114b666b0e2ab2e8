"""Corpus jobs: search, page text, values with units, entities, types, copies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import failed
from ..functions.text import copy_key, ngrams, page_text, page_title, split_words, words
from ..session import cut, small_side

# Units of the measured quantities. A value becomes
# value * factor + offset in the unit of the quantity: unit, name, factor, offset.
UNITS = (
    ("°C", "temperature", 1.0, 0.0),
    ("K", "temperature", 1.0, -273.15),
    ("atm", "pressure", 1.0, 0.0),
    ("bar", "pressure", 0.986923, 0.0),
    ("g/L", "concentration", 1.0, 0.0),
    ("mg/mL", "concentration", 1.0, 0.0),
    ("mol/L", "molarity", 1.0, 0.0),
    ("%", "share", 1.0, 0.0),
)

# Plausible range of a quantity in °C and atm.
PLAUSIBLE = {"temperature": (-273.15, 3000.0), "pressure": (0.0, 10000.0)}

# Literature data types and words that point to them, first match wins.
TYPE_WORDS = {
    "solubility": ("solubility", "dissolve", "dissolved", "solvent"),
    "crystallization": ("crystallization", "crystal", "crystals", "nucleation"),
    "reaction": ("reaction", "reactant", "catalyst", "yield"),
    "material": ("material", "density", "hardness", "melting"),
}

_NUMBER = r"[0-9]+(?:[.][0-9]+)?"
# One number or a range: a dash after a digit is no sign.
_RANGE = rf"-?{_NUMBER}(?:[-–]{_NUMBER})*"
_UNIT = r"[\p{L}°%]+(?:/\p{L}+)?"


def search(documents: DataFrame, keywords: list[str], k: int) -> DataFrame:
    """The k documents with most keyword hits; ties go to more keywords, lower id.

    Words that are no keyword are dropped as they are split off, and hits are counted
    per document and keyword before they leave their task.
    """
    wanted = [key.lower() for key in keywords]
    hits = documents.select("doc_id", F.explode(split_words(F.col("text"))).alias("word")).filter(
        F.col("word").isin(*wanted)
    )
    counted = hits.groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    scored = counted.groupBy("doc_id").agg(
        F.sum("n").alias("hits"), F.count("*").alias("keywords")
    )
    return scored.orderBy(F.desc("hits"), F.desc("keywords"), "doc_id").limit(k)


def read_pages(pages: DataFrame) -> DataFrame:
    """Title and visible text of web pages (page_id, url, html)."""
    html = F.col("html")
    return pages.select(
        "page_id", "url", page_title(html).alias("title"), page_text(html).alias("text")
    )


def _unit_column(values: int, unit: Column) -> Column:
    column = F.lit(None)
    for row in UNITS:
        column = F.when(unit == row[0], F.lit(row[values])).otherwise(column)
    return column


def _numbers(match: Column) -> Column:
    """The numbers of one match as (number, unit); only the first can have a sign."""
    unit = F.regexp_extract(match, rf"({_UNIT})\z", 1)
    parts = F.regexp_extract_all(
        F.regexp_extract(match, rf"^({_RANGE})", 1), F.lit(rf"-?{_NUMBER}"), F.lit(0)
    )
    return F.transform(
        parts,
        lambda n, i: F.struct(
            F.when(i == 0, n).otherwise(F.ltrim(n, F.lit("-"))).alias("number"),
            unit.alias("unit"),
        ),
    )


def extract_values(documents: DataFrame, *keep: str) -> DataFrame:
    """Every number of a text with its unit, if one of the known units follows.

    All numbers of a range such as 20-80 °C have its unit. `position` counts the numbers
    of a document from 0. `quantity` and `standard` are NULL for numbers without unit.
    The columns `keep` of the documents stay.
    """
    pattern = rf"{_RANGE}(?:[ \t\r\n]*{_UNIT})?"
    matches = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    found = documents.select(
        "doc_id",
        *keep,
        F.posexplode(F.flatten(F.transform(matches, _numbers))).alias("position", "match"),
    )
    unit = F.col("match.unit")
    read = found.select(
        "doc_id",
        *keep,
        F.col("position").cast("long").alias("position"),
        F.col("match.number").try_cast("double").alias("value"),
        F.when(unit.isin(*[row[0] for row in UNITS]), unit).alias("unit"),
    )
    standard = F.col("value") * _unit_column(2, F.col("unit")) + _unit_column(3, F.col("unit"))
    return read.select(
        "*",
        _unit_column(1, F.col("unit")).alias("quantity"),
        F.round(standard, 6).alias("standard"),
    )


def check_values(values: DataFrame, number_limit: float = 1e9) -> DataFrame:
    """Extracted values with the codes of the checks they fail."""
    rules = {
        "unreadable": F.col("value").isNull(),
        "no_unit": F.col("unit").isNull(),
        "number_too_large": F.abs("value") > number_limit,
    }
    for quantity, (low, high) in PLAUSIBLE.items():
        rules[f"{quantity}_implausible"] = (F.col("quantity") == quantity) & ~F.col(
            "standard"
        ).between(low, high)
    return values.withColumn("errors", failed(rules))


def find_entities(documents: DataFrame, dictionary: DataFrame, longest: int = 2) -> DataFrame:
    """Dictionary entries named in each document, with the number of mentions.

    dictionary: entity (lower-case words joined by a blank), and what to know about
    it. Runs of up to `longest` words are looked up before anything is grouped, so
    only hits are counted; a dictionary too large to broadcast meets them by shuffle.
    """
    tokens = words(F.col("text"))
    runs = F.concat(*[ngrams(F.col("tokens"), n) for n in range(1, longest + 1)])
    mentions = documents.select("doc_id", tokens.alias("tokens")).select(
        "doc_id", F.explode(runs).alias("entity")
    )
    return (
        mentions.join(dictionary, "entity")
        .groupBy("doc_id", *dictionary.columns)
        .agg(F.count("*").alias("mentions"))
    )


def longest_mentions(documents: DataFrame, dictionary: DataFrame) -> DataFrame:
    """doc_id, position, n_words, entity of the leftmost longest mentions, none overlapping.

    A text is read from the left: where entries begin the longest is taken, and reading goes
    on behind it; `position` counts words from 0. dictionary: entity, lower-case words
    joined by one blank, of any length; other columns are not used.

    Only runs that begin with the first word of an entry, and have the length of an entry
    that begins so, are built and meet the dictionary. What is found is shuffled and sorted
    once, by document, position and length; of one position only the longest can be taken.
    Matches that do not touch are chosen by themselves: a window over a document's matches
    numbers clusters of overlapping ones, and only inside a cluster are they taken in order.
    """
    entries = cut(dictionary.select("entity").dropna().distinct())
    n_words = F.size(F.split("entity", " "))
    starts = small_side(
        entries.groupBy(F.substring_index("entity", " ", 1).alias("first")).agg(
            F.collect_set(n_words).alias("lengths")
        )
    )
    tokens = documents.select("doc_id", words(F.col("text")).alias("tokens"))
    runs = (
        tokens.select("doc_id", "tokens", F.posexplode("tokens").alias("position", "first"))
        .join(starts, "first")
        .select("doc_id", "position", "tokens", F.explode("lengths").alias("n_words"))
        .filter(F.col("position") + F.col("n_words") <= F.size("tokens"))
        .select("doc_id", "position", "n_words", F.array_join(F.slice("tokens", F.col("position") + 1, F.col("n_words")), " ").alias("entity"))
    )
    found = runs.join(entries, "entity", "left_semi")
    in_order = Window.partitionBy("doc_id").orderBy("position", F.desc("n_words"), F.desc("entity"))
    reached = F.max(F.col("position") + F.col("n_words")).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("position") >= F.col("reached"), F.lit(True)).cast("int")
    longest = F.coalesce(F.lag("position").over(in_order) < F.col("position"), F.lit(True))
    clusters = (
        found.withColumns({"reached": reached, "longest": longest}).withColumn("apart", apart)
        .withColumn("cluster", F.sum("apart").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .filter("longest")
        .groupBy("doc_id", "cluster")
        .agg(F.array_sort(F.collect_list(F.struct("position", "n_words", "entity"))).alias("found"))
    )
    kind = clusters.schema["found"].dataType.simpleString()

    def take(taken: Column, match: Column) -> Column:
        last = F.element_at(taken, -1)
        return F.when(match["position"] >= last["position"] + last["n_words"], F.concat(taken, F.array(match))).otherwise(taken)

    rest = F.slice("found", F.lit(2), F.size("found"))
    chosen = F.aggregate(rest, F.slice("found", F.lit(1), F.lit(1)).cast(kind), take)
    return clusters.select("doc_id", F.explode(chosen).alias("m")).select("doc_id", "m.*")


def find_longest(documents: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Dictionary entries named in each document by `longest_mentions`, with their number."""
    counted = longest_mentions(documents, dictionary).groupBy("doc_id", "entity").agg(F.count("*").alias("mentions"))
    return counted.join(dictionary, "entity").select("doc_id", *dictionary.columns, "mentions")


def copy_groups(documents: DataFrame) -> DataFrame:
    """Per text, up to letter case and blanks: its key, lowest doc_id and `copies`.

    Only hashes and ids are grouped, and they are reduced on the map side.
    """
    return (
        documents.select("doc_id", copy_key(F.col("text")).alias("key"))
        .groupBy("key")
        .agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    )


def drop_copies(documents: DataFrame) -> DataFrame:
    """The document of lowest id of every group of equal texts.

    Documents without text are copies of nothing and all stay, with no key and one copy.
    """
    texts = documents.filter(F.col("text").isNotNull())
    alone = documents.filter(F.col("text").isNull()).select(
        "*", F.lit(None).cast("string").alias("key"), F.lit(1).cast("long").alias("copies")
    )
    return texts.join(copy_groups(texts), "doc_id").unionByName(alone)


def classify(
    documents: DataFrame, type_words: dict[str, tuple[str, ...]] = TYPE_WORDS
) -> DataFrame:
    """doc_id with `data_type`: the first type one of whose words occurs, or other."""
    return _typed(documents, type_words).select("doc_id", "data_type")


def _typed(documents: DataFrame, type_words: dict[str, tuple[str, ...]]) -> DataFrame:
    tokens = F.col("tokens")
    kind = F.lit("other")
    for name, hints in reversed(type_words.items()):
        hit = F.arrays_overlap(tokens, F.array(*[F.lit(h) for h in hints]))
        kind = F.when(hit, F.lit(name)).otherwise(kind)
    return documents.select("doc_id", "text", words(F.col("text")).alias("tokens")).select(
        "doc_id", "text", kind.alias("data_type")
    )


def literature_rows(
    documents: DataFrame, type_words: dict[str, tuple[str, ...]] = TYPE_WORDS
) -> DataFrame:
    """Rows of the literature table: type of the document and its values with unit.

    A document is read once and nothing is shuffled.
    """
    values = extract_values(_typed(documents, type_words), "data_type")
    return values.filter(F.col("unit").isNotNull()).select(
        "doc_id", "data_type", F.col("quantity").alias("name"), "value", "unit"
    )


@dataclass(frozen=True)
class TrainedTypes:
    """weights: term and one column of whole millionths `w0`, `w1`, ... for each of `types`."""

    types: tuple[str, ...]
    priors: tuple[int, ...]
    weights: DataFrame


def type_terms(labelled: DataFrame, label: str = "data_type") -> DataFrame:
    """data_type, term, n: how often a word occurs in the documents of a type.

    Documents without type or text take no part. Words are counted before they move.
    """
    return (
        labelled.where(F.col(label).isNotNull())
        .select(F.col(label).alias("data_type"), F.explode(words(F.col("text"))).alias("term"))
        .groupBy("data_type", "term").agg(F.count("*").alias("n"))
    )


def train_types(labelled: DataFrame, label: str = "data_type") -> TrainedTypes:
    """Multinomial naive Bayes with one added to every count, over all labelled documents.

    Only the totals per type reach the driver: as many rows as there are types, each of
    which is a column of the model. Weights are logarithms in whole millionths, so that
    sums of them do not depend on the order of rows.
    """
    counts = cut(type_terms(labelled, label))
    words_of = dict(counts.groupBy("data_type").agg(F.sum("n")).collect())
    docs = dict(labelled.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*")).collect())
    types = tuple(sorted(docs))
    size = counts.select("term").distinct().count()

    def millionths(share: Column) -> Column:
        return F.round(F.log(share) * 1e6).cast("long")

    one = labelled.sparkSession.range(1)
    shares = [F.lit(docs[t] / sum(docs.values())) for t in types]
    priors = tuple(one.select(*[millionths(s).alias(f"p{i}") for i, s in enumerate(shares)]).first()) if types else ()
    weights = counts.groupBy("term").agg(
        F.count("*").alias("n_types"),
        *[
            millionths(
                (F.sum(F.when(F.col("data_type") == t, F.col("n")).otherwise(0)) + 1) / F.lit(float(words_of.get(t, 0) + size))
            ).alias(f"w{i}")
            for i, t in enumerate(types)
        ],
    )
    return TrainedTypes(types, priors, weights)


def classify_trained(documents: DataFrame, model: TrainedTypes) -> DataFrame:
    """doc_id, data_type of highest probability, and `score`, its logarithm (unnormalised).

    Words that no labelled document holds count for nothing; a document without known words
    gets the most frequent type. Of equal scores the type that sorts first counts. Rows
    that repeat a doc_id are one document. Without labelled documents the type is null.
    The weights are broadcast if few; otherwise the words meet them by shuffle, with the words
    on the side that is split if a word is frequent.
    """
    ids = documents.select("doc_id", F.explode_outer(words(F.col("text"))).alias("term"))
    if not model.types:
        none = ids.select("doc_id").distinct()
        return none.select("doc_id", F.lit(None).cast("string").alias("data_type"), F.lit(None).cast("double").alias("score"))
    columns = [f"w{i}" for i in range(len(model.types))]
    sums = (
        ids.join(small_side(model.weights.drop("n_types")), "term", "left")
        .groupBy("doc_id")
        .agg(*[(F.coalesce(F.sum(w), F.lit(0)) + F.lit(p)).alias(w) for w, p in zip(columns, model.priors)])
    )
    ranked = [
        F.struct(F.col(w).alias("score"), F.lit(-i).alias("order"), F.lit(t).alias("data_type"))
        for i, (w, t) in enumerate(zip(columns, model.types))
    ]
    best = F.array_max(F.array(*ranked))
    return sums.select("doc_id", best["data_type"].alias("data_type"), (best["score"] / 1e6).alias("score"))
