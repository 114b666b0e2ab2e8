"""Personal data: candidate generators, boosted trees, calibrated thresholds; all in SQL.

The base spans of four kinds come from exact patterns with checks. Beside them, generators
with a wide net propose spans, boosted trees score each one by its format and what stands
around it, and those above their kind's threshold are added. The trees run as column
expressions over arrays, so a text is handled in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

KINDS = ["email", "ip", "card", "phone"]

# Base patterns, written so that the engine neither recurses nor starts twice in one run of
# characters; they match what the plain forms match.
LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NAME = r"[\p{L}\p{N}._%+-]"
LABEL = r"[\p{L}\p{N}-]"
WIDE = {
    "email": rf"(?i)(?<!{NAME}){NAME}++(?:@|\s?[\[(]at[\])]\s?){LABEL}++"
    rf"(?:(?:\.|\s?[\[(]dot[\])]\s?){LABEL}++)*+",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|(?:[0-9]{4}[\x20-]){3}[0-9]{1,7})(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|(?<![0-9])[0-9]{2,4})[\x20.-]?"
    r"[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])",
}
CONTEXT = 24
CLUES = r"(?i)(mail|phone|tel|call|mobile|fax|card|visa|credit|ip|addr|host|server|contact)"
ANTI = r"(?i)(version|token|hash|sha|commit|isbn|key|build|id)\W*$"

SPAN = "array<struct<start:int,end:int,value:string,left:string,right:string>>"
STRETCH = 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _fold(items: Column, begin: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What `step(state, item) -> (state, array of results)` gives for all items in turn.

    A growing array is copied with each element, so results are gathered in stretches of
    256 or the root of the number of items, and the stretches are joined at the end: n items
    cost about n to the power 1.5 instead of 2.
    """
    none = F.array().cast(kind)

    def one(state: Column, item: Column) -> Column:
        at, out = step(state["at"], item)
        return F.struct(at.alias("at"), F.concat(state["out"], out).alias("out"))

    def many(state: Column, stretch: Column) -> Column:
        done = F.aggregate(stretch, F.struct(state["at"].alias("at"), none.alias("out")), one)
        return _let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(state["out"], F.array(d["out"])).alias("out")))

    def folded(every: Column) -> Column:
        size = F.greatest(F.lit(STRETCH), F.ceil(F.sqrt(F.size(every))).cast("int"))
        return _let(size, lambda n: F.flatten(F.aggregate(
            F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / n).cast("int")), lambda k: F.slice(every, k * n + 1, n)),
            F.struct(begin.alias("at"), F.array().cast(f"array<{kind}>").alias("out")), many, lambda state: state["out"],
        )))

    return _let(items, lambda every: F.when(F.size(every) > 0, folded(every)).otherwise(none))


def _located(text: str, matches: str, pattern: str) -> Column:
    """Matches with their places in code points and the characters around them, from the
    pieces of text between them; the text itself is not looked at once more for each."""

    def steps(pieces: Column) -> Column:
        return F.transform(matches, lambda m, i: F.struct(
            F.get(pieces, i).alias("gap"), m.alias("value"),
            F.left(F.concat(F.get(pieces, i + 1), F.coalesce(F.get(F.col(matches), i + 1), F.lit(""))), F.lit(2)).alias("right"),
        ))

    def add(at: Column, s: Column) -> tuple[Column, Column]:
        start = at["end"] + F.length(s["gap"])
        end = start + F.length(s["value"])
        left = F.right(F.concat(at["tail"], F.right(s["gap"], F.lit(CONTEXT))), F.lit(CONTEXT))
        tail = F.right(F.concat(left, s["value"]), F.lit(CONTEXT))
        span = F.struct(start.alias("start"), end.alias("end"), s["value"].alias("value"), left.alias("left"), s["right"].alias("right"))
        return F.struct(end.alias("end"), tail.alias("tail")), F.array(span)

    begin = F.struct(F.lit(0).alias("end"), F.lit("").alias("tail"))
    located = _fold(_let(F.split(text, pattern, -1), steps), begin, SPAN, add)
    return F.when(F.size(matches) > 0, located).otherwise(F.array().cast(SPAN))


def _find(df: DataFrame, text: str, name: str, pattern: str, needed: Column) -> DataFrame:
    """Add the array `name` of spans of `pattern`, looked for where `needed` holds."""
    matches = F.when(needed, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    df = df.withColumn("_m", F.coalesce(matches, F.array().cast("array<string>")))
    return df.withColumn(name, _located(text, "_m", pattern)).drop("_m")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    backwards = F.reverse(number)

    def add(total: Column, place: Column) -> Column:
        digit = F.substring(backwards, place, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(place % 2 == 0, doubled).otherwise(digit)

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))), F.lit(0), add)
    return (F.length(number) > 0) & (total % 10 == 0)


def octets_fit(value: Column) -> Column:
    def fits(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
        return (F.length(bare) <= 3) & (F.substring(bare, 1, 3).cast("int") <= 255)

    return F.forall(F.split(value, r"\."), fits)


def _size_between(value: Column, low: int, high: int) -> Column:
    return F.length(digits(value)).between(low, high)


CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": octets_fit,
    "card": lambda v: F.when(_size_between(v, 13, 19), luhn(digits(v))).otherwise(F.lit(False)),
    "phone": lambda v: _size_between(v, 9, 15),
}


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `_text` (null as empty) and `_base`: checked spans, by kind, then start."""
    df = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_digits", F.col("_text").rlike("[0-9]"))
    needed = {
        "email": F.col("_text").contains("@"),
        "ip": F.col("_digits") & F.col("_text").rlike(r"[0-9]\.[0-9]"),
        "card": F.col("_digits"),
        "phone": F.col("_digits") & F.col("_text").contains("+"),
    }
    parts = []
    for number, kind in enumerate(KINDS):
        df = _find(df, "_text", f"_{kind}", BASE[kind], needed[kind])

        def valid(s: Column) -> Column:
            return CHECKS[kind](s["value"])

        def placed(s: Column) -> Column:
            return F.struct(F.lit(number).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))

        parts.append(F.transform(F.filter(f"_{kind}", valid), placed))
    return df.withColumn("_base", F.concat(*parts)).drop(*(f"_{k}" for k in KINDS))


def with_candidates(df: DataFrame) -> DataFrame:
    """`_wide`: what the generators propose, with the characters around each span."""
    at_sign = F.col("_text").contains("@") | F.col("_text").rlike(r"(?i)[\[(]at[\])]")
    parts = []
    for number, kind in enumerate(KINDS):
        df = _find(df, "_text", f"_{kind}", WIDE[kind], at_sign if kind == "email" else F.col("_digits"))

        def described(s: Column) -> Column:
            return F.struct(
                F.lit(number).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
                s["left"].alias("left"), s["right"].alias("right"),
            )

        parts.append(F.transform(f"_{kind}", described))
    return df.withColumn("_wide", F.concat(*parts)).drop(*(f"_{k}" for k in KINDS))


def features(c: Column) -> dict[str, Column]:
    """Format and context of a candidate with kind, value, left and right, as numbers.

    An international prefix and spelt-out signs are taken off first, so that a form learnt
    from base spans is known again in its other spellings.
    """
    plain = F.regexp_replace(c["value"], r"^\+[0-9]{1,3}[\x20.-]?", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?i)\s?[\[(]at[\])]\s?", "@"), r"(?i)\s?[\[(]dot[\])]\s?", ".")
    number = digits(plain)
    groups = F.split(F.regexp_replace(plain, "^[^0-9]+|[^0-9]+$", ""), "[^0-9]+")
    last = F.element_at(F.split(plain, r"\."), -1)
    before, after = F.right(c["left"], F.lit(1)), F.left(c["right"], F.lit(1))
    flag = {
        "alnum_before": before.rlike(r"[\p{L}\p{N}]"), "joined_before": c["left"].rlike(r"[0-9][.\-/]$"),
        "alnum_after": after.rlike(r"[\p{L}\p{N}]"), "joined_after": c["right"].rlike(r"^[.\-/][0-9]"),
        "luhn": (F.length(number) > 11) & luhn(number), "octets": (c["kind"] == 1) & octets_fit(plain),
        "paren": plain.contains("("), "dot": plain.contains("."), "dash": plain.contains("-"),
        "at": plain.contains("@"), "clue": c["left"].rlike(CLUES), "anti": c["left"].rlike(ANTI),
        "domain": plain.rlike(r"@[^@]*\.\p{L}{2,}$"),
    }
    size = {
        "kind": c["kind"], "length": F.length(plain), "digits": F.length(number), "groups": F.size(groups),
        "first_group": F.length(groups[0]), "last_group": F.length(F.element_at(groups, -1)),
        "last_label": F.length(last),
    }
    return {n: v.cast("double") for n, v in {**size, **flag}.items()}


@dataclass
class Scorer:
    """Trees as nested tuples (feature, threshold, left, right) or leaf values."""

    trees: list = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)
    names: list[str] = field(default_factory=list)

    def margin(self, values: Column) -> Column:
        def walk(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            name, threshold, left, right = node
            return F.when(values[name] <= threshold, walk(left)).otherwise(walk(right))

        total = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights):
            total = total + walk(tree) * weight
        return total


def _trees(model: GBTClassificationModel, names: list[str]) -> list:
    def walk(node):
        if node.subtreeDepth() == 0:
            return node.prediction()
        split = node.split()
        return (names[split.featureIndex()], split.threshold(), walk(node.leftChild()), walk(node.rightChild()))

    return [walk(tree._java_obj.rootNode()) for tree in model.trees]


def views(c: Column) -> Column:
    """A labelled candidate and spoilt copies of it as examples of what is none."""
    def view(value: Column, left: Column, label: int) -> Column:
        return F.struct(
            c["kind"].alias("kind"), value.alias("value"), left.alias("left"), c["right"].alias("right"),
            F.lit(label).alias("label"),
        )

    value, last = c["value"], F.right(c["value"], F.lit(1))
    changed = F.concat(F.left(value, F.length(value) - 1), ((last.cast("int") + 1) % 10).cast("string"))
    spoilt = (
        F.when(c["kind"] == 0, F.regexp_replace(value, r"\.[^.]*$", ""))
        .when(c["kind"] == 1, F.concat(F.lit("9999"), value))
        .when(c["kind"] == 2, changed)
        .otherwise(F.regexp_replace(value, r"[0-9]{3}$", ""))
    )
    return F.array(view(value, c["left"], 1), view(spoilt, c["left"], 0), view(value, F.concat(c["left"], F.lit("x7-")), 0))


def learn(docs: DataFrame, sample: int = 4000, trees: int = 12, depth: int = 3, precision: float = 0.95) -> Scorer:
    """Fit the trees on a sample of each kind; thresholds come from the whole table.

    About `sample` / kinds candidates of each kind are taken by hash share, all of a rarer
    kind. One that is a checked span of its kind, apart from other characters, is an example,
    and so is each one that fails its kind's check; copies that were spoilt in their digits,
    ending or surroundings are examples of what is no span. Of all candidates of the table a
    fourth is held out and calibrates: a kind's threshold is the least score with the asked
    precision, and no less than the lowest twentieth of its true spans' scores, over bins of
    1/4096. Without examples nothing is added to the base.
    """
    found = with_candidates(with_base(docs.select("doc_id", "text")))
    found = found.where(F.size("_wide") > 0).select("doc_id", "_base", F.explode("_wide").alias("c"))
    base = F.exists("_base", lambda b: (b["kind"] == F.col("c.kind")) & (b["start"] == F.col("c.start")) & (b["end"] == F.col("c.end")))
    key = F.xxhash64(F.col("doc_id").cast("string"), "c.kind", "c.start")
    every = store(found.select("c", base.alias("is_base"), key.alias("key")))
    fold = F.pmod(F.xxhash64("key"), F.lit(4)) == 0
    # Training uses three of four candidates of a kind.
    share = F.lit(0)
    for row in every.where(~fold).groupBy("c.kind").count().collect():
        part = min(1.0, 0.75 * sample / len(KINDS) / row["count"])
        share = F.when(F.col("c.kind") == row["kind"], F.lit(int(part * (1 << 30)))).otherwise(share)
    picked = every.where(~fold & (F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 30)) < share))
    checked = F.lit(False)
    for number, kind in enumerate(KINDS):
        checked = F.when(F.col("c.kind") == number, CHECKS[kind](F.col("c.value"))).otherwise(checked)
    negative = F.array(F.struct(
        F.col("c.kind").alias("kind"), F.col("c.value").alias("value"), F.col("c.left").alias("left"),
        F.col("c.right").alias("right"), F.lit(0).alias("label"),
    ))
    def examples(rows: DataFrame) -> DataFrame:
        shown = rows.withColumn(
            "v", F.explode(F.when(F.col("is_base"), views(F.col("c"))).when(~checked, negative))
        )
        return shown.select(
            F.col("v.label").cast("double").alias("label"), "key",
            F.struct(*(v.alias(n) for n, v in features(F.col("v")).items())).alias("f"),
        )

    rows = store(examples(picked).repartition(1).sortWithinPartitions("key", "label", "f"))
    names = rows.schema["f"].dataType.names
    flat = rows.select("label", "f", *(F.col(f"f.{n}").alias(n) for n in names))
    if flat.agg(F.count_distinct("label")).first()[0] < 2:
        return Scorer()
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(flat)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=64, seed=5).fit(vectors.select("label", "features"))
    scorer = Scorer(_trees(model, names), list(model.treeWeights), {}, names)
    scored = examples(every.where(fold)).select(
        "label", F.col("f.kind").cast("int").alias("kind"), scorer.margin(F.col("f")).alias("margin")
    )
    bins = (
        scored.groupBy("kind", F.floor(F.col("margin") * 4096).alias("bin"))
        .agg(F.min("margin").alias("margin"), F.count("*").alias("n"), F.sum("label").alias("true"))
    )
    by_kind: dict[int, list] = {}
    for row in bins.orderBy("kind", "bin").collect():
        by_kind.setdefault(row.kind, []).append(row)
    for kind, of in by_kind.items():
        total, true = sum(r.n for r in of), sum(r.true for r in of)
        lowest, below = true // 20, 0.0
        for row in of:
            below += row.true
            # Not below the lowest twentieth, and precise from here up.
            if below > lowest and true - (below - row.true) >= precision * total:
                scorer.thresholds[kind] = row.margin
                break
            total -= row.n
    return scorer


ITEM = "struct<start:int,base:boolean,end:int,kind:int>"


def _sweep(items: Column) -> Column:
    """Of items sorted by start all base ones, and others that nothing taken before overlaps."""

    def step(end: Column, item: Column) -> tuple[Column, Column]:
        keep = item["base"] | (item["start"] >= end)
        none = F.array().cast(f"array<{ITEM}>")
        return F.when(keep, F.greatest(end, item["end"])).otherwise(end), F.when(keep, F.array(item)).otherwise(none)

    return _fold(items, F.lit(-2147483648).cast("int"), f"array<{ITEM}>", step)


def find(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """All columns of `docs`, `base` and `spans`: arrays of struct(kind, start, end).

    Places are code points, the end exclusive; both are sorted by kind as listed, then by
    start. `spans` has the base and what the trees add; an added span overlaps no other.
    A null text counts as empty and has no spans. Columns of those names are replaced.
    """
    keep = [c for c in docs.columns if c.lower() not in ("base", "spans")]
    df = with_base(docs.select(*keep))
    if not scorer.thresholds:
        return df.select(*keep, F.col("_base").alias("base"), F.col("_base").alias("spans"))
    df = with_candidates(df)

    def enough(item: Column) -> Column:
        passed = F.lit(False)
        for kind, threshold in scorer.thresholds.items():
            passed = passed | ((item["kind"] == kind) & (item["margin"] >= threshold))
        return passed

    def scored(c: Column) -> Column:
        values = F.struct(*(v.alias(n) for n, v in features(c).items()))
        return F.struct(
            c["start"].alias("start"), F.lit(False).alias("base"), c["end"].alias("end"), c["kind"].alias("kind"), values.alias("f")
        )

    def judged(c: Column) -> Column:
        return F.struct(
            c["start"].alias("start"), c["base"].alias("base"), c["end"].alias("end"), c["kind"].alias("kind"),
            scorer.margin(c["f"]).alias("margin"),
        )

    def bare(c: Column) -> Column:
        return F.struct(c["start"].alias("start"), c["base"].alias("base"), c["end"].alias("end"), c["kind"].alias("kind"))

    added = F.transform(F.filter(F.transform(F.transform("_wide", scored), judged), enough), bare)
    sure = F.transform("_base", lambda b: F.struct(b["start"].alias("start"), F.lit(True).alias("base"), b["end"].alias("end"), b["kind"].alias("kind")))
    df = df.withColumn("_added", F.when(F.size("_wide") > 0, added))
    forward = _sweep(F.array_sort(F.concat(sure, F.col("_added"))))

    # The same from the end, so that no added span runs into a base span behind it.
    def mirrored(c: Column) -> Column:
        return F.struct((-c["end"]).alias("start"), c["base"].alias("base"), (-c["start"]).alias("end"), c["kind"].alias("kind"))

    backward = F.transform(_sweep(F.array_sort(F.transform(forward, mirrored))), mirrored)
    picked = F.array_sort(
        F.transform(backward, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    )
    new = F.exists("_added", lambda c: F.lit(True))
    return df.select(
        *keep, F.col("_base").alias("base"), F.when(new, picked).otherwise(F.col("_base")).alias("spans")
    )


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def report(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, base counts by kind, base_sha256 and spans of every row, repeated rows too."""
    found = find(docs.select("doc_id", "text"), scorer)

    def count(number: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("bigint")

    counts = [count(number).alias(f"n_{kind}") for number, kind in enumerate(KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("bigint").alias("n_added"),
    )


def redact(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """`docs` with each span of the text replaced by its kind in brackets."""
    found = find(docs, scorer)
    names = F.array(*(F.lit(k) for k in KINDS))
    items = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        gap = F.substring(F.col("text"), at + 1, F.greatest(s["start"] - at, F.lit(0)))
        mark = F.concat(gap, F.lit("["), names[s["kind"]], F.lit("]"))
        end = F.greatest(at, s["end"])
        return end, F.when(s["start"] >= at, F.array(mark)).otherwise(F.array().cast("array<string>"))

    marked = _fold(items, F.lit(0), "array<string>", step)
    end = F.array_max(F.transform(items, lambda s: s["end"]))
    done = F.concat(F.array_join(marked, ""), F.substring(F.col("text"), end + 1, F.length("text")))
    return found.withColumn("text", F.when(F.size("spans") > 0, done).otherwise(F.col("text"))).select(*docs.columns)
