"""Constraint queries against observed parameter settings, and ranked answers.

An observation is one experiment with its parameters as columns: experiment_type,
temperature, pressure, outcome, success. Queries never meet single experiments:
equal settings are summed up first, which loses nothing and bounds the join by the
number of distinct settings.

`match` lists the settings inside a query's bounds. Answers in bins do not need the list:
bins that lie inside the bounds as a whole come from `Cells`, a hierarchy of rectangles of
1, 2, 4, ... bins a side that is summed up once. A query takes the few rectangles that make
up its inner part, and single settings only in the bins that its bounds cut.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import bound, range_max, range_min, within
from ..functions.scoring import mean, spread, wilson_low
from ..session import cut, discard, small_side

PARAMS = ("temperature", "pressure")


def parse_queries(forms: DataFrame) -> DataFrame:
    """Forms (query_id, experiment_type, <param>_range text) -> numeric bounds.

    A form without experiment type cannot be sent and is left out.
    """
    bounds = []
    for p in PARAMS:
        text = F.col(f"{p}_range")
        bounds.append(bound(range_min(text)).alias(f"{p}_min"))
        bounds.append(bound(range_max(text)).alias(f"{p}_max"))
    sent = forms.filter(F.coalesce(F.col("experiment_type"), F.lit("")) != "")
    return sent.select("query_id", "experiment_type", *bounds)


def constraint_rows(queries: DataFrame) -> DataFrame:
    """Queries in long form: (query_id, experiment_type, param, min, max)."""
    triples = F.array(
        *[
            F.struct(
                F.lit(p).alias("param"),
                F.col(f"{p}_min").alias("min"),
                F.col(f"{p}_max").alias("max"),
            )
            for p in PARAMS
        ]
    )
    return queries.select("query_id", "experiment_type", F.inline(triples))


def settings(observations: DataFrame) -> DataFrame:
    """Counts and sums of the outcome for every distinct parameter setting."""
    y = F.col("outcome")
    return observations.groupBy("experiment_type", *PARAMS).agg(
        F.count("*").alias("n"),
        F.count_if("success").alias("successes"),
        F.sum(y).alias("total"),
        F.sum(y * y).alias("squares"),
    )


def match(queries: DataFrame, summed: DataFrame, width: float = 5.0) -> DataFrame:
    """Settings inside the bounds of each query, both ends included.

    A range join: settings fall in temperature buckets of `width`, a query is copied
    to those occupied buckets of its type that its range touches, and both meet by
    equality on type and bucket. Far outliers so add one bucket each. Exact bounds are
    tested on the rows that met. Settings without temperature have a bucket of their
    own, which only queries without temperature bounds reach. The settings are stored
    once: their buckets and the join read them together.
    """
    summed = cut(summed)
    bucket = F.floor(F.col("temperature").cast("double") / width)
    occupied = summed.select(F.col("experiment_type"), bucket.alias("_bucket")).distinct()
    low, high = F.col("temperature_min"), F.col("temperature_max")
    placed = queries.join(small_side(occupied), "experiment_type").filter(
        F.when(F.col("_bucket").isNull(), low.isNull() & high.isNull()).otherwise(
            (low.isNull() | (F.col("_bucket") >= F.floor(low / width)))
            & (high.isNull() | (F.col("_bucket") <= F.floor(high / width)))
        )
    )
    bucketed = summed.select("*", bucket.alias("_own"), F.col("experiment_type").alias("_type"))
    bucketed = bucketed.drop("experiment_type")
    inside = [
        within(F.col(p).cast("double"), F.col(f"{p}_min"), F.col(f"{p}_max")) for p in PARAMS
    ]
    same = (F.col("experiment_type") == F.col("_type")) & F.col("_bucket").eqNullSafe(F.col("_own"))
    met = placed.join(bucketed, same).filter(inside[0] & inside[1])
    return met.select("query_id", *summed.columns)


def score_bins(matches: DataFrame, widths: dict[str, float]) -> DataFrame:
    """Matched settings of a query, combined to bins and scored.

    score: mean outcome of the bin; confidence: lower end of the 95 % interval of its
    success share.
    """
    bins = [
        F.floor(F.col(p).cast("double") / widths[p]).cast("long").alias(f"{p}_bin") for p in PARAMS
    ]
    binned = matches.groupBy("query_id", "experiment_type", *bins).agg(
        *[F.sum(c).alias(c) for c in ("n", "successes", "total", "squares")]
    )
    n = F.col("n")
    return binned.select(
        "query_id",
        "experiment_type",
        "temperature_bin",
        "pressure_bin",
        "n",
        "successes",
        F.round(mean(F.col("total"), n), 4).alias("score"),
        F.round(spread(F.col("total"), F.col("squares"), n), 4).alias("score_spread"),
        F.round(wilson_low(F.col("successes"), n), 6).alias("confidence"),
    )


_SUMS = ("n", "successes", "total", "squares")
# The level of settings without a value; only queries without bounds take them.
_NO_VALUE = -1


@dataclass(frozen=True)
class Cells:
    """Stored sums of settings for queries in bins.

    settings: distinct settings with their bins. bins: sums of each occupied bin.
    sums, ranked: of each rectangle of bins its sums and its k best bins. A rectangle is
    (<param>_level, <param>_at): 2 ** level bins from at * 2 ** level behind the first bin.
    """

    settings: DataFrame
    bins: DataFrame
    sums: DataFrame
    ranked: DataFrame
    widths: dict[str, float]
    first: dict[str, int]
    levels: dict[str, int]
    k: int


def _bin(name: str, width: float) -> Column:
    return F.floor(F.col(name).cast("double") / width).cast("long")


def _scored(sums: DataFrame) -> DataFrame:
    """Score, spread and confidence beside the sums."""
    n = F.col("n")
    return sums.withColumns(
        {
            "score": F.round(mean(F.col("total"), n), 4),
            "score_spread": F.round(spread(F.col("total"), F.col("squares"), n), 4),
            "confidence": F.round(wilson_low(F.col("successes"), n), 6),
        }
    )


def _order() -> list:
    return [F.desc("score"), F.desc("confidence"), "temperature_bin", "pressure_bin"]


def build_cells(summed: DataFrame, widths: dict[str, float], k: int) -> Cells:
    """Sum up `settings(...)` for any number of queries that ask for up to `k` bins.

    Every bin counts in one rectangle per pair of levels, and the levels grow with the
    logarithm of the occupied range, so the hierarchy is bins * levels * levels rows at most.
    """
    placed = cut(summed.withColumns({f"{p}_bin": _bin(p, widths[p]) for p in PARAMS}))
    keys = ["experiment_type", *[f"{p}_bin" for p in PARAMS]]
    bins = cut(_scored(placed.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _SUMS])))
    ends = bins.agg(
        *[F.min(f"{p}_bin").alias(f"{p}_first") for p in PARAMS],
        *[F.max(f"{p}_bin").alias(f"{p}_last") for p in PARAMS],
    ).first()
    first = {p: ends[f"{p}_first"] or 0 for p in PARAMS}
    levels = {p: ((ends[f"{p}_last"] or 0) - first[p]).bit_length() for p in PARAMS}
    spread_out = bins
    for p in PARAMS:
        offset = F.col(f"{p}_bin") - F.lit(first[p])
        at = F.transform(
            F.sequence(F.lit(0), F.lit(levels[p])),
            lambda i: F.struct(i.alias("level"), F.floor(offset / F.pow(F.lit(2.0), i)).cast("long").alias("at")),
        )
        alone = F.array(F.struct(F.lit(_NO_VALUE).alias("level"), F.lit(0).cast("long").alias("at")))
        spread_out = spread_out.withColumn(
            f"_{p}", F.explode(F.when(F.col(f"{p}_bin").isNull(), alone).otherwise(at))
        ).withColumns({f"{p}_level": F.col(f"_{p}.level"), f"{p}_at": F.col(f"_{p}.at")}).drop(f"_{p}")
    cell = ["experiment_type", *[f"{p}_{part}" for p in PARAMS for part in ("level", "at")]]
    spread_out = cut(spread_out)
    sums = cut(spread_out.groupBy(*cell).agg(*[F.sum(c).alias(c) for c in _SUMS]))
    # A rank limit: tasks send k bins of a rectangle at most.
    order = Window.partitionBy(*cell).orderBy(*_order())
    ranked = cut(spread_out.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= k).drop("_nth"))
    discard(spread_out)
    return Cells(placed, bins, sums, ranked, widths, first, levels, k)


def _reach(cells: Cells, param: str) -> dict[str, Column]:
    """Inner bins (whole inside the bounds) and touched bins of a query, as offsets."""
    low, high = F.col(f"{param}_min"), F.col(f"{param}_max")
    width, first = cells.widths[param], F.lit(cells.first[param])
    end = F.lit((1 << cells.levels[param]) - 1).cast("long")

    def inside(c: Column) -> Column:
        return F.least(F.greatest(c - first, F.lit(-1)), end + 1).cast("long")

    return {
        f"{param}_inner": F.greatest(F.when(low.isNull(), 0).otherwise(inside(F.ceil(low / width))), F.lit(0)),
        f"{param}_inner_end": F.least(F.when(high.isNull(), end + 1).otherwise(inside(F.floor(high / width))), end + 1),
        f"{param}_from": F.when(low.isNull(), 0).otherwise(inside(F.floor(low / width))).cast("long"),
        f"{param}_to": F.when(high.isNull(), end).otherwise(inside(F.floor(high / width))).cast("long"),
    }


def _pieces(cells: Cells, param: str) -> Column:
    """The rectangles' sides that make up the inner bins: at most two a level."""

    def of(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level)
        left = F.ceil(F.col(f"{param}_inner") / size).cast("long")
        right = F.floor(F.col(f"{param}_inner_end") / size).cast("long")
        piece = lambda at: F.struct(level.alias("level"), at.cast("long").alias("at"))
        return F.array(
            F.when((left < right) & (left % 2 == 1), piece(left)),
            F.when((left < right) & (right % 2 == 1), piece(right - 1)),
        )

    found = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(cells.levels[param])), of))
    free = F.col(f"{param}_min").isNull() & F.col(f"{param}_max").isNull()
    alone = F.array(F.struct(F.lit(_NO_VALUE).alias("level"), F.lit(0).cast("long").alias("at")))
    return F.concat(
        F.filter(found, lambda x: x.isNotNull()),
        F.when(free, alone).otherwise(F.slice(alone, 1, 0)),
    )


def covering(queries: DataFrame, cells: Cells) -> DataFrame:
    """query_id and the rectangles whose bins all lie inside its bounds, none twice."""
    reached = queries
    for p in PARAMS:
        reached = reached.withColumns(_reach(cells, p))
    for p in PARAMS:
        reached = reached.withColumn(f"_{p}", F.explode(_pieces(cells, p)))
    return reached.select(
        "query_id",
        "experiment_type",
        *[F.col(f"_{p}.{part}").alias(f"{p}_{part}") for p in PARAMS for part in ("level", "at")],
    )


def edge_settings(queries: DataFrame, cells: Cells) -> DataFrame:
    """Settings inside the bounds in those bins that the bounds of a query cut.

    A cut bin has a cut side: the bin of a bound in one parameter, and in the other any bin
    that the query touches. Occupied bins are found by that side first, so settings are
    met in cut bins only.
    """
    reached = queries
    for p in PARAMS:
        reached = reached.withColumns(_reach(cells, p))
    bins = cells.bins.select(
        F.col("experiment_type").alias("_type"),
        *[(F.col(f"{p}_bin") - F.lit(cells.first[p])).alias(f"_{p}") for p in PARAMS],
    )

    def cut_side(param: str) -> Column:
        sides = F.array_distinct(F.array(F.col(f"{param}_from"), F.col(f"{param}_to")))
        inner = lambda b: (b >= F.col(f"{param}_inner")) & (b < F.col(f"{param}_inner_end"))
        return F.filter(sides, lambda b: ~inner(b))

    def touched(param: str, inner_only: bool) -> Column:
        at, low, high = F.col(f"_{param}"), F.col(f"{param}_min"), F.col(f"{param}_max")
        if inner_only:
            inside = (at >= F.col(f"{param}_inner")) & (at < F.col(f"{param}_inner_end"))
        else:
            inside = at.between(F.col(f"{param}_from"), F.col(f"{param}_to"))
        return F.when(at.isNull(), low.isNull() & high.isNull()).otherwise(inside)

    one, other = PARAMS
    found = []
    # Bins cut in both parameters come with the first one.
    for side, rest, inner_only in ((one, other, False), (other, one, True)):
        asked = reached.withColumn("_side", F.explode(cut_side(side)))
        same = (F.col("experiment_type") == F.col("_type")) & (F.col("_side") == F.col(f"_{side}"))
        found.append(asked.join(bins, same).filter(touched(rest, inner_only)))
    cut_bins = found[0].unionByName(found[1]).select(
        "query_id", "_type", *[f"{p}_{end}" for p in PARAMS for end in ("min", "max")],
        *[(F.col(f"_{p}") + F.lit(cells.first[p])).alias(f"_{p}") for p in PARAMS],
    )
    same = F.col("experiment_type") == F.col("_type")
    for p in PARAMS:
        same = same & F.col(f"{p}_bin").eqNullSafe(F.col(f"_{p}"))
    inside = [within(F.col(p).cast("double"), F.col(f"{p}_min"), F.col(f"{p}_max")) for p in PARAMS]
    met = cut_bins.join(cells.settings, same).filter(inside[0] & inside[1])
    return met.select("query_id", *cells.settings.columns)


def _same_cell(asked: DataFrame, table: DataFrame) -> DataFrame:
    keys = ["experiment_type", *[f"{p}_{part}" for p in PARAMS for part in ("level", "at")]]
    return asked.join(table, keys)


def best_bins(queries: DataFrame, cells: Cells) -> DataFrame:
    """The k best bins of every query, as `best(score_bins(match(...)))` ranks them."""
    columns = [
        "query_id", "experiment_type", "temperature_bin", "pressure_bin", "n", "successes", "score", "score_spread",
        "confidence",
    ]
    inner = _same_cell(covering(queries, cells), cells.ranked).select(*columns)
    keys = columns[:4]
    sums = edge_settings(queries, cells).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _SUMS])
    return best(inner.unionByName(_scored(sums).select(*columns)), cells.k)


def totals(queries: DataFrame, cells: Cells) -> DataFrame:
    """Count, successes, mean outcome and confidence of everything inside a query's bounds."""
    columns = ["query_id", *_SUMS]
    inner = _same_cell(covering(queries, cells), cells.sums).select(*columns)
    sums = inner.unionByName(edge_settings(queries, cells).select(*columns))
    whole = sums.groupBy("query_id").agg(*[F.sum(c).alias(c) for c in _SUMS])
    n = F.coalesce("n", F.lit(0))
    return queries.select("query_id", "experiment_type").join(whole, "query_id", "left").select(
        "query_id",
        "experiment_type",
        n.alias("n"),
        F.coalesce("successes", F.lit(0)).alias("successes"),
        F.round(mean(F.col("total"), F.col("n")), 4).alias("mean_outcome"),
        F.round(wilson_low(F.coalesce("successes", F.lit(0)), n), 6).alias("confidence"),
    )


def best(scored: DataFrame, k: int) -> DataFrame:
    """The k best bins of every query; a rank limit, so tasks send k rows at most."""
    order = Window.partitionBy("query_id").orderBy(
        F.desc("score"), F.desc("confidence"), "temperature_bin", "pressure_bin"
    )
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def best_of_one(scored: DataFrame, query_id: int, k: int) -> DataFrame:
    """The k best bins of a single query."""
    return (
        scored.filter(F.col("query_id") == query_id)
        .orderBy(F.desc("score"), F.desc("confidence"), "temperature_bin", "pressure_bin")
        .limit(k)
    )


def envelopes(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """One answer per query: predictions best first, and the first one's confidence.

    A query that matched nothing gets an empty list and confidence 0. The list has at
    most the k rows that `best` left for its query.
    """
    row = F.struct(
        "rank", "temperature_bin", "pressure_bin", "n", "successes", "score", "confidence"
    )
    lists = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("predictions"))
    empty = F.array().cast("array<struct<rank:int,temperature_bin:bigint,pressure_bin:bigint,"
                           "n:bigint,successes:bigint,score:double,confidence:double>>")
    predictions = F.coalesce("predictions", empty)
    return queries.join(lists, "query_id", "left").select(
        "query_id",
        "experiment_type",
        predictions.alias("predictions"),
        F.coalesce(F.get(predictions, F.lit(0))["confidence"], F.lit(0.0)).alias("confidence"),
    )


def histogram(long: DataFrame, bins: int = 10) -> DataFrame:
    """Rows per type, parameter and one of `bins` equal parts of the observed range.

    long: experiment_type, name, value. One pass over the data: rows are counted per
    distinct value and everything else works on the stored counts.
    """
    keys = ["experiment_type", "name"]
    values = cut(
        long.groupBy(*keys, F.col("value").cast("double").alias("value")).agg(
            F.count("*").alias("n")
        )
    )
    edges = values.groupBy(*keys).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    width = F.col("high") - F.col("low")
    part = F.floor((F.col("value") - F.col("low")) * F.lit(float(bins)) / width)
    bucket = F.when(width > 0, F.least(part, F.lit(bins - 1)) + 1).otherwise(1)
    return (
        values.join(edges, keys)
        .groupBy(*keys, "low", "high", bucket.cast("long").alias("bucket"))
        .agg(F.sum("n").alias("n"))
    )
