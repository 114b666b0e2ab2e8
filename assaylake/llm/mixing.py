"""Mixing sources to target weights by temperature.

Source shares p are raised to an exponent and normalised: w = p^a / sum(p^a). The largest
exponent between 0 and 1 is found that still reaches the target entropy, and the smallest
that keeps every source within the repetition limit; the weights are then realised as a
token budget, filled by permutations of each source, epoch by epoch, in blocks that each
hold the mixture.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, running_sums, store

EXACT = "decimal(38,18)"
LEVELS = 4  # halvings that one pass over the source totals makes
PASSES = 8


@dataclass(frozen=True)
class Mixture:
    alpha: float
    entropy: float
    repetition: float
    budget: int


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens of the documents that have words; a doc_id counts once.

    Rows that repeat a doc_id are one document, the least by (source, words). Documents
    without words take no part: they can't fill a budget. A null source is a source.
    """
    rows = docs.select("doc_id", "source", n_words(F.col("text")).cast("bigint").alias("n_tokens"))
    return (
        rows.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("s"))
        .select("doc_id", "s.source", "s.n_tokens").where("n_tokens > 0")
    )


def source_totals(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))


def _measures(totals: DataFrame, grid: list[float], total: int, budget: int) -> list[tuple]:
    """(exponent, entropy, largest repetition) for each exponent, in one pass.

    Sums are over decimals, so that they do not depend on the order of rows.
    """
    share = F.col("tokens") / F.lit(float(total))
    sums = []
    for i, alpha in enumerate(grid):
        weight = F.pow(share, F.lit(alpha))
        sums += [
            F.sum(weight.cast(EXACT)).cast("double").alias(f"z{i}"),
            F.sum((weight * F.log(share)).cast(EXACT)).cast("double").alias(f"l{i}"),
            F.max(weight / share).alias(f"r{i}"),
        ]
    row = totals.agg(*sums).first()
    return [
        (
            alpha,
            math.log(row[f"z{i}"]) - alpha * row[f"l{i}"] / row[f"z{i}"],
            row[f"r{i}"] / row[f"z{i}"] * budget / total,
        )
        for i, alpha in enumerate(grid)
    ]


def solve(
    totals: DataFrame, budget: int | None = None, entropy: float | None = None, repetition: float | None = None
) -> Mixture:
    """Bisect the exponent in [0, 1].

    Entropy falls and the largest repetition falls as the exponent grows. The result is the
    exponent nearest 0 within the repetition limit, and at most the one that reaches the
    entropy (in nats; more than log(sources) counts as that, less than the sources' own
    leaves exponent 1). Where both ask for opposite things the repetition limit wins. One
    pass makes LEVELS halvings, and nothing but sums reaches the driver.
    """
    row = totals.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    total = row.t or 0
    if not total:
        return Mixture(1.0, 0.0, 0.0, 0)
    budget = total if budget is None else budget

    low, high = 0.0, 1.0
    for _ in range(PASSES):
        steps = 1 << LEVELS
        grid = [low + (high - low) * i / steps for i in range(steps + 1)]
        measured = _measures(totals, grid, total, budget)
        # The first exponent that is allowed and, where an entropy is asked for, the last
        # one that still reaches it.
        allowed = [i for i, (_, _, r) in enumerate(measured) if repetition is None or r <= repetition]
        least = allowed[0] if allowed else steps
        if entropy is None:
            at = least
        else:
            reaching = [i for i, (_, h, _) in enumerate(measured) if h >= entropy]
            at = max(least, reaching[-1] if reaching else 0)
        low, high = grid[max(0, at - 1)], grid[min(steps, at + 1)]
        chosen = measured[at]
    alpha, h, r = chosen
    return Mixture(alpha, h, r, budget)


def weights(totals: DataFrame, mixture: Mixture) -> DataFrame:
    """source, tokens, docs, weight and quota: the tokens of the budget it fills."""
    total = F.lit(float(totals.agg(F.sum("tokens")).first()[0] or 1))
    raw = F.pow(F.col("tokens") / total, F.lit(mixture.alpha))
    z = totals.agg(F.sum(raw.cast(EXACT)).cast("double")).first()[0] or 1.0
    return (
        totals.withColumn("weight", F.round(raw / F.lit(z), 9))
        .withColumn("quota", F.floor(F.col("weight") * F.lit(float(mixture.budget)) + 0.5).cast("bigint"))
    )


def _hash(*parts: Column | str | int) -> Column:
    """60 bits of md5 of the parts as text, as a number that SQL engines agree on."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, int) else F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def realise(docs: DataFrame, shares: DataFrame, block_tokens: int = 1_000_000, cell_docs: int = 512) -> DataFrame:
    """doc_id, source, epoch, n_tokens, block, place: the copies that make up the budget.

    `docs` as of counted(). Each epoch of a source is its documents in an order of their
    own; copies are taken while the tokens before them are below the source's quota, and go
    to the block at the same fraction of all blocks as of the quota. `place` orders a block
    at random. Running sums are made over cells of about `cell_docs` documents of hash
    neighbours, then over the cells, so no window holds a whole source.
    """
    budget = shares.agg(F.sum("quota")).first()[0] or 0
    blocks = max(1, -(-budget // block_tokens))
    copies = (
        docs.join(
            shares.where("quota > 0").select(
                F.col("source").alias("_source"), "tokens", "quota",
                F.pow(2, F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("docs") / cell_docs)))).cast("bigint").alias("cells"),
            ),
            F.col("source").eqNullSafe(F.col("_source")),
        )
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.floor((F.col("quota") - 1) / F.col("tokens")).cast("int"))))
        .withColumn("order", _hash("doc_id", "epoch"))
        .withColumn("cell", (F.col("order") % F.col("cells")).cast("bigint"))
        .select("doc_id", "source", "epoch", "n_tokens", "tokens", "quota", "order", "cell")
    )
    copies = store(copies)
    sums = copies.groupBy("source", "epoch", "cell").agg(F.sum("n_tokens").alias("n"))
    before = running_sums(sums, ["source", "epoch"], "cell", "n").select(
        F.col("source").alias("_source"), F.col("epoch").alias("_epoch"), F.col("cell").alias("_cell"), "before"
    )
    cell = Window.partitionBy("source", "epoch", "cell").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    start = (
        F.col("epoch") * F.col("tokens") + F.col("before") + F.coalesce(F.col("within"), F.lit(0))
    )
    taken = (
        copies.withColumn("within", F.sum("n_tokens").over(cell))
        .join(before, F.expr("source <=> _source and epoch = _epoch and cell = _cell"))
        .withColumn("start", start)
        .where("start < quota")
        .withColumn("block", F.floor(F.col("start") * F.lit(float(blocks)) / F.col("quota")).cast("bigint"))
        .withColumn("shuffled", _hash("block", "doc_id", "epoch"))
    )
    within = Window.partitionBy("block").orderBy("shuffled", "doc_id", "epoch")
    return taken.withColumn("place", F.row_number().over(within)).select(
        "doc_id", "source", "epoch", "n_tokens", "block", "place"
    )


def mix(
    docs: DataFrame, entropy: float | None = None, repetition: float | None = 4.0, budget: int | None = None,
    block_tokens: int = 1_000_000,
) -> DataFrame:
    """The copies of documents (doc_id, source, epoch, n_tokens, block, place) of a mixture.

    Without an entropy the sources are levelled as far as the repetition limit allows; the
    budget is the corpus's own number of words unless given. An empty table gives no rows.
    """
    rows = store(counted(docs))
    totals = store(source_totals(rows))
    return realise(rows, weights(totals, solve(totals, budget, entropy, repetition)), block_tokens)
