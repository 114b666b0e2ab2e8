"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, store


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Link every larger neighbour of a node to the least of its neighbourhood; what was stored."""
    both = _both(edges)
    # Stored here and below, so that the join can split the rows of a hub over tasks.
    least = store(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), least


def _small(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Link a node and its smaller neighbours to the least of them; what was stored."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = store(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))), least


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row.n, row.x or 0


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node in `edges` (u, v).

    Each round writes its edges to the shared folder, where they replace those of the round
    before; there are at most as many. Loops and repeated edges do no harm; without edges the result is empty.
    """
    now = store(edges.where("u <> v").distinct())
    mark = _mark(now)
    while mark[0]:
        large, first = _large(now)
        small, second = _small(large)
        after = store(small.where("u <> v").distinct())
        again = _mark(after)
        discard(now, first, second)
        now = after
        if again == mark:
            break
        mark = again
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
