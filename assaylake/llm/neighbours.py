"""Nearest neighbours by inner product with vantage-point trees, one per shard.

Inner products become distances by one more coordinate, sqrt(M^2 - |x|^2) with M the
largest norm (and 0 for a query): the nearest then has the largest product. A tree is a
table of vantage points and radii; a leaf is reached through a side of each of its
ancestors, and the triangle inequality bounds its distance to a query from below. A leaf
is left out if its bound exceeds `factor` times the distance of the k-th best so far. A
factor of one restores exact search; smaller factors search less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import grouped, record, store

LEAF = 64
FIRST = 2  # leaves that each query visits before it goes through the rest with the others


def usable(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, vector (array<double>), norm: without null, zero or non-finite vectors.

    A norm that overflows counts as non-finite; an empty vector as zero.
    """
    values = F.transform(vector, lambda x: x.cast("double"))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    return (
        vectors.select(F.col(id_column).alias("vec_id"), values.alias("vector"))
        .where("vec_id is not null and vector is not null")
        .where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        .withColumn("norm", F.sqrt(square))
        .where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    )


def build_tree(points: np.ndarray, seed: int) -> dict[str, np.ndarray]:
    """Vantage points (rows of `points`), radii, and the leaves with their ancestors.

    `lows` and `highs` hold for each leaf and node the range of distances to the node's
    vantage point within the leaf's side; nodes that are no ancestors have (0, inf).
    """
    random = np.random.default_rng(seed)
    vantage, members, walls = [], [], []
    todo = [(np.arange(len(points)), [])]
    while todo:
        own, above = todo.pop()
        if len(own) <= LEAF:
            members.append(own)
            walls.append(above)
            continue
        node = int(own[random.integers(len(own))])
        apart = np.linalg.norm(points[own] - points[node], axis=1)
        ranked = np.argsort(apart, kind="stable")
        half = len(own) // 2
        number = len(vantage)
        vantage.append(node)
        for side in (ranked[:half], ranked[half:]):
            todo.append((own[side], [*above, (number, apart[side].min(), apart[side].max())]))
    lows = np.zeros((len(members), len(vantage)))
    highs = np.full((len(members), len(vantage)), np.inf)
    for leaf, above in enumerate(walls):
        for number, low, high in above:
            lows[leaf, number], highs[leaf, number] = low, high
    return {
        "vantage": np.array(vantage, np.int64), "lows": lows, "highs": highs,
        "order": np.concatenate(members) if members else np.zeros(0, np.int64),
        "ends": np.cumsum([len(m) for m in members]),
    }


def search_tree(
    tree: dict[str, np.ndarray], points: np.ndarray, ids: np.ndarray, raw: np.ndarray,
    queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float,
) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], int]:
    """(query, ids, scores) of each query's k nearest in the tree, and leaf visits."""
    vectors = raw[tree["order"]]
    own_ids = ids[tree["order"]]
    starts = np.concatenate([[0], tree["ends"][:-1]]).astype(int)
    ends = tree["ends"].astype(int)
    top = float((points[0] ** 2).sum()) if len(points) else 0.0  # every augmented point has norm M
    lengths = (queries**2).sum(axis=1)
    if len(tree["vantage"]):
        product = queries @ raw[tree["vantage"]].T
        apart = np.sqrt(np.maximum(lengths[:, None] + top - 2 * product, 0))
        bounds = np.zeros((len(queries), len(starts)))
        for leaf in range(len(starts)):
            gap = np.maximum(tree["lows"][leaf] - apart, apart - tree["highs"][leaf])
            bounds[:, leaf] = np.maximum(gap.max(axis=1), 0)
    else:
        bounds = np.zeros((len(queries), len(starts)))
    ranked = np.argsort(bounds, axis=1, kind="stable")
    best = np.full((len(queries), k), -np.inf)
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in queries]
    visits = 0

    def within_reach(rows: np.ndarray, leaf: np.ndarray | int) -> np.ndarray:
        reach = np.sqrt(np.maximum(lengths[rows] + top - 2 * best[rows, 0], 0))
        reach[~np.isfinite(best[rows, 0])] = np.inf
        return rows[bounds[rows, leaf] <= factor * reach + 1e-9]

    def visit(rows: np.ndarray, leaf: int) -> None:
        block = slice(starts[leaf], ends[leaf])
        scores = queries[rows] @ vectors[block].T
        scores[query_ids[rows, None] == own_ids[None, block]] = -np.inf
        # Most leaves hold nothing for a query whose k best are found already.
        least = best[rows, 0] - 1e-9 * (1 + np.abs(best[rows, 0]))
        some = np.flatnonzero(scores.max(axis=1) >= np.where(np.isfinite(best[rows, 0]), least, -np.inf))
        if not len(some):
            return
        rows, scores = rows[some], scores[some]
        merged = np.concatenate([best[rows], scores], axis=1)
        best[rows] = np.sort(np.partition(merged, merged.shape[1] - k, axis=1)[:, -k:], axis=1)
        slack = 1e-9 * (1 + np.abs(best[rows, 0]))
        near = scores >= np.where(np.isfinite(best[rows, 0]), best[rows, 0] - slack, -1e300)[:, None]
        hits, values = np.nonzero(near)[1] + starts[leaf], scores[near]
        edges = np.concatenate([[0], np.cumsum(near.sum(axis=1))]).tolist()
        for row, begin, end in zip(rows.tolist(), edges, edges[1:]):
            if end > begin:
                found[row].append((hits[begin:end], values[begin:end]))

    everyone = np.arange(len(queries))
    # The leaves of smallest bound first, query by query, then leaf by leaf for all queries.
    for turn in range(min(FIRST, len(starts))):
        rows = within_reach(everyone, ranked[:, turn])
        leaf = ranked[rows, turn]
        order = np.argsort(leaf, kind="stable")
        cuts = np.flatnonzero(np.diff(leaf[order])) + 1
        for group in np.split(rows[order], cuts) if len(rows) else []:
            visits += len(group)
            visit(group, int(ranked[group[0], turn]))
    turns = np.argsort(ranked, axis=1)
    for leaf in range(len(starts)):
        rows = within_reach(np.flatnonzero(turns[:, leaf] >= FIRST), leaf)
        if len(rows):
            visits += len(rows)
            visit(rows, leaf)
    out = []
    for row, parts in enumerate(found):
        if not parts:
            continue
        hits = np.concatenate([p[0] for p in parts])
        rough = np.concatenate([p[1] for p in parts])
        floor = best[row, 0] - 1e-9 * (1 + abs(best[row, 0])) if np.isfinite(best[row, 0]) else -np.inf
        hits = hits[rough >= floor]
        exact = np.einsum("ij,ij->i", vectors[hits], np.broadcast_to(queries[row], vectors[hits].shape))
        first = np.lexsort((own_ids[hits], -exact))[:k]
        out.append((row, own_ids[hits][first], exact[first]))
    return out, visits


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, factor: float = 0.7,
    shard_rows: int = 16_384, query_rows: int = 1024,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of id divisible by `every`.

    `vectors` has vec_id (bigint) and embedding. All rows are dealt by hash to shards of
    about `shard_rows`, each with a tree of its own; queries visit every shard in blocks of
    about `query_rows`, and only their k best per shard move on. A query never finds its
    own id; ties go to the smaller vec_id. Null, zero and non-finite vectors take no part,
    and neither do those of another than the most frequent length (the greater of two equally
    frequent ones); rows that repeat a vec_id count as one, the smallest vector; an empty table
    gives no rows.
    """
    kept = usable(vectors)
    size = F.size("vector").alias("size")
    length = kept.groupBy(size).count().orderBy(F.desc("count"), F.desc("size")).first()
    if length:
        kept = kept.where(F.size("vector") == length["size"])
    rows = store(kept.groupBy("vec_id").agg(F.min(F.struct("vector", "norm")).alias("v")).select("vec_id", "v.*"))
    summary = rows.agg(F.count("*").alias("n"), F.max("norm").alias("m")).first()
    if not summary.n:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    largest = summary.m
    shards = -(-summary.n // shard_rows)
    blocks = max(1, -(-summary.n // every // query_rows))
    packed = "shard int, ids binary, vectors binary"

    def pack(name: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in grouped(batches, [name]):
                ids = part.column("vec_id").to_numpy()
                order = np.argsort(ids)
                matrix = np.array(part.column("vector").to_pylist(), np.float64)[order]
                yield record(
                    ["shard", "ids", "vectors"],
                    [
                        pa.array([part.column(name)[0].as_py()], pa.int32()),
                        pa.array([ids[order].astype(np.int64).tobytes()], pa.binary()),
                        pa.array([matrix.tobytes()], pa.binary()),
                    ],
                )

        return run

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    index = (
        dealt.select("shard", "vec_id", "vector").repartition("shard").sortWithinPartitions("shard")
        .mapInArrow(pack("shard"), packed)
    )
    asked = (
        rows.where(F.col("vec_id") % every == 0)
        .withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).cast("int"))
    )
    questions = (
        asked.select("block", "vec_id", "vector").repartition("block").sortWithinPartitions("block")
        .mapInArrow(pack("block"), packed)
        .select(F.col("shard").alias("block"), F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    )
    pairs = questions.join(index, "shard").repartition("shard", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tree = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in ("shard", "ids", "vectors", "query_ids", "queries")}
                ids = np.frombuffer(row["ids"].as_buffer(), np.int64)
                raw = np.frombuffer(row["vectors"].as_buffer(), np.float64).reshape(len(ids), -1)
                query_ids = np.frombuffer(row["query_ids"].as_buffer(), np.int64)
                queries = np.frombuffer(row["queries"].as_buffer(), np.float64).reshape(len(query_ids), -1)
                extra = np.sqrt(np.maximum(largest**2 - (raw**2).sum(axis=1), 0))
                points = np.column_stack([raw, extra])
                if row["shard"].as_py() != last:
                    last, tree = row["shard"].as_py(), build_tree(points, row["shard"].as_py())
                found, _ = search_tree(tree, points, ids, raw, queries, query_ids, k, factor)
                for some in (found[at : at + 256] for at in range(0, len(found), 256)):
                    yield record(
                        ["query_id", "vec_id", "score"],
                        [
                            np.repeat(query_ids[[f[0] for f in some]], [len(f[1]) for f in some]),
                            np.concatenate([f[1] for f in some]), np.concatenate([f[2] for f in some]),
                        ],
                    )

    answers = pairs.mapInArrow(search, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        answers.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
