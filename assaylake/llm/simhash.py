"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link at `distance` or fewer differing bits. Correlated bits form
parts, and part i gets a threshold t_i with sum(t_i + 1) = distance + 1: two fingerprints
within the distance are then within t_i on some part. The thresholds come from dynamic
programming over estimated candidate counts; a part with threshold -1 is not probed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, record, store, texts, type_of
from .components import components

BITS = 64
SEED = 42


def fingerprint(text: str, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the word shingles; 0 for a text without words."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_digest
    packed = np.frombuffer(b"".join([digest(g, SEED) for g in grams]), np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(packed), 1 << 14):
        ones += np.unpackbits(packed[at : at + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(packed)).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle) for t in texts(batch.column(1))]
            yield record(["doc_id", "fp"], [batch.column(0), pa.array(fps, pa.int64())])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {type_of(docs, 'doc_id')}, fp bigint")


def correlated_parts(sample: np.ndarray, count: int) -> list[list[int]]:
    """Split the bits into `count` parts of even size, correlated bits together."""
    bits = np.unpackbits(sample.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(float)
    centred = bits - bits.mean(axis=0)
    spread = np.sqrt((centred**2).sum(axis=0))
    spread[spread == 0] = np.inf
    near = np.abs(centred.T @ centred) / np.outer(spread, spread)
    free, parts = list(range(BITS)), []
    for left in range(count, 0, -1):
        size = -(-len(free) // left)
        part = [free.pop(0)]
        while len(part) < size:
            best = max(free, key=lambda b: (near[b, part].mean(), -b))
            free.remove(best)
            part.append(best)
        parts.append(sorted(part))
    return parts


def _mask(bits: list[int]) -> int:
    return sum(1 << (BITS - 1 - b) for b in bits)


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds with sum(t + 1) = budget and least cost; costs[i][t + 1] is part i at t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for units, own in enumerate(row):
                total = used + units
                if total <= budget and (total not in step or cost + own < step[total][0]):
                    step[total] = (cost + own, [*chosen, units - 1])
        best = step
    return best[budget]


def plan(sample: np.ndarray, total: int, distance: int) -> list[tuple[list[int], int]]:
    """The parts to probe and their thresholds, for `total` distinct fingerprints.

    The sample only steers costs; every plan finds every pair.
    """
    row_cost, pair_cost = 1.0, 0.02
    pairs = max(1, len(sample) * (len(sample) - 1) // 2)
    left, right = np.triu_indices(len(sample), 1)
    options = []
    for count in range(2, distance + 2):
        parts = correlated_parts(sample, count)
        costs = []
        for part in parts:
            apart = np.bitwise_count((sample[left] ^ sample[right]) & np.uint64(_mask(part)))
            row = [0.0]
            for threshold in range(distance + 1):
                keys = comb(len(part), threshold)
                ball = sum(comb(len(part), i) for i in range(threshold + 1)) / 2.0 ** len(part)
                share = max(ball, float((apart <= threshold).sum()) / pairs)
                row.append(total * keys * row_cost + share * total * total / 2 * pair_cost)
            costs.append(row)
        cost, chosen = allocate(costs, distance + 1)
        options.append((cost, [(p, t) for p, t in zip(parts, chosen) if t >= 0]))
    return min(options, key=lambda o: o[0])[1]


def probe_masks(parts: list[tuple[list[int], int]]) -> list[int]:
    """Bits kept in each probe key: values within t of each other agree under one of
    the masks that drop t bits of the part."""
    masks = []
    for bits, threshold in parts:
        for dropped in combinations(bits, threshold):
            masks.append(_mask([b for b in bits if b not in dropped]))
    return masks


def close_sets(fps: np.ndarray, side: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """(least member, member) of each set that links join within one candidate group.

    `side` marks the halves of a group that was dealt out in blocks: only rows of
    different sides meet, or all where there is one side.
    """
    n = len(fps)
    cross = side.any() and not side.all()
    linked = np.zeros((n, n), bool)
    for at in range(0, n, 256):
        linked[at : at + 256] = np.bitwise_count(fps[at : at + 256, None] ^ fps[None, :]) <= distance
        if cross:
            linked[at : at + 256] &= side[at : at + 256, None] != side[None, :]
    found = []
    todo = np.flatnonzero(linked.sum(axis=1) > (0 if cross else 1))
    seen = np.zeros(n, bool)
    for root in todo:
        if seen[root]:
            continue
        seen[root] = True
        members, frontier = [root], np.array([root])
        while len(frontier):
            reached = linked[frontier].any(axis=0) & ~seen
            seen |= reached
            frontier = np.flatnonzero(reached)
            members.extend(frontier)
        values = np.sort(fps[members].view(np.int64))
        found.extend((int(values[0]), int(v)) for v in values[1:])
    return found


def links(distinct: DataFrame, distance: int = 3, sample_size: int = 2048, block: int = 1024) -> DataFrame:
    """Edges (u, v) between fingerprints whose transitive closure is that of all links.

    `distinct` holds each fingerprint once. A candidate group of more than `block` rows is
    dealt out as pairs of blocks, so a task never holds a whole hot group, and each group
    gives at most one edge per row. `sample_size` fingerprints of smallest hash steer the
    choice of parts.
    """
    total = distinct.count()
    picked = distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample_size).select("fp").collect()
    sample = np.array([r.fp for r in picked], np.int64).view(np.uint64)
    if total < 2:
        return distinct.select(F.col("fp").alias("u"), F.col("fp").alias("v")).where(F.lit(False))
    masks = probe_masks(plan(sample, total, distance))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for number, mask in enumerate(masks):
                key = (fps & np.uint64(mask)).view(np.int64)
                yield record(
                    ["probe", "key", "fp"],
                    [np.full(len(fps), number, np.int32), key, fps.view(np.int64)],
                )

    probes = distinct.select("fp").mapInArrow(keys, "probe int, key bigint, fp bigint")
    shared = probes.groupBy("probe", "key").count().where("count > 1")
    dealt = (
        probes.join(shared, ["probe", "key"])
        .withColumn("blocks", F.ceil(F.col("count") / block).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "probe", "key", "fp",
            F.least("own", "other").alias("low"),
            F.greatest("own", "other").alias("high"),
            (F.col("own") > F.col("other")).alias("side"),
        )
    )
    group = ["probe", "key", "low", "high"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for rows in grouped(batches, group):
            fps = rows.column("fp").to_numpy().view(np.uint64)
            if len(fps) == 2:
                if int(fps[0] ^ fps[1]).bit_count() <= distance:
                    found.append(tuple(sorted(fps.view(np.int64).tolist())))
            elif len(fps) > 2:
                side = rows.column("side").to_numpy()
                found.extend(close_sets(fps, side, distance))
            if len(found) >= 4096:
                yield _edges(found)
                found = []
        yield _edges(found)

    return (
        dealt.repartition(*group).sortWithinPartitions(*group)
        .mapInArrow(verify, "u bigint, v bigint").distinct()
    )


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*found) if found else ((), ())
    return record(["u", "v"], [pa.array(u, pa.int64()), pa.array(v, pa.int64())])


def near_duplicates(docs: DataFrame, distance: int = 3, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    `component_id` is the smallest doc_id reachable over links of `distance` or fewer
    bits. Null and empty texts have fingerprint zero and link like any other; rows that
    repeat a text or doc_id each get their row; other columns are ignored. Copies meet by
    their fingerprint and are never paired with each other.
    """
    made = store(fingerprints(docs, shingle))
    distinct = store(made.groupBy("fp").agg(F.min("doc_id").alias("first")))
    joined = components(links(distinct, distance))
    leads = (
        distinct.join(joined, distinct.fp == joined.node, "left")
        .select("fp", "first", F.coalesce("component", "fp").alias("set"))
    )
    least = leads.groupBy("set").agg(F.min("first").alias("component_id"))
    of = leads.join(least, "set").select("fp", "component_id")
    return made.join(of, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
