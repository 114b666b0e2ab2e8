"""Vector codes by ball k-means: exact Lloyd rounds that compare a part with few entries.

Vectors become whole numbers and are cut into `PARTS` consecutive parts, each with a
codebook of its own. An entry with its parts is a ball. Entries further away than twice the
ball's radius can take none of its parts, so they are no neighbours; the radius is known
from the round before and the entry's own shift. A part nearer to its entry than half the
distance of the first neighbour lies in the stable core and is compared with none; one in
the ring between the k-th and the next neighbour is compared with the first k only.

All sums are of whole numbers, so results do not depend on partitions.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record, store

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
# Whole components beyond this count as this; doubles hold all whole numbers up to it.
LIMIT = 10**15
TOP = 2**63 - 1
ROWS = 65_536  # vectors of a task that are assigned together
RING = 16  # neighbours in the first ring that is compared; each further one has twice as many


@dataclass(frozen=True)
class Codebook:
    """Entries of one part and, of each, its neighbours by distance (empty before round one)."""

    entries: np.ndarray  # whole numbers, int64 or object
    near: tuple[np.ndarray, ...] = ()
    gaps: tuple[np.ndarray, ...] = ()  # squared distances to `near`, ascending


def _exact(*tables: np.ndarray) -> bool:
    """True if squared distances between rows of the tables fit doubles exactly."""
    top = max((int(abs(t).max()) for t in tables if t.size), default=0)
    return 4 * top * top * max(t.shape[1] for t in tables) < 1 << 53


def _whole(values: np.ndarray) -> np.ndarray:
    return values if values.dtype == object else values.astype(np.int64)


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, points by entries, as exact whole numbers."""
    if _exact(points, entries):
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ e.T) + (e * e).sum(axis=1)[None, :]).astype(np.int64)
    p, e = points.astype(object), entries.astype(object)
    out = np.zeros((len(p), len(e)), object)
    for at in range(p.shape[1]):
        out += (p[:, at][:, None] - e[:, at][None, :]) ** 2
    return out


def _own(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distance of each point to the entry in the same row."""
    if not _exact(points, entries):
        points, entries = points.astype(object), entries.astype(object)
    gap = points - entries
    return (gap * gap).sum(axis=1) if gap.shape[1] else np.zeros(len(gap), np.int64)


def nearest(points: np.ndarray, book: Codebook, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every point; ties to the lower entry.

    `before` holds the entries of the round before; without it all entries are compared.
    """
    entries = book.entries
    if before is None or not book.near:
        code, least = np.zeros(len(points), np.int64), []
        for at in range(0, len(points), 4096):
            apart = distances(points[at : at + 4096], entries)
            code[at : at + 4096] = apart.argmin(axis=1)
            least.append(apart.min(axis=1))
        return code, np.concatenate(least) if least else np.zeros(0, np.int64)
    code, least = before.copy(), _own(points, entries[before])
    order = np.argsort(before, kind="stable")
    starts = np.searchsorted(before[order], np.arange(len(entries) + 1))
    for ball in np.flatnonzero(starts[1:] > starts[:-1]):
        if not len(book.near[ball]):
            continue
        rows = order[starts[ball] : starts[ball + 1]]
        # The ring of a part: how many neighbours are within twice its own distance.
        ring = np.searchsorted(book.gaps[ball], 4 * least[rows], side="right")
        rows, ring = rows[ring > 0], ring[ring > 0]
        outward = np.argsort(-ring, kind="stable")
        rows, ring = rows[outward], ring[outward]
        first, width = 0, RING
        while reached := int(np.searchsorted(-ring, -first, side="left")):
            at, some = rows[:reached], book.near[ball][first : first + width]
            first, width = first + width, 2 * width
            by = np.argsort(some)  # lower entries first, so that argmin keeps to them
            some = some[by]
            apart = distances(points[at], entries[some])
            pick = apart.argmin(axis=1)
            found, entry = apart[np.arange(reached), pick], some[pick]
            better = (found < least[at]) | ((found == least[at]) & (entry < code[at]))
            least[at[better]], code[at[better]] = found[better], entry[better]
    return code, least


def balls(entries: np.ndarray, radii: list[int], shifts: list[int]) -> Codebook:
    """The codebook with neighbours: entries within twice the bound of a ball's radius.

    `radii`: largest squared distance of a ball's parts to its entry before the entry moved
    by the squared distance `shifts`; -1 for a ball without parts, which needs no neighbours.
    """
    apart = distances(entries, entries)
    near, gaps = [], []
    for ball, (radius, shift) in enumerate(zip(radii, shifts)):
        row = apart[ball]
        reach = 2 * (math.isqrt(radius) + math.isqrt(shift) + 2) if radius >= 0 else -1
        inside = np.flatnonzero(row <= (reach * reach if row.dtype == object else min(reach * reach, TOP)))
        inside = inside[inside != ball] if radius >= 0 else inside[:0]
        inside = inside[np.argsort(row[inside], kind="stable")]
        near.append(inside)
        gaps.append(row[inside])
    return Codebook(entries, tuple(near), tuple(gaps))


def _bounds(size: int) -> list[int]:
    return [size * i // PARTS for i in range(PARTS + 1)]


def _points(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, x of the rows that take part: x holds floor(scale * component).

    Rows drop out if their vector is null, holds a null or non-finite component, or is not
    of the most frequent length (the greater of two equally frequent ones).
    """
    parts = F.col("embedding")
    finite = F.forall(parts, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    floors = F.transform(
        parts, lambda v: F.floor(F.least(F.greatest(v.cast("double") * scale, F.lit(-float(LIMIT))), F.lit(float(LIMIT))))
    )
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    return vectors.where(parts.isNotNull() & finite).select("vec_id", label.alias("label"), floors.cast("array<bigint>").alias("x"))


def _round(state: DataFrame, books: list[Codebook], bounds: list[int]) -> DataFrame:
    """One pass: rows with their new codes and errors (kind 0), and of each task the sums,
    counts and radii of its balls (kind 1). Tables of a task are bounded by the codebooks."""
    fresh = not any(book.near for book in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = bounds[-1]
        names = ["kind", "vec_id", "label", "x", "codes", "error", "part", "entry", "n", "radius", "sums"]
        n = [np.zeros(len(b.entries), np.int64) for b in books]
        radius = [[-1] * len(b.entries) for b in books]
        sums = [np.zeros((len(b.entries), b.entries.shape[1]), object) for b in books]

        def placed(rows: pa.Table) -> pa.RecordBatch:
            ids, labels, vectors = rows["vec_id"].combine_chunks(), rows["label"].combine_chunks(), rows["x"].combine_chunks()
            points = _points(vectors, size)
            old = None if fresh else np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(-1, PARTS)
            codes = np.zeros((len(points), PARTS), np.uint8)
            error = np.zeros(len(points), object)
            for part, book in enumerate(books):
                own = points[:, bounds[part] : bounds[part + 1]]
                code, least = nearest(own, book, None if old is None else old[:, part].astype(np.int64))
                codes[:, part] = code
                error += least.astype(object)
                order = np.argsort(code, kind="stable")
                found, starts = np.unique(code[order], return_index=True)
                n[part][found] += np.diff([*starts, len(code)])
                far = np.maximum.reduceat(_whole(least[order]), starts)
                if own.shape[1]:
                    sums[part][found] += np.add.reduceat(own[order].astype(np.int64), starts, axis=0).astype(object)
                for entry, value in zip(found.tolist(), far.tolist()):
                    radius[part][entry] = max(radius[part][entry], value)
            none = [None] * len(points)
            return record(
                names,
                [
                    np.zeros(len(points), np.int32), ids, labels, vectors,
                    pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array([min(int(e), TOP) for e in error], pa.int64()),
                    pa.array(none, pa.int32()), pa.array(none, pa.int32()), pa.array(none, pa.int64()),
                    pa.array(none, pa.string()), pa.array(none, pa.list_(pa.string())),
                ],
            )

        held: list[pa.RecordBatch] = []
        schema = None
        for batch in batches:
            schema = batch.schema
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS:
                yield placed(pa.Table.from_batches(held))
                held = []
        if held:
            yield placed(pa.Table.from_batches(held))
        rows = [(p, e) for p in range(PARTS) for e in np.flatnonzero(n[p]).tolist()]
        if not rows:
            return
        none = [None] * len(rows)
        yield record(
            names,
            [
                np.ones(len(rows), np.int32), pa.array(none, schema.field("vec_id").type),
                pa.array(none, schema.field("label").type), pa.array(none, pa.list_(pa.int64())),
                pa.array(none, pa.binary()), pa.array(none, pa.int64()),
                pa.array([p for p, _ in rows], pa.int32()), pa.array([e for _, e in rows], pa.int32()),
                pa.array([int(n[p][e]) for p, e in rows], pa.int64()), pa.array([str(radius[p][e]) for p, e in rows], pa.string()),
                pa.array([[str(int(v)) for v in sums[p][e]] for p, e in rows], pa.list_(pa.string())),
            ],
        )

    kinds = {f.name: f.dataType.simpleString() for f in state.schema}
    layout = (
        f"kind int, vec_id {kinds['vec_id']}, label {kinds['label']}, x array<bigint>, codes binary, error bigint, "
        "part int, entry int, n bigint, radius string, sums array<string>"
    )
    columns = ["vec_id", "label", "x"] if fresh else ["vec_id", "label", "x", "codes"]
    return store(state.select(*columns).mapInArrow(run, layout), "kind")


def _moved(passed: DataFrame, books: list[Codebook]) -> list[Codebook]:
    """The codebooks after every used entry has moved to the floor of its parts' mean.

    What the driver receives has one row per part, entry and component.
    """
    big = "decimal(38,0)"
    balls_of = passed.where("kind = 1").select("part", "entry", "n", F.col("radius").cast(big).alias("radius"), "sums")
    sizes = balls_of.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()
    totals = (
        balls_of.select("part", "entry", F.posexplode("sums").alias("at", "value"))
        .groupBy("part", "entry", "at").agg(F.sum(F.col("value").cast(big)).alias("total")).collect()
    )
    entries = [b.entries.astype(object) for b in books]
    count = {(r.part, r.entry): int(r.n) for r in sizes}
    for r in totals:
        entries[r.part][r.entry, r["at"]] = int(r.total) // count[r.part, r.entry]
    out = []
    for part, book in enumerate(books):
        radii = [-1] * len(book.entries)
        for r in sizes:
            if r.part == part:
                radii[r.entry] = int(r.radius)
        now = entries[part].astype(np.int64)
        shifts = [int(s) for s in _own(now, book.entries)]
        out.append(balls(now, radii, shifts))
    return out


def compress(
    vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error of every row that takes part; the entries of each part).

    Codebooks start as the parts of the `entries` rows of smallest vec_id (null ids last,
    rows of equal id by their vector); there are fewer entries where there are fewer rows,
    and a table without rows has none. A length that `PARTS` does not divide gives parts that differ by
    one component. Equal rows count each. `code` has two hex digits a part; errors beyond
    64 bits count as the largest. Columns other than vec_id, embedding and label are ignored.
    """
    kept = whole_vectors(vectors, scale)
    lengths = kept.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not lengths:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")), []
    size = lengths[0]["size"]
    state = store(kept.where(F.size("x") == size))
    first = state.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()
    bounds = _bounds(size)
    start = np.array([r.x for r in first], np.int64).reshape(len(first), size)
    books = [Codebook(start[:, a:b]) for a, b in zip(bounds, bounds[1:])]
    passed = state
    for _ in range(rounds):
        passed = _round(passed if passed is state else passed.where("kind = 0"), books, bounds)
        books = _moved(passed, books)
    last = _round(passed if passed is state else passed.where("kind = 0"), books, bounds).where("kind = 0")
    return last.select("vec_id", "label", F.lower(F.hex("codes")).alias("code"), "error"), [b.entries for b in books]


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row that takes part.

    `label_error` sums errors over equal labels, nulls together.
    """
    made, books = compress(vectors)
    digest = hashlib.sha256(",".join(str(v) for book in books for v in book.flatten().tolist()).encode()).hexdigest()
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(TOP).cast("decimal(38,0)")).cast("bigint")
    sums = made.groupBy(F.col("label").alias("_same")).agg(total.alias("label_error"))
    return made.join(sums, F.col("label").eqNullSafe(F.col("_same")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
