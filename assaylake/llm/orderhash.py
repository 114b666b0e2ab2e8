"""Document fingerprints by Order MinHash.

The k-mers of a text's code points are numbered by occurrence, so a repeated k-mer counts as
often as it occurs. Each of `VALUES` hash functions selects the `TUPLE` k-mers of smallest
hash, which are put back into the order of the text; the hash of their sequence is one value
of the fingerprint. Equal values therefore need equal k-mers in equal order: likeness follows
edit distance, which plain MinHash does not see.

The hash functions are the distances on a ring from `VALUES` fixed points to one hash of
the k-mer; the smallest are the next k-mers after the point, so one sort serves them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record, store, texts, type_of

WIDTH = 8
TUPLE = 2
VALUES = 64
PART_BYTES = 64 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xD6E8FEB86659FD93)
_POINTS = (np.arange(VALUES, dtype=np.uint64) * np.uint64(2**64 // VALUES)) + np.uint64(2**63 // VALUES)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _TURN
    values = (values ^ (values >> np.uint64(32))) * _TURN
    return values ^ (values >> np.uint64(32))


def _kmers(text: str, width: int) -> np.ndarray:
    """Hashes of the k-mers in order; a shorter text is one k-mer, an empty one has none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = len(points) - width + 1
    if size < 1:
        points, size, width = points, min(1, len(points)), len(points)
    rolled = np.full(size, np.uint64(width), np.uint64)
    for i in range(width):
        rolled = rolled * _BASE + points[i : i + size]
    return _mixed(rolled)


def fingerprint(text: str, width: int = WIDTH, take: int = TUPLE) -> np.ndarray:
    """`VALUES` numbers of 16 bits: 1 to 65535, or all 0 for a text without characters."""
    kmers = _kmers(text, width)
    if not len(kmers):
        return np.zeros(VALUES, np.uint16)
    order = np.argsort(kmers, kind="stable")
    ring = kmers[order]
    again = np.flatnonzero(ring[1:] == ring[:-1]) + 1
    if len(again):
        # The occurrence number is the place in the run of equal k-mers.
        heads = np.ones(len(ring), bool)
        heads[again] = False
        head = np.flatnonzero(heads)
        nth = again - head[np.searchsorted(head, again, side="right") - 1]
        ring = ring.copy()
        ring[again] = _mixed(ring[again] + nth.astype(np.uint64) * _BASE)
        by = np.argsort(ring, kind="stable")
        ring, order = ring[by], order[by]
    count = min(take, len(ring))
    chosen = (np.searchsorted(ring, _POINTS)[:, None] + np.arange(count)) % len(ring)
    places = np.sort(order[chosen], axis=1)
    values = np.full(VALUES, np.uint64(count), np.uint64)
    for i in range(count):
        values = _mixed(values * _BASE + kmers[places[:, i]])
    return (values % np.uint64(65535) + np.uint64(1)).astype(np.uint16)


def written(values: np.ndarray) -> str:
    return values.astype(">u2").tobytes().hex()


def read(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal values."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last third of the characters replaced by the first as many of `following`."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (4 hex digits a value) of every row; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield record(
                ["doc_id", "fingerprint"],
                [batch.column(0), pa.array([written(fingerprint(t)) for t in texts(batch.column(1))], pa.string())],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {type_of(docs, 'doc_id')}, fingerprint string")


_RESULT = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _row(text: str, own: np.ndarray, following: str, its: np.ndarray) -> tuple:
    changed = edited(text, following)
    altered = own if changed == text else fingerprint(changed)
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return len(text), sha, written(own), written(altered), likeness(own, altered), likeness(own, its)


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    One row for every row. The next document is the following one in descending doc_id, rows
    of equal doc_id by their text (null ones last of all ids); after the last one comes the
    first, which in a table of one row is the row itself. Null texts count as empty; two
    texts without characters are alike (1.0), one of them and another text are not (0.0).

    Rows are ordered in ranges of doc_id, and a task keeps one row at a time. The last row
    of a range is finished afterwards, with the first row of the next range that has any.
    """
    spark = docs.sparkSession
    kind_of = type_of(docs, "doc_id")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // PART_BYTES))
    order = [F.desc_nulls_last("doc_id"), F.asc_nulls_first("text")]
    ranged = docs.select("doc_id", "text").repartitionByRange(ranges, order[0]).sortWithinPartitions(*order)
    layout = (
        f"kind int, task int, doc_id {kind_of}, text string, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: finished rows; 1: the first row of the task; 2: its last."""
        task = TaskContext.get().partitionId()
        last = None

        def made(kind: int, ids: pa.Array, bodies: list | None, rows: list[tuple]) -> pa.RecordBatch:
            values = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2))]
            return record(
                ["kind", "task", "doc_id", "text", *_RESULT],
                [
                    np.full(len(ids), kind, np.int32), np.full(len(ids), task, np.int32), ids,
                    pa.array(bodies or [None] * len(ids), pa.string()), *values,
                ],
            )

        def open_row(text: str, own: np.ndarray) -> list[tuple]:
            return [(len(text), None, written(own), None, None, None)]

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, given = batch.column(0), texts(batch.column(1))
            prints = [fingerprint(t) for t in given]
            if last is None:
                yield made(1, ids.slice(0, 1), [given[0]], open_row(given[0], prints[0]))
            else:
                before, text, own = last
                yield made(0, before, None, [_row(text, own, given[0], prints[0])])
            if len(given) > 1:
                rows = [_row(*pair) for pair in zip(given, prints, given[1:], prints[1:])]
                yield made(0, ids.slice(0, len(rows)), None, rows)
            last = ids.slice(len(given) - 1), given[-1], prints[-1]
        if last is not None:
            ids, text, own = last
            yield made(2, ids, [text], open_row(text, own))

    passed = store(ranged.mapInArrow(run, layout), "kind")
    tasks = sorted((r["task"] for r in passed.where("kind = 1").select("task").collect()))
    done = passed.where("kind = 0").select("doc_id", *_RESULT)
    if not tasks:
        return done
    # One row for each range.
    after = spark.createDataFrame(list(zip(tasks, [*tasks[1:], tasks[0]])), "task int, after int")
    heads = passed.where("kind = 1").select(
        F.col("task").alias("after"), F.col("text").alias("its_text"), F.col("fingerprint").alias("its")
    )
    ends = passed.where("kind = 2").select("task", "doc_id", "text", "fingerprint").join(F.broadcast(after), "task").join(heads, "after")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(1, 5)]
            rows = [_row(t or "", read(f), u or "", read(g)) for t, f, u, g in zip(*columns)]
            values = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2))]
            yield record(["doc_id", *_RESULT], [batch.column(0), *values])

    result = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in done.schema)
    return done.unionByName(ends.select("doc_id", "text", "fingerprint", "its_text", "its").mapInArrow(finish, result))
