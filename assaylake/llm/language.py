"""Language identification with language-bitmask n-gram filters.

A Bloom filter is kept bit-sliced: one slot holds a bit per language, so that a look-up of
a character 4-gram returns all languages that contain it. A text's hits are counted per
language, corrected for the filter's false positives, and the largest count decides.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_side
from .common import record, store, texts, type_of

GRAM = 4
SLICE = 1 << 18  # characters of texts that are hashed together
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """True for the code points that are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


# Odd multipliers, one per place of the n-gram, and two for the filter's hash functions.
PLACES = np.random.default_rng(11).integers(1, 1 << 62, GRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.random.default_rng(12).integers(1, 1 << 62, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_slices(batch: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, hashes, counts: the hash of the 4-gram around each letter, SLICE characters at a time.

    Texts are lower-cased and everything but letters counts as a blank. The n-gram of a
    letter starts one place before it, so a text has as many n-grams as letters. `rows` are
    the places in the batch of the texts in the slice, rising, and `counts` their letters
    there; a text that does not fit goes on in the next slice, so its row comes again.
    """
    rows: list[int] = []
    parts: list[str] = []
    size = 0
    for row, text in enumerate(batch):
        # One place before each own letter and three behind the last; lower-cased whole, as that looks around.
        padded = f" {text.lower()}   "
        begin, end = 1, len(padded) - 3
        while begin < end:
            upto = min(end, begin + SLICE - size)
            rows.append(row)
            parts.append(padded[begin - 1 : upto + 3])
            size += upto - begin
            begin = upto
            if size == SLICE:
                yield _hashed(rows, parts)
                rows, parts, size = [], [], 0
    if parts:
        yield _hashed(rows, parts)


def _hashed(rows: list[int], parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A slice: the letters of each part but for its first place and its last three."""
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), np.uint32)
    is_letter = _letters()[codes]
    plain = np.where(is_letter, codes, np.uint32(32))
    ends = np.cumsum([len(p) for p in parts])
    is_letter[np.concatenate([[0], ends[:-1]])] = False
    for place in (1, 2, 3):
        is_letter[ends - place] = False
    at = np.flatnonzero(is_letter)
    mixed = np.zeros(len(at), np.uint64)
    for place in range(GRAM):
        mixed += plain[at - 1 + place] * PLACES[place]
    mixed ^= mixed >> np.uint64(29)
    counts = np.diff(np.searchsorted(at, ends), prepend=0)
    return np.array(rows, np.int64), mixed, counts


def gram_hashes(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the 4-gram around each letter, and the number of letters of each text."""
    found, counts = [np.zeros(0, np.uint64)], np.zeros(len(batch), np.int64)
    for rows, hashes, times in gram_slices(batch):
        found.append(hashes)
        counts[rows] += times
    return np.concatenate(found), counts


@dataclass(frozen=True)
class Filters:
    """Slots with a bit per language, in as many words of 64 bits as it takes."""

    languages: tuple[str, ...]
    packed: bytes
    slot_bits: int

    def slots(self) -> np.ndarray:
        return _unpack(self.packed, self.slot_bits)


def _unpack(packed: bytes, slot_bits: int) -> np.ndarray:
    """One row of slots for each 64 languages."""
    return np.frombuffer(zlib.decompress(packed), np.uint64).reshape(-1, 1 << slot_bits)


def _positions(hashes: np.ndarray, slot_bits: int) -> list[np.ndarray]:
    return [(hashes * m) >> np.uint64(64 - slot_bits) for m in MIX]


def build(grams: dict[str, np.ndarray], slot_bits: int) -> Filters:
    """Filters that hold each language's n-gram hashes."""
    languages = tuple(sorted(grams))
    slots = np.zeros((max(1, -(-len(languages) // 64)), 1 << slot_bits), np.uint64)
    for number, language in enumerate(languages):
        for where in _positions(grams[language].astype(np.uint64), slot_bits):
            slots[number // 64, where] |= np.uint64(1 << number % 64)
    return Filters(languages, zlib.compress(slots.tobytes()), slot_bits)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, per_language: int = 4000, min_share: float = 1e-5, slot_bits: int = 18) -> Filters:
    """Fit the filters on about `per_language` labelled documents of each language at most.

    The sample holds the documents whose hash is below each language's share, so it does
    not depend on partitions and no language's documents meet in one task. A language's
    filter holds the n-grams that make up at least `min_share` of its sample, hence at most
    1 / min_share of them; only those reach the driver.
    """
    labelled = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    )
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    shares = labelled.groupBy("lang").agg((per_language / F.count("*")).alias("share"))
    # Broadcast where it is small, so that no text is moved by its language.
    sample = labelled.select("lang", "text", draw.alias("draw")).join(small_side(shares), "lang").where("draw < share").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for rows, hashes, counts in gram_slices(texts(batch.column(1))):
                of = np.repeat(langs[rows], counts)
                for lang in sorted(set(langs[rows])):
                    values, times = np.unique(hashes[of == lang], return_counts=True)
                    yield record(
                        ["lang", "gram", "times"],
                        [pa.array([lang] * len(values), pa.string()), values.view(np.int64), times],
                    )

    counted = store(
        sample.mapInArrow(count, "lang string, gram bigint, times bigint")
        .groupBy("lang", "gram").agg(F.sum("times").alias("times"))
    )
    totals = counted.groupBy("lang").agg(F.sum("times").alias("total"))
    frequent = counted.join(totals, "lang").where(F.col("times") >= min_share * F.col("total"))
    grams: dict[str, list[int]] = {}
    for row in frequent.select("lang", "gram").collect():
        grams.setdefault(row.lang, []).append(row.gram)
    return build({k: np.array(v, np.int64).view(np.uint64) for k, v in grams.items()}, slot_bits)


def identify(docs: DataFrame, filters: Filters, carry: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, and the column `carry` if named.

    `score` is the share of the text's n-grams in the language's filter after the
    correction. Texts that are null or have no letter get `und` and 0, as all texts do
    where no language was learnt; ties go to the name that sorts first. Repeated rows each
    get their row. Other columns are ignored.
    """
    languages, slot_bits = filters.languages, filters.slot_bits
    packed = base64.b64encode(filters.packed)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _unpack(base64.b64decode(packed), slot_bits)
        narrow = slots.astype(np.uint8) if len(languages) <= 8 else slots
        fills = [((slots[b // 64] >> np.uint64(b % 64)) & np.uint64(1)).mean() ** len(MIX) for b in range(len(languages))]
        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int64)
            hits = np.zeros((len(languages), batch.num_rows), np.int64)
            for rows, hashes, times in gram_slices(texts(batch.column(2))):
                first, second = _positions(hashes, slot_bits)
                ends = np.concatenate([[0], np.cumsum(times)])
                counts[rows] += times
                for bit in range(len(languages)):
                    if bit % 64 == 0:
                        masks = narrow[bit // 64][first] & narrow[bit // 64][second]
                    seen = (masks >> masks.dtype.type(bit % 64)) & masks.dtype.type(1)
                    hits[bit, rows] += np.diff(np.concatenate([[0], np.cumsum(seen, dtype=np.int64)])[ends])
            scores = np.zeros((len(counts), max(1, len(languages))))
            for bit, fill in enumerate(fills):
                share = hits[bit] / np.maximum(counts, 1)
                scores[:, bit] = np.clip((share - fill) / max(1e-9, 1 - fill), 0, 1)
            best = scores.argmax(axis=1)
            known = (counts > 0) & bool(languages)
            names = [languages[b] if k else UNKNOWN for b, k in zip(best, known)]
            top = np.where(known, scores[np.arange(len(best)), best], 0.0)
            yield record(
                ["doc_id", "held_out", "lang_pred", "score", *more],
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), top, *batch.columns[3:]],
            )

    more = [carry] if carry else []
    layout = [f"doc_id {type_of(docs, 'doc_id')}, held_out boolean, lang_pred string, score double"]
    layout += [f"`{c}` {type_of(docs, c)}" for c in more]
    picked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", *more)
    return picked.mapInArrow(predict, ", ".join(layout))
