"""Cross-tokenizer alignment: byte ranges of two tokenisations of the same texts, in lockstep.

One state vector holds an A and a B pointer of every document of a slice. Each step
compares the ends of the two tokens of all documents at once and advances the pointer whose
token ends first, or both where they end together: a link and a cut. Finished documents
leave the vector. Long documents enter as several stretches, whose first B token follows
from the byte at which the stretch begins.

Links are counted corpus-wide by pairs of ids. A block of documents keeps each of its pairs
once, so what meets the corpus's counts is pairs of blocks, not links.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record, store, texts, type_of

SLICE = 1 << 21  # characters tokenised together
BLOCK = 12 << 20  # characters whose pairs are counted together
STRETCH = 512  # A tokens of a document in one place of the state vector
MARK = "▁"


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level entries write bytes with: printable ones stand for
    themselves, the others, in order, for letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBpe:
    """A byte-level BPE tokenizer file, with the bytes of its entries.

    `ranks` names a file of the same vocabulary as ranks. It is used, being several times
    faster, for texts whose characters have had the same Unicode category since version
    3.2, on which the two libraries cannot differ; other texts take the tokenizer file.
    """

    def __init__(self, path: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = _byte_letters()
        special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.bytes[i] = entry.encode() if i in special else bytes(letters[c] for c in entry)
        self.ranked = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            own = {b: i for i, b in enumerate(self.bytes) if i not in special}
            with open(path, encoding="utf-8") as text:
                plain = not json.load(text).get("normalizer")
            if table == own and plain:
                self.ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
                old = unicodedata.ucd_3_2_0
                self.settled = frozenset(
                    c for c in map(chr, range(0x10000))
                    if old.category(c) == unicodedata.category(c) and old.category(c) not in ("Cn", "Cs")
                )

    def encode(self, batch: list[str]) -> list[list[int]]:
        if self.ranked is None:
            return [e.ids for e in self.tokenizer.encode_batch(batch, add_special_tokens=False)]
        found = [self.ranked.encode_ordinary(t) if self.settled.issuperset(t) else None for t in batch]
        open_ones = [i for i, ids in enumerate(found) if ids is None]
        if open_ones:
            for i, e in zip(open_ones, self.tokenizer.encode_batch([batch[i] for i in open_ones], add_special_tokens=False)):
                found[i] = e.ids
        return found


# Fixed value: the word pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Pieces:
    """A SentencePiece model, with the bytes of its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(MARK, " ").encode())

    def encode(self, batch: list[str]) -> list[list[int]]:
        return self.model.encode(batch, num_threads=1) if batch else []


@lru_cache(maxsize=4)
def load(a: str, b: str, ranks: str | None) -> tuple[ByteBpe, Pieces, list[bytes]]:
    """Both tokenizers, and the decimal form of ids with what follows them in a group."""
    left, right = ByteBpe(a, ranks), Pieces(b)
    forms = [b"%d%c" % (i, c) for i in range(len(left.bytes)) for c in b",|"]
    forms += [b"%d%c" % (i, c) for i in range(len(right.bytes)) for c in b",;"]
    return left, right, forms


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_starts: np.ndarray, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the A and of the B tokens that end together with one of the other side.

    Ends run on over the documents; `a_starts` holds the first A token of each document
    and, last, the number of tokens. Documents have tokens, and equal bytes on both sides.
    """
    a_cut, b_cut = np.zeros(len(a_ends), bool), np.zeros(len(b_ends), bool)
    if not len(a_ends):
        return a_cut, b_cut
    sizes = np.diff(a_starts)
    count = -(-sizes // stretch)
    first = np.repeat(a_starts[:-1], count)
    a = first + stretch * (np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count))
    a_stop = np.append(a[1:], len(a_ends))
    b = np.concatenate([[0], np.searchsorted(b_ends, a_ends[a[1:] - 1], side="right")])
    while len(a):
        left, right = a_ends[a], b_ends[b]
        together = left == right
        a_cut[a[together]] = True
        b_cut[b[together]] = True
        a = a + (left <= right)
        b = b + (right <= left)
        live = a < a_stop
        if not live.all():
            a, b, a_stop = a[live], b[live], a_stop[live]
    return a_cut, b_cut


class Slice:
    """Tokens, links and groups of the texts of one slice."""

    def __init__(self, batch: list[str], tools: tuple[ByteBpe, Pieces, list[bytes]]):
        left, right, forms = tools
        given = [i for i, t in enumerate(batch) if t]
        plain = [batch[i] for i in given]
        a_ids, b_ids = left.encode([" " + t for t in plain]), right.encode(plain)
        a_of, b_of = left.bytes.__getitem__, right.bytes.__getitem__
        good = []
        for at, text in enumerate(plain):
            whole = (" " + text).encode()
            if b"".join(map(b_of, b_ids[at])) == whole and b"".join(map(a_of, a_ids[at])) == whole:
                good.append(at)
        self.n_a, self.n_b = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
        self.n_groups = np.zeros(len(batch), np.int64)
        self.groups = [""] * len(batch)
        kept = [given[at] for at in good]
        self.n_a[kept], self.n_b[kept] = [len(a_ids[at]) for at in good], [len(b_ids[at]) for at in good]
        a_flat = np.fromiter(chain.from_iterable(a_ids[at] for at in good), np.int64)
        b_flat = np.fromiter(chain.from_iterable(b_ids[at] for at in good), np.int64)
        a_starts = np.concatenate([[0], np.cumsum(self.n_a[kept])])
        b_starts = np.concatenate([[0], np.cumsum(self.n_b[kept])])
        a_sizes, b_sizes = _sizes(left), _sizes(right)
        a_cut, b_cut = lockstep(np.cumsum(a_sizes[a_flat]), np.cumsum(b_sizes[b_flat]), a_starts)
        a_last, b_last = np.flatnonzero(a_cut), np.flatnonzero(b_cut)
        # Pair of ids of every link, and the first link of each text.
        self.pairs = a_flat[a_last] * len(right.bytes) + b_flat[b_last]
        at = np.zeros(len(batch) + 1, np.int64)
        ends = np.searchsorted(a_last, a_starts)
        self.n_groups[kept] = np.diff(ends)
        np.cumsum(self.n_groups, out=at[1:])
        self.starts = at
        # A tokens of a group, then its B tokens: where each stands in the written form.
        order = np.empty(len(a_flat) + len(b_flat), np.int64)
        a_group, b_group = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
        before = np.concatenate([[0], b_last + 1])
        order[np.arange(len(a_flat)) + before[a_group]] = 2 * a_flat + a_cut
        if len(b_flat):
            order[np.arange(len(b_flat)) + a_last[b_group] + 1] = 2 * len(left.bytes) + 2 * b_flat + b_cut
        form = forms.__getitem__
        for text, begin, end in zip(kept, (a_starts + b_starts)[:-1], (a_starts + b_starts)[1:]):
            written = b"".join(map(form, order[begin:end].tolist()))
            self.groups[text] = hashlib.sha256(written[:-1]).hexdigest()


def _sizes(tool: ByteBpe | Pieces) -> np.ndarray:
    if not hasattr(tool, "sizes"):
        tool.sizes = np.array([len(b) for b in tool.bytes], np.int64)
    return tool.sizes


def _packed(places: np.ndarray) -> bytes:
    """The places of a text's links, in no order: gaps of the sorted places, compressed."""
    gaps = np.diff(np.sort(places), prepend=0).astype("<i4")
    return pa.compress(gaps.tobytes(), codec="zstd", asbytes=True) if len(gaps) else b""


def _unpacked(data: bytes, count: int) -> np.ndarray:
    if not count:
        return np.zeros(0, np.int64)
    return np.cumsum(np.frombuffer(pa.decompress(data, 4 * count, codec="zstd", asbytes=True), "<i4").astype(np.int64))


def align(docs: DataFrame, a: str, b: str, ranks: str | None = None) -> DataFrame:
    """Tokens, groups and links of every text, and of its links' pairs of ids.

    Stored rows of `kind` 0: doc_id, n_a, n_b, n_groups, groups_sha256, block, links (packed
    places in the block's pairs); of kind 1, one for each block: block, keys and counts of
    its pairs. A key is A id * size of B's vocabulary + B id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = load(a, b, ranks)
        names = ["kind", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "block", "links", "keys", "counts"]
        task, number = TaskContext.get().partitionId(), 0
        ids: list[pa.Array] = []
        slices: list[Slice] = []

        def closed() -> Iterator[pa.RecordBatch]:
            pairs = np.concatenate([s.pairs for s in slices])
            keys, place, counts = np.unique(pairs, return_inverse=True, return_counts=True)
            block, links, at = (task << 32) + number, [], 0
            for s in slices:
                links.extend(_packed(place[at + x : at + y]) for x, y in zip(s.starts, s.starts[1:]))
                at += len(s.pairs)
            own = pa.concat_arrays(ids)
            size = len(own)
            lists = pa.list_(pa.int64())
            yield record(
                names,
                [
                    np.zeros(size, np.int32), own, np.concatenate([s.n_a for s in slices]),
                    np.concatenate([s.n_b for s in slices]), np.concatenate([s.n_groups for s in slices]),
                    pa.array([g for s in slices for g in s.groups], pa.string()), np.full(size, block, np.int64),
                    pa.array(links, pa.binary()), pa.nulls(size, lists), pa.nulls(size, lists),
                ],
            )
            long = pa.nulls(1, pa.int64())
            yield record(
                names,
                [
                    np.ones(1, np.int32), pa.nulls(1, own.type), long, long, long, pa.nulls(1, pa.string()),
                    np.array([block], np.int64), pa.nulls(1, pa.binary()),
                    pa.array([keys], lists), pa.array([counts.astype(np.int64)], lists),
                ],
            )

        size = 0
        for batch in batches:
            own, given = batch.column(0), texts(batch.column(1))
            at = 0
            while at < len(given):
                end, chars = at + 1, len(given[at])
                while end < len(given) and chars + len(given[end]) <= SLICE:
                    chars += len(given[end])
                    end += 1
                slices.append(Slice(given[at:end], tools))
                ids.append(own.slice(at, end - at))
                size, at = size + chars, end
                if size >= BLOCK:
                    yield from closed()
                    ids, slices, size, number = [], [], 0, number + 1
        if slices:
            yield from closed()

    return store(
        docs.select("doc_id", "text").mapInArrow(
            run,
            f"kind int, doc_id {type_of(docs, 'doc_id')}, n_a bigint, n_b bigint, n_groups bigint, "
            "groups_sha256 string, block bigint, links binary, keys array<bigint>, counts array<bigint>",
        ),
        "kind",
    )


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """key, n (links of the corpus that hold the pair), best (no pair of its B id has more)."""
    exploded = aligned.where("kind = 1").select(F.explode(F.arrays_zip("keys", "counts")).alias("p"))
    counts = store(exploded.groupBy(F.col("p.keys").alias("key")).agg(F.sum("p.counts").alias("n")))
    b = F.col("key") % b_size
    # One row for each id of B's vocabulary at most.
    tops = counts.groupBy(b.alias("b")).agg(F.max("n").alias("top"))
    return counts.join(F.broadcast(tops), b == F.col("b")).select("key", "n", (F.col("n") == F.col("top")).alias("best"))


def report(docs: DataFrame, a: str, b: str, ranks: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    Texts that are null, empty or not spelt by their tokens have zeros and an empty text.
    Each row counts, repeated and null ids too, as rows never meet by their id; other columns
    are ignored and an empty table gives no rows.
    """
    aligned = align(docs, a, b, ranks)
    counts = pair_counts(aligned, len(Pieces(b).bytes))
    pairs = aligned.where("kind = 1").select(F.col("block").alias("of"), F.posexplode("keys").alias("place", "key"))
    known = pairs.join(counts, "key").select("of", "place", "n", "best")
    rows = aligned.where("kind = 0").select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "block", "links")

    def summed(own: pa.Table, pairs: pa.Table) -> pa.Table:
        order = np.argsort(pairs["place"].to_numpy())
        n = pairs["n"].to_numpy()[order]
        best = pairs["best"].to_numpy()[order].astype(np.int64)
        sums, hits = [], []
        for data, count in zip(own["links"].to_pylist(), own["n_groups"].to_pylist()):
            places = _unpacked(data, count)
            sums.append(int(n[places].sum()))
            hits.append(int(best[places].sum()))
        return pa.table(
            {
                "doc_id": own["doc_id"], "n_a": own["n_a"], "n_b": own["n_b"], "n_groups": own["n_groups"],
                "n_links": own["n_groups"], "n_best": pa.array(hits, pa.int64()),
                "count_sum": pa.array(sums, pa.int64()), "groups_sha256": own["groups_sha256"],
            }
        )

    return rows.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(
        summed,
        f"doc_id {type_of(docs, 'doc_id')}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
        "count_sum bigint, groups_sha256 string",
    )
