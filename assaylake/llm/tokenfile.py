"""Token files: frequency-ranked ids in a byte-aligned code with separate control bytes.

A file is a row of blocks. A block has the ids of whole documents: a header, the doc_ids and
token counts, then the control bytes, which hold the byte length (1 to 4) of four values
each in two bits, and after them all data bytes. Ids are replaced by their frequency rank,
so that frequent ones take one byte. Decoding looks lengths up by control byte.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from .common import record, running_sums, store, texts

MAGIC = b"TIDS"
HEADER = struct.Struct("<4sIQQQ")  # magic, documents, values, control bytes, data bytes
CACHED = 800_000
JOINED = 64
# The tokenizer's own word rule for printable Latin-1 in lower case.
LATIN_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = values.astype("<u4")
    sizes = 1 + (values > 0xFF) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = sizes - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    used = np.arange(4) < sizes[:, None]
    return control.astype(np.uint8), values.view(np.uint8).reshape(-1, 4)[used]


def unpack(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The values again, by table look-up of the control bytes."""
    sizes = LENGTHS[control].reshape(-1)[:count]
    out = np.zeros((count, 4), np.uint8)
    out[np.arange(4) < sizes[:, None]] = data
    return out.view("<u4").reshape(-1)


def write_block(ids: list[np.ndarray], doc_ids: list[int | None], ranks: np.ndarray) -> bytes:
    sizes = np.array([len(i) for i in ids], np.int64)
    control, data = pack(ranks[np.concatenate(ids)] if len(ids) else np.zeros(0, np.uint32))
    known = np.array([d is not None for d in doc_ids], np.uint8)
    keys = np.array([d or 0 for d in doc_ids], np.int64)
    return b"".join(
        [
            HEADER.pack(MAGIC, len(ids), int(sizes.sum()), len(control), len(data)),
            keys.tobytes(), known.tobytes(), sizes.tobytes(), control.tobytes(), data.tobytes(),
        ]
    )


def read_blocks(content: bytes, ids_of: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a file's documents, in order."""
    at = 0
    while at < len(content):
        magic, docs, values, n_control, n_data = HEADER.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at += HEADER.size
        parts = []
        for kind, size in ((np.int64, docs), (np.uint8, docs), (np.int64, docs), (np.uint8, n_control), (np.uint8, n_data)):
            parts.append(np.frombuffer(content, kind, size, at))
            at += size * np.dtype(kind).itemsize
        keys, known, sizes, control, data = parts
        ids = ids_of[unpack(control, data, values)]
        ends = np.cumsum(sizes)
        for key, there, start, end in zip(keys.tolist(), known.tolist(), (ends - sizes).tolist(), ends.tolist()):
            yield (key if there else None), ids[start:end]


class Encoder:
    """Encodes texts with a tokenizer that drops white space, remembering words.

    Such a tokenizer never joins characters across a blank or line feed, so a text's ids
    are those of its parts; each part is encoded by the library once while remembered.
    Words of Latin-1 are cut further, where the tokenizer cuts them itself; `plain` is the
    same tokenizer for such parts, which are lower-cased and cut already.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values(), default=0) + 1
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.known: dict[str, bytes] = {"": b""}
        self.ends = np.zeros(size, bool)
        for token, number in vocabulary.items():
            self.ends[number] = token.endswith("</w>")

    def remember(self, words: list[str], joined: int) -> None:
        """Encode words, or, `joined` at a time, parts that are one word to the tokenizer.

        The last token of such a part carries the vocabulary's mark of a word's end.
        """
        tokenizer = self.plain if joined > 1 else self.tokenizer
        groups = [words[at : at + joined] for at in range(0, len(words), joined)]
        for at in range(0, len(groups), 512):
            some = groups[at : at + 512]
            made = tokenizer.encode_batch_fast([" ".join(g) for g in some], add_special_tokens=False)
            for group, encoding in zip(some, made):
                ids = np.array(encoding.ids, self.kind)
                ends = np.flatnonzero(self.ends[ids]) + 1
                if len(group) == 1:
                    self.known[group[0]] = ids.tobytes()
                elif len(ends) == len(group):
                    raw, size = ids.tobytes(), ids.itemsize
                    edges = [0, *(size * ends).tolist()]
                    for word, start, end in zip(group, edges, edges[1:]):
                        self.known[word] = raw[start:end]
                else:
                    self.remember(group, 1)

    def __call__(self, batch: list[str]) -> list[bytes]:
        parts = [t.replace("\n", " ").split(" ") for t in batch]
        if len(self.known) > CACHED:
            self.known = {"": b""}
        known = self.known
        found = [list(map(known.get, p)) for p in parts]
        gaps = [[i for i, ids in enumerate(f) if ids is None] for f in found]
        new = {p[i] for p, gap in zip(parts, gaps) for i in gap}
        cut = {
            w: LATIN_PARTS.findall(w.lower())
            for w in new if w.isprintable() and (w.isascii() or max(w) < "\u0100") and "<|" not in w
        }
        self.remember([w for w in new if w not in cut], 1)
        self.remember(list({p for c in cut.values() for p in c if p not in known}), JOINED)
        for word, c in cut.items():
            known[word] = known[c[0]] if len(c) == 1 else b"".join(map(known.__getitem__, c))
        for p, f, gap in zip(parts, found, gaps):
            for i in gap:
                f[i] = known[p[i]]
        return list(map(b"".join, found))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def encoded(docs: DataFrame, path: str, end: int) -> DataFrame:
    """doc_id (bigint), ids: unsigned ids as bytes, `end` appended; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        last = np.array([end], encode.kind).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [i + last for i in encode(texts(part.column(1)))]
                yield record(["doc_id", "ids"], [part.column(0), pa.array(made, pa.binary())])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, ids binary"
    )


def frequency_order(tokens: DataFrame, size: int, kind: type) -> tuple[np.ndarray, int]:
    """All ids from the most to the least frequent (ties to the smaller), and their count.

    The driver gets one row per id of the vocabulary at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                times += np.bincount(np.frombuffer(ids.as_buffer(), kind), minlength=size)
        there = np.flatnonzero(times)
        yield record(["id", "times"], [there, times[there]])

    rows = (
        tokens.select("ids").mapInArrow(count, "id bigint, times bigint")
        .groupBy("id").agg(F.sum("times").alias("times")).collect()
    )
    times = np.zeros(size, np.int64)
    for row in rows:
        times[row.id] = row.times
    return np.argsort(-times, kind="stable").astype(np.uint32), int(times.sum())


def write(tokens: DataFrame, folder: str, order: np.ndarray, total: int, kind: type,
          shard_tokens: int = 4_000_000, block_tokens: int = 500_000) -> DataFrame:
    """Write token files in ascending doc_id order to `folder`; returns shard, n_tokens.

    Each task writes one file under a name of its own and then moves it to its place, so a
    task that is run again, or twice, leaves the same file. Rows that repeat a doc_id come
    in order of their ids' bytes, null doc_ids first. A task holds one block.
    """
    ranks = np.empty(len(order), np.uint32)
    ranks[order] = np.arange(len(order), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        shard = TaskContext.get().partitionId()
        part = f"{root}/_{shard:08d}-{uuid.uuid4().hex}"
        written, doc_ids, ids, held = 0, [], [], 0
        files.create_dir(root, recursive=True)
        with files.open_output_stream(part) as out:
            for batch in batches:
                for doc_id, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                    doc_ids.append(doc_id)
                    ids.append(np.frombuffer(own.as_buffer(), kind))
                    held += len(ids[-1])
                    if held >= block_tokens:
                        out.write(write_block(ids, doc_ids, ranks))
                        written, doc_ids, ids, held = written + held, [], [], 0
            if ids:
                out.write(write_block(ids, doc_ids, ranks))
        files.move(part, f"{root}/shard-{shard:08d}.ids")
        yield record(["shard", "n_tokens"], [pa.array([shard], pa.int64()), pa.array([written + held], pa.int64())])

    shards = max(1, -(-total // shard_tokens))
    return (
        tokens.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "ids")
        .mapInArrow(run, "shard bigint, n_tokens bigint")
    )


def read(spark, folder: str, order: np.ndarray) -> DataFrame:
    """shard, doc_id, start (in the shard), n_tokens, ids_crc32 from the files."""
    ids_of = order.astype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = int(path.rsplit("shard-", 1)[1].split(".")[0])
                doc_ids, sizes, crcs = [], [], []
                for doc_id, ids in read_blocks(content.as_buffer(), ids_of):
                    doc_ids.append(doc_id)
                    sizes.append(len(ids))
                    crcs.append(zlib.crc32(ids.tobytes()))
                starts = np.cumsum(sizes, dtype=np.int64) - np.array(sizes, np.int64)
                yield record(
                    ["shard", "doc_id", "start", "n_tokens", "ids_crc32"],
                    [
                        pa.array([shard] * len(sizes), pa.int64()), pa.array(doc_ids, pa.int64()),
                        starts, pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()),
                    ],
                )

    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.ids").load(folder)
        .select("path", "content")
        .mapInArrow(run, "shard bigint, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    )


def write_and_read(docs: DataFrame, path: str, end: int = 2) -> DataFrame:
    """Encode `docs`, write the token files and report every document as read back.

    doc_id, start (ids of all documents before it), n_tokens, ids_crc32. An empty table
    gives no rows. The files stay in the cluster's shared folder.
    """
    spark = docs.sparkSession
    size = vocabulary_size(path)
    kind = np.uint16 if size <= 1 << 16 else np.uint32
    tokens = store(encoded(docs, path, end))
    order, total = frequency_order(tokens, max(size, end + 1), kind)
    if not total:  # not even an end id: no documents
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    folder = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    shards = store(write(tokens, folder, order, total, kind))
    offsets = running_sums(shards, [], "shard", "n_tokens")
    found = read(spark, folder, order)
    return found.join(offsets, "shard").select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
