"""Near copies: SimHash candidates and prefix filtering, both checked by exact Jaccard similarity.

SimHashes of the shingles within a few bits of each other (`simhash.links`) join most copies
at once. At the least similarity asked for, two of them differ in about 10 of 64 bits, which
no plan of parts can look up, so the other pairs come from prefix filtering: in one order of all shingles, two sets whose Jaccard similarity is at least `SIMILARITY`
share a shingle among the first n - ceil(SIMILARITY * n) + 1 of each. So sets that meet in
such a prefix are all the candidates there can be. The places of a shared shingle and bitmaps
of the sets bound what two sets can have in common; candidates that these bounds leave are
checked by their whole sets. Any order is right; shingles that are frequent in a sample, a
fixed part of a large table, come last, so that a common passage brings few sets together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free, record, store, texts, type_of
from .components import components
from .simhash import links

SHINGLE = 5
SIMILARITY = (4, 5)
SEED = 42
BITS = 3  # of the SimHashes that are looked up first
BLOCK = 512  # texts compared with one other in one group
SAMPLE = 10_000  # texts, or one in PART where that is more, in which frequent shingles are counted
PART = 8
SLOTS = 24  # bits at most of a slot in the table of frequent shingles


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def shingles(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Sorted different hashes of the word shingles; fewer words are one shingle."""
    if not words:
        return np.zeros(0, np.int64)
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(g, SEED) for g in grams]), ">i8").astype(np.int64))


def simhash(own: np.ndarray) -> int:
    """Signed 64-bit SimHash of a set of hashes."""
    ones = np.unpackbits(own.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own)).view(">i8")[0])


def prefix(own: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first shingles of a set, in the order of the ranks of their slots."""
    part, whole = SIMILARITY
    size = len(own) - -(-part * len(own) // whole) + 1 if len(own) else 0
    return own[np.lexsort((own, ranks[own & (len(ranks) - 1)]))[:size]]


def bitmap(own: np.ndarray) -> bytes:
    """A bit for each slot of a set of hashes, one if an odd number is in it; slots are a power of two, no fewer than hashes."""
    slots = max(64, 1 << max(0, len(own) - 1).bit_length())
    odd = np.bincount(own & (slots - 1), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_apart(one: bytes, other: bytes) -> int:
    """Of two sets with these bitmaps, no fewer hashes than this are in one of them only."""
    small, large = sorted((one, other), key=len)
    bits, slots = int.from_bytes(large, "little"), 8 * len(large)
    while slots > 8 * len(small):
        slots //= 2
        bits = (bits >> slots) ^ (bits & ((1 << slots) - 1))
    return (bits ^ int.from_bytes(small, "little")).bit_count()


def _arrays(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, sets)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))


def _ranks(docs: DataFrame, shingle: int, sample: int) -> np.ndarray:
    """Ranks by the low bits of a shingle: those found repeatedly in a sample of the texts come later.

    They steer cost only. The sample grows with the table, so that a shingle outside it is in
    few texts whatever their number; the ranks have a byte for each of 2 ** `SLOTS` slots at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(words_of(t), shingle) for t in texts(batch.column(0))]
            yield record(["token"], [np.concatenate([np.zeros(0, np.int64), *sets])])

    total = docs.count()
    ranks = np.zeros(1 << min(SLOTS, 4 + max(12, total.bit_length())), np.uint8)
    share = int(min(1.0, max(sample / max(1, total), 1 / PART)) * (1 << 30))
    picked = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share).distinct()
    counts = picked.mapInArrow(run, "token bigint").groupBy("token").count().where("count > 1")
    slot = F.col("token").bitwiseAND(F.lit(len(ranks) - 1)).cast("int").alias("slot")
    late = store(counts.groupBy(slot).agg(F.floor(F.log2(F.max("count")) * 4).cast("int").alias("rank")))
    found = late.toArrow()
    ranks[found["slot"].to_numpy()] = found["rank"].to_numpy()
    discard(late)
    return ranks


def _may_be_similar() -> F.Column:
    """Of two sets that meet in their first shared shingle: what can follow it in both is enough.

    The first shared shingle of similar sets always passes; a later one need not.
    """
    part, whole = SIMILARITY
    most = F.least(F.col("n") - F.col("place"), F.col("other_n") - F.col("other_place"))
    return most * (part + whole) >= (F.col("n") + F.col("other_n")) * part


def read_sets(docs: DataFrame, shingle: int = SHINGLE, sample: int = SAMPLE) -> DataFrame:
    """Stored, of every row: doc_id, text_hash, id (of its own), set (digest of its shingles),
    n (their number), fp (their SimHash), bits (their bitmap), tokens (their prefix), packed (the
    words, compressed)."""
    ranks = _ranks(docs, shingle, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pack = TaskContext.get().partitionId() << 33, zstandard.ZstdCompressor(level=3)
        for batch in batches:
            words = [words_of(t) for t in texts(batch.column(1))]
            sets = [shingles(w, shingle) for w in words]
            yield record(
                ["doc_id", "text_hash", "id", "set", "n", "fp", "bits", "tokens", "packed"],
                [
                    batch.column(0), batch.column(2), np.arange(at, at + len(sets)),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int32()), pa.array(map(simhash, sets), pa.int64()),
                    pa.array(map(bitmap, sets), pa.binary()), _arrays([prefix(s, ranks) for s in sets]),
                    pa.array([pack.compress(b" ".join(w)) for w in words], pa.binary()),
                ],
            )
            at += len(sets)

    layout = (
        f"doc_id {type_of(docs, 'doc_id')}, text_hash bigint, id bigint, set binary, n int, fp bigint, "
        "bits binary, tokens array<bigint>, packed binary"
    )
    return store(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, layout))


def _plausible(pairs: DataFrame, made: DataFrame) -> DataFrame:
    """The pairs (u, v) of row ids that the bitmaps of their sets do not rule out, once each."""
    part, total = SIMILARITY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [
                (n + m - least_apart(a, b)) * (part + total) >= 2 * (n + m) * part
                for n, m, a, b in zip(*(c.to_pylist() for c in batch.columns[2:]))
            ]
            yield record(["u", "v"], batch.select(["u", "v"]).filter(pa.array(left, pa.bool_())).columns)

    u, v = (made.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}")) for k in "uv")
    met = pairs.distinct().join(u, "u").join(v, "v").select("u", "v", "n_u", "n_v", "bits_u", "bits_v")
    return met.mapInArrow(run, "u bigint, v bigint")


def verified(pairs: DataFrame, made: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Of the pairs (u, v) of row ids those whose sets are similar enough, stored.

    Bitmaps, of about an eighth of a byte a shingle, rule out most others first. Texts travel to the rows they are compared with: those of all u of one v meet in groups
    of about `BLOCK`, each with v's own, so no task holds a hot v's partners.
    """
    part, total = SIMILARITY
    pairs = store(_plausible(pairs, made))
    sizes = pairs.groupBy("v").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int")
    dealt = pairs.join(sizes, "v").select("v", block.alias("block"), "u")
    own = sizes.select("v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("v").alias("u"))
    sent = dealt.union(own).join(made.select(F.col("id").alias("u"), "packed"), "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, key, other = zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            us, vs = [], []
            for v, block, u, packed in zip(*(c.to_pylist() for c in batch.columns)):
                mine = shingles(unpack.decompress(packed).split(b" ") if packed else [], shingle)
                if u == v:
                    key, other = (v, block), mine
                elif (v, block) == key:
                    shared = len(np.intersect1d(mine, other, assume_unique=True))
                    if shared * (part + total) >= (len(mine) + len(other)) * part:
                        us.append(u)
                        vs.append(v)
            yield record(["u", "v"], [pa.array(us, pa.int64()), pa.array(vs, pa.int64())])

    grouped = (
        sent.select("v", "block", "u", "packed").repartition("v", "block")
        .sortWithinPartitions("v", "block", F.col("u") != F.col("v"))
    )
    found = store(grouped.mapInArrow(run, "u bigint, v bigint"))
    discard(pairs)
    return found


def similar_sets(made: DataFrame, shingle: int = SHINGLE, hot: int = 64) -> tuple[DataFrame, DataFrame]:
    """(set, its leader of every set, the least row id; node, component of every leader that has a near copy).

    Rows of equal sets meet by it and are never paired. Sets of near SimHashes are compared
    first. In shingles of more than `hot` sets one set is then compared with all others; sets
    that this joins need no further comparison, and all other pairs are compared then.
    """
    leaders = store(made.groupBy("set").agg(F.min("id").alias("id")))
    rows = made.join(leaders.select("id"), "id", "left_semi")
    prints = store(rows.where("n > 0").select("id", "fp"))
    first = store(prints.groupBy("fp").agg(F.min("id").alias("v")))
    near = links(first.select("fp"), BITS)
    own = prints.join(first, "fp").where("id <> v").select(F.col("id").alias("u"), "v")
    across = near.join(first.select(F.col("fp").alias("u"), F.col("v").alias("_u")), "u")
    across = across.select("_u", F.col("v").alias("fp")).join(first, "fp")
    across = across.select(F.greatest("_u", "v").alias("u"), F.least("_u", "v").alias("v"))
    edges = verified(own.union(across), made, shingle)
    discard(prints, first)

    tokens = rows.select(F.posexplode("tokens").alias("place", "token"), "id", "n")
    counts = store(tokens.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1"))
    tokens = store(tokens.join(counts, "token"))
    discard(counts)

    def still_open(joined: DataFrame) -> DataFrame:
        """The tokens whose sets are not all joined yet, with the sets' labels."""
        named = tokens.join(joined, tokens["id"] == joined["node"], "left").select(
            "token", "id", "n", "place", "sets", F.coalesce("component", "id").alias("label")
        )
        several = named.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b")
        return store(named.join(several.select("token"), "token"))

    joined = store(components(edges))
    open_tokens = still_open(joined)
    for salt in range(2):
        large = open_tokens.where(F.col("sets") > hot)
        order = F.xxhash64("id", F.lit(salt)).alias("_o")
        hubs = store(
            large.groupBy("token").agg(F.min(F.struct(order, "id", "n", "place", "label")).alias("h"))
            .select(
                "token", F.col("h.id").alias("v"), F.col("h.n").alias("other_n"), F.col("h.place").alias("other_place"),
                F.col("h.label").alias("other_label"),
            )
        )
        if hubs.isEmpty():
            break
        star = large.join(hubs, "token").where("id <> v and label <> other_label").where(_may_be_similar())
        found = verified(star.select(F.greatest("id", "v").alias("u"), F.least("id", "v").alias("v")), made, shingle)
        before = edges, joined, open_tokens, found, hubs
        edges = store(edges.union(found))
        joined = store(components(edges))
        open_tokens = still_open(joined)
        discard(*before)
    other = open_tokens.select(
        "token", F.col("id").alias("v"), F.col("n").alias("other_n"), F.col("place").alias("other_place"),
        F.col("label").alias("other_label"),
    )
    rest = open_tokens.join(other, "token").where("id > v and label <> other_label").where(_may_be_similar())
    found = verified(rest.select(F.col("id").alias("u"), "v"), made, shingle)
    discard(tokens, open_tokens)
    whole = components(edges.union(found))
    discard(edges, found)
    return leaders, whole


def near_copies(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, component_id, n_equal, kept of every different (doc_id, text).

    `component_id` is the smallest doc_id reachable over similar texts, null ids last, and
    `kept` marks the one of its group that stays: of the smallest doc_id, and of equal ones
    of the smallest text_hash. `n_equal` rows have this doc_id and text. Texts without
    words, null ones too, are similar to each other.
    """
    made = read_sets(docs, shingle)
    leaders, joined = similar_sets(made, shingle)
    grouped = leaders.join(joined, leaders["id"] == joined["node"], "left").select(
        "set", F.coalesce("component", "id").alias("group")
    )
    rows = made.groupBy("doc_id", "text_hash", "set").agg(F.count("*").alias("n_equal"))
    rows = store(rows.join(grouped, "set").select("doc_id", "text_hash", "n_equal", "group"))
    discard(made, leaders)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = rows.groupBy("group").agg(F.min(key).alias("first"))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    return rows.join(first, "group").select(
        "doc_id", "text_hash", F.col("first.doc_id").alias("component_id"), "n_equal", same.alias("kept")
    )


def one_of_each(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of `docs` that stay when one row of each group of near copies does.

    All columns stay as they are. Of rows that repeat both doc_id and text any one stays.
    """
    groups = store(near_copies(docs, shingle))
    near_id, near_hash = free(docs, "_near_id"), free(docs, "_near_hash")
    hashed = F.xxhash64("text")

    def among(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias(near_id), F.col("text_hash").alias(near_hash))
        return rows.join(keys, F.col("doc_id").eqNullSafe(F.col(near_id)) & (hashed == F.col(near_hash)), how)

    left = among(docs, groups.where("not kept"), "left_anti")
    repeated = groups.where("kept and n_equal > 1")
    if repeated.isEmpty():
        return left
    picked = among(left, repeated, "left_semi").withColumn(near_hash, hashed).dropDuplicates(["doc_id", near_hash])
    return among(left, repeated, "left_anti").unionByName(picked.drop(near_hash))
