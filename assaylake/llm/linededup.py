"""Line dedup by pairwise alignment: patience diff of documents that share lines.

The first partner of a shared line is its first holder, the document of smallest id that
has it; nobody meets all holders of a common line for lines that go there. Within a pair the
lines that both documents hold exactly once are the anchors; patience diff aligns along
them, and the common blocks are deleted from the later document. Patience keeps one rising
order, so passages in another order than in the first holder stay at first: their lines
meet the further earlier holders in rounds, until they align or no holder is left. Of
holders with the same shared lines in the same order one is met.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import grouped, record, store, texts, type_of

SHINGLE = 5
REMOVED = pa.list_(pa.struct([("number", pa.int32()), ("hash", pa.int64())]))


def worded_lines(text: str) -> list[tuple[int, int, int]]:
    """(line number, hash, words) of the lines that have a word.

    Lines are equal if their words are; the hash is of the words joined by one blank.
    """
    out = []
    for number, line in enumerate(text.split("\n")):
        words = line.encode("utf-8", "replace").split()
        if words:
            digest = xxhash.xxh3_64_intdigest(b" ".join(words))
            out.append((number, digest - (digest >> 63 << 64), len(words)))
    return out


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence, rising in both places, of pairs sorted by the first."""
    tails: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        if k == len(tails):
            tails.append(b)
            at.append(i)
        else:
            tails[k], at[k] = b, i
        before.append(at[k - 1] if k else -1)
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def patience(left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of two sequences of line hashes.

    Equal ends are aligned first, then lines unique on both sides, then the gaps between
    them in the same way.
    """
    found: list[tuple[int, int]] = []
    todo = [(0, len(left), 0, len(right))]
    while todo:
        a, a_end, b, b_end = todo.pop()
        while a < a_end and b < b_end and left[a] == right[b]:
            found.append((a, b))
            a, b = a + 1, b + 1
        while a < a_end and b < b_end and left[a_end - 1] == right[b_end - 1]:
            a_end, b_end = a_end - 1, b_end - 1
            found.append((a_end, b_end))
        if a >= a_end or b >= b_end:
            continue
        once_a = Counter(left[a:a_end])
        once_b = Counter(right[b:b_end])
        place = {right[j]: j for j in range(b, b_end) if once_b[right[j]] == 1}
        anchors = _rising(
            [(i, place[left[i]]) for i in range(a, a_end) if once_a[left[i]] == 1 and left[i] in place]
        )
        if not anchors:
            continue
        found.extend(anchors)
        edges = [(a - 1, b - 1), *anchors, (a_end, b_end)]
        todo.extend(
            (i + 1, i2, j + 1, j2) for (i, j), (i2, j2) in zip(edges, edges[1:])
            if i + 1 < i2 and j + 1 < j2
        )
    return sorted(found)


def blocks_to_delete(
    words: dict[int, int], aligned: set[int], min_words: int
) -> list[int]:
    """Places of the runs of aligned lines that have at least `min_words` words."""
    out: list[int] = []
    run: list[int] = []
    for place in sorted(aligned):
        if run and place != run[-1] + 1:
            if sum(words[p] for p in run) >= min_words:
                out.extend(run)
            run = []
        run.append(place)
    if run and sum(words[p] for p in run) >= min_words:
        out.extend(run)
    return out


def deletions(docs: DataFrame, min_words: int = SHINGLE) -> DataFrame:
    """doc_id, lines (array of struct(number, hash)): the lines to delete from documents.

    A block counts if it has at least `min_words` words, over lines that follow each other
    when lines without words are left out.
    """
    kind = type_of(docs, "doc_id")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each different line of a document, with all its places."""
        for batch in batches:
            source, line, places, numbers, counts = [], [], [], [], []
            for row, text in enumerate(texts(batch.column(1))):
                own: dict[int, list[tuple[int, int]]] = {}
                size: dict[int, int] = {}
                for place, (number, digest, words) in enumerate(worded_lines(text)):
                    own.setdefault(digest, []).append((place, number))
                    size[digest] = words
                for digest, at in own.items():
                    source.append(row)
                    line.append(digest)
                    places.append([p for p, _ in at])
                    numbers.append([n for _, n in at])
                    counts.append(size[digest])
            yield record(
                ["doc_id", "line", "places", "numbers", "words"],
                [
                    batch.column(0).take(pa.array(source, pa.int64())), pa.array(line, pa.int64()),
                    pa.array(places, pa.list_(pa.int32())), pa.array(numbers, pa.list_(pa.int32())),
                    pa.array(counts, pa.int32()),
                ],
            )

    layout = f"doc_id {kind}, line bigint, places array<int>, numbers array<int>, words int"
    lines = store(docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(split, layout))
    # Stored, so that the join below can split the rows of a common line over tasks.
    shared = store(
        lines.groupBy("line")
        .agg(F.min(F.struct("doc_id", "places")).alias("first"), F.max("doc_id").alias("last"))
        .where("last > first.doc_id")
        .select("line", F.col("first.doc_id").alias("holder"), F.col("first.places").alias("theirs"))
    )
    met = lines.join(shared, "line").where("doc_id > holder")
    own = ["doc_id", "line", "places", "numbers", "words"]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a document; those without holder are all its lines that others hold earlier."""
        for rows in grouped(batches, ["doc_id"]):
            pairs: dict = {}
            words: dict[int, int] = {}
            number_of: dict[int, tuple[int, int]] = {}
            once: dict[int, int] = {}
            aligned: set[int] = set()
            for r in rows.to_pylist():
                aligned.update(r["aligned"] or ())
                for place, number in zip(r["places"], r["numbers"]):
                    words[place] = r["words"]
                    number_of[place] = (number, r["line"])
                if len(r["places"]) == 1:
                    once[r["places"][0]] = r["line"]
                if r["theirs"] is None:
                    continue
                mine, theirs = pairs.setdefault(r["holder"], (set(), {}))
                mine.update((place, r["line"]) for place in r["places"])
                for place in r["theirs"]:
                    theirs[place] = r["line"]
            for held, theirs in pairs.values():
                mine = sorted(held)
                other = [theirs[p] for p in sorted(theirs)]
                aligned.update(mine[j][0] for _, j in patience(other, [h for _, h in mine]))
            gone = blocks_to_delete(words, aligned, min_words)
            # Lines that could still go: in a run of shared lines with words enough.
            open_places = set(blocks_to_delete(words, set(words), min_words)) - set(gone)
            left = sorted({once[p] for p in open_places if p in once})
            if gone or left:
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id").combine_chunks().slice(0, 1),
                        pa.array([[{"number": n, "hash": h} for n, h in map(number_of.get, gone)]], REMOVED),
                        pa.array([sorted(aligned)], pa.list_(pa.int32())), pa.array([left], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "lines", "aligned", "left"],
                )

    done_layout = f"doc_id {kind}, lines array<struct<number:int,hash:bigint>>, aligned array<int>, left array<bigint>"

    def aligned_by(rows: DataFrame) -> DataFrame:
        picked = rows.select(*own, "holder", "theirs", "aligned").repartition("doc_id").sortWithinPartitions("doc_id")
        return store(picked.mapInArrow(align, done_layout))

    done = aligned_by(met.withColumn("aligned", F.lit(None).cast("array<int>")))
    rounds = [done]
    left = store(done.select("doc_id", F.explode("left").alias("line")))
    if left.isEmpty():
        return done.where(F.size("lines") > 0).select("doc_id", "lines")
    # Documents whose shared lines are the same in the same order align alike: of the holders of
    # a line the least of each such order is met, in growing numbers a round.
    at = F.transform("places", lambda p: F.struct(p.alias("place"), F.col("line").alias("line")))
    order = (
        lines.join(shared.select("line"), "line").groupBy("doc_id")
        .agg(F.sort_array(F.flatten(F.collect_list(at))).alias("all")).select("doc_id", F.xxhash64("all.line").alias("order"))
    )
    wanted = left.select("line").distinct()
    holders = lines.where(F.size("places") == 1).join(wanted, "line").join(shared.select("line", F.col("holder").alias("first")), "line")
    holders = holders.where("doc_id <> first").select("line", "doc_id").join(order, "doc_id")
    holders = holders.groupBy("line", "order").agg(F.min("doc_id").alias("holder"))
    by_line = Window.partitionBy("line").orderBy("holder")
    holders = store(holders.select("line", "holder", F.row_number().over(by_line).alias("rank")))
    low, high = 1, 2
    while True:
        later = left.join(holders.where(F.col("rank") >= low), "line").where("holder < doc_id")
        if later.isEmpty():
            break
        pairs = store(later.where(F.col("rank") < high).select("doc_id", "holder").distinct())
        theirs = lines.select(F.col("doc_id").alias("holder"), "line", F.col("places").alias("theirs"))
        state = rounds[-1].where(F.size("left") > 0).join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
        state = state.select("doc_id", "aligned")
        base = met.select(*own).join(state, "doc_id").withColumns(
            {"holder": F.lit(None).cast(kind), "theirs": F.lit(None).cast("array<int>")}
        )
        visits = met.select(*own).join(pairs, "doc_id").join(theirs, ["holder", "line"])
        visits = visits.withColumn("aligned", F.lit(None).cast("array<int>"))
        rows = base.select(*own, "holder", "theirs", "aligned").unionByName(visits.select(*own, "holder", "theirs", "aligned"))
        now = aligned_by(rows)
        # A document without a holder in this round has none in later ones either.
        rounds.append(now)
        left = store(now.select("doc_id", F.explode("left").alias("line")))
        low, high = high, 2 * high
    every = rounds[0].select("doc_id", "lines", F.lit(0).alias("round"))
    for number, more in enumerate(rounds[1:], 1):
        every = every.unionByName(more.select("doc_id", "lines", F.lit(number).alias("round")))
    last = every.groupBy("doc_id").agg(F.max_by("lines", "round").alias("lines"))
    return last.where(F.size("lines") > 0)


def without(text: str, gone: dict[int, int]) -> str:
    """The text without the lines numbered in `gone`, if their words hash as given there."""
    hashes = {n: h for n, h, _ in worded_lines(text)}
    lines = text.split("\n")
    return "\n".join(t for n, t in enumerate(lines) if n not in gone or hashes.get(n) != gone[n])


def dedup_lines(docs: DataFrame, min_words: int = SHINGLE) -> DataFrame:
    """All rows and columns of `docs`; `text` without deleted blocks, n_removed lines added.

    The later document of a pair is the one of larger doc_id. Null texts, documents without
    shared lines and rows with a null doc_id stay as they are. Rows that repeat a doc_id are
    one document: they are not compared with each other, and a deletion applies to each of
    them that has the line at the place. A column `n_removed` in `docs` is replaced.
    """
    kept = [c for c in docs.columns if c.lower() != "n_removed"]
    gone = deletions(docs, min_words).select(F.col("doc_id").alias("_gone_id"), F.col("lines").alias("_gone"))
    joined = docs.select(*kept).join(gone, F.col("doc_id") == F.col("_gone_id"), "left").drop("_gone_id")
    names = [*kept, "n_removed"]
    at_text = kept.index("text")

    def strike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            gone = columns.pop().to_pylist()
            made, removed = [], []
            for text, lines in zip(columns[at_text].to_pylist(), gone):
                if text is None or not lines:
                    made.append(text)
                    removed.append(0)
                    continue
                new = without(text, {x["number"]: x["hash"] for x in lines})
                made.append(new)
                removed.append(text.count("\n") - new.count("\n") + (new == ""))
            columns[at_text] = pa.array(made, pa.string())
            yield record(names, [*columns, pa.array(removed, pa.int64())])

    layout = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.drop("_gone").schema)
    return joined.mapInArrow(strike, f"{layout}, n_removed bigint")
