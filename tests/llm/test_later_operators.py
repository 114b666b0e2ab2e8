"""Vector codes, alignment of tokenizers and order-sensitive fingerprints against brute force."""

import hashlib
import math
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from assaylake.llm import alignment, codes, orderhash, pieces, queries
from assaylake.llm.common import prepare

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def run(df):
    return [r.asDict() for r in df.collect()]


# --- vector codes ----------------------------------------------------------------------------------------


def brute_codes(rows, entries=256, rounds=4):
    """{vec_id: (code, error)}, entries by part, of (vec_id, whole vector) rows in order."""
    size = len(rows[0][1])
    cuts = [size * i // 4 for i in range(5)]
    books = [[x[a:b] for _, x in rows[:entries]] for a, b in zip(cuts, cuts[1:])]

    def given(part, x):
        own = x[cuts[part] : cuts[part + 1]]
        return min((sum((p - q) ** 2 for p, q in zip(own, e)), i) for i, e in enumerate(books[part]))

    for _ in range(rounds):
        found = [[given(p, x) for _, x in rows] for p in range(4)]
        for p in range(4):
            for e in range(len(books[p])):
                mine = [x[cuts[p] : cuts[p + 1]] for (_, x), (_, i) in zip(rows, found[p]) if i == e]
                if mine:
                    books[p][e] = [sum(v) // len(mine) for v in zip(*mine)]
    out = []
    for vec_id, x in rows:
        best = [given(p, x) for p in range(4)]
        out.append((vec_id, "".join(f"{i:02x}" for _, i in best), sum(d for d, _ in best)))
    return out, books


@pytest.fixture
def vectors(spark):
    prepare(spark)

    def make(*rows):
        full = [(i, e, label, "x", "y") for i, e, label in rows]
        return spark.createDataFrame(full, "vec_id bigint, embedding array<double>, label int, code string, x string")

    return make


def test_codes_equal_brute_force(vectors):
    random = np.random.default_rng(5)
    centres = random.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + random.normal(scale=0.02, size=8)).round(2).tolist(), i % 3) for i in range(150)]
    made, books = codes.compress(vectors(*rows), entries=20)
    whole = [(i, [math.floor(1024 * v) for v in e]) for i, e, _ in rows]
    true, entries = brute_codes(whole, entries=20)
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in run(made)) == true
    assert [b.tolist() for b in books] == entries


@pytest.mark.parametrize("spread,scale", [(3, 1), (40, 1), (3, 10**9)])
def test_rings_lose_no_entry(spread, scale):
    """Small whole numbers make many ties; large ones take the exact path."""
    random = np.random.default_rng(spread)
    points = random.integers(-spread, spread + 1, (600, 4)) * scale
    entries = points[:50].copy()
    book = codes.Codebook(entries)
    code, least = codes.nearest(points, book, None)
    radii = [max((int(d) for d, c in zip(least, code) if c == e), default=-1) for e in range(50)]
    moved = entries + random.integers(-1, 2, entries.shape) * scale
    shifts = [int(s) for s in codes._own(moved, entries)]
    after = codes.balls(moved, radii, shifts)
    got, apart = codes.nearest(points, after, code)
    true = [min((sum(int(a - b) ** 2 for a, b in zip(p, e)), i) for i, e in enumerate(moved)) for p in points]
    assert [(int(d), int(c)) for d, c in zip(apart, got)] == true
    if spread == 40:
        assert sum(map(len, after.near)) < 50 * 49


def test_code_edges(vectors):
    nan, inf = float("nan"), float("inf")
    rows = [
        (7, [0.5, 0.25, 1.0, -0.001], None), (7, [0.5, 0.25, 1.0, -0.001], None), (None, [1.0, 0.0, 0.0, 0.0], 2),
        (1, None, 1), (2, [0.1, None, 0.1, 0.1], 1), (3, [nan, 0.0, 0.0, 0.0], 1), (4, [inf, 0.0, 0.0, 0.0], 1),
        (5, [0.1, 0.2], 1), (6, [], 1), (9, [1e300, -1e300, 0.0, 0.0], 2),
    ]
    found = sorted(run(codes.report(vectors(*rows))), key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0))
    assert [r["vec_id"] for r in found] == [7, 7, 9, None]
    assert [r["error"] for r in found] == [0, 0, 0, 0] and len({r["codebooks_sha256"] for r in found}) == 1
    assert [r["code"] for r in found[:2]] == ["00000000", "00000000"]
    uneven = run(codes.report(vectors(*[(i, [i / 7] * 5, None) for i in range(5)])))
    true, _ = brute_codes([(i, [math.floor(1024 * (i / 7))] * 5) for i in range(5)])
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in uneven) == true
    assert run(codes.report(vectors((1, None, 1)))) == []
    assert run(codes.report(vectors((1, None, 1)).limit(0))) == []
    assert [r["code"] for r in run(codes.report(vectors((1, [], 1), (2, [], 1))))] == ["00000000"] * 2


def test_label_errors_add_up(spark, data):
    found = queries.op11_codes(spark, data).join(
        spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "label"), "vec_id"
    ).collect()
    sums = Counter()
    for r in found:
        sums[r.label] += r.error
    assert found and all(r.label_error == sums[r.label] for r in found)


# --- alignment of tokenizers -------------------------------------------------------------------------------


def brute_alignment(texts):
    """Rows as in the report, one pair of tokens at a time, with the library's own encoder."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    left = Tokenizer.from_file(A)
    left.encode_special_tokens = True
    right = SentencePieceProcessor(model_file=B)
    letters = alignment._byte_letters()

    def ends(pieces):
        out, at = [], 0
        for p in pieces:
            at += len(p)
            out.append(at)
        return out

    rows, counts = [], Counter()
    for text in texts:
        tokens = None
        if text:
            a, b = left.encode(" " + text, add_special_tokens=False).ids, right.encode(text)
            a_bytes = [bytes(letters[c] for c in left.id_to_token(i)) for i in a]
            b_bytes = [
                bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i)
                else right.id_to_piece(i).replace("▁", " ").encode() for i in b
            ]
            if b"".join(a_bytes) == (" " + text).encode() == b"".join(b_bytes):
                tokens = a, b, ends(a_bytes), ends(b_bytes)
        links, groups = [], []
        if tokens:
            a, b, a_ends, b_ends = tokens
            cuts = sorted(set(a_ends) & set(b_ends))
            last = 0
            for cut in cuts:
                groups.append(
                    ",".join(str(i) for i, e in zip(a, a_ends) if last < e <= cut) + "|"
                    + ",".join(str(i) for i, e in zip(b, b_ends) if last < e <= cut)
                )
                last = cut
            links = [(i, j) for i, e in zip(a, a_ends) for j, f in zip(b, b_ends) if e == f]
        counts.update(links)
        rows.append((tokens, groups, links))
    top = Counter()
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    return [
        (
            len(t[0]) if t else 0, len(t[1]) if t else 0, len(groups), len(links),
            sum(counts[i, j] == top[j] for i, j in links), sum(counts[p] for p in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if t else "",
        )
        for t, groups, links in rows
    ]


TEXTS = [
    "A plain text, with words.", "<|endoftext|> and <s></s> <unk> <0x41>", "a▁b", "naïve Ωmega ünïcödé", "😀🫠 \U0001f9ff ɑ",
    "  two  blanks   three ", "\n\n\ttabs\r\n", "同じ文字列", "A plain text, with words.", "", None, "x", " ", "ˀ ᲀ Ა Ꞻ ͸",
    "longwordlongword" * 60, "été " * 900, "1234567890 3.14159", "  thin",
]


def columns(found):
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return {r["doc_id"]: tuple(r[n] for n in names) for r in found}


@pytest.mark.parametrize("ranks", [None, RANKS])
def test_alignment_equals_brute_force(docs, ranks):
    rows = docs(*[(i, t) for i, t in enumerate(TEXTS)])
    found = columns(run(alignment.report(rows.repartition(3), A, B, ranks)))
    assert found == dict(enumerate(brute_alignment(TEXTS)))
    assert found[2] == (0, 0, 0, 0, 0, 0, "") and found[0][2] > 0


def test_alignment_of_a_table(spark, data, monkeypatch):
    texts = dict(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").where("doc_id % 5 = 0").collect())
    ids = sorted(texts)
    docs = spark.createDataFrame([(i, texts[i]) for i in ids], "doc_id bigint, text string")
    found = columns(run(alignment.report(prepare(spark) and docs, A, B, RANKS)))
    assert found == dict(zip(ids, brute_alignment([texts[i] for i in ids])))
    assert queries.op12_alignment(spark, data).count() == spark.read.parquet(f"{data}/documents.parquet").count()


@pytest.mark.parametrize("stretch", [1, 2, 7, 512])
def test_lockstep_with_any_stretch(stretch):
    random = np.random.default_rng(stretch)
    a_ends, b_ends, starts, base = [], [], [0], 0
    for _ in range(40):
        size = int(random.integers(1, 60))
        for ends in (a_ends, b_ends):
            inner = np.flatnonzero(random.random(size - 1) < random.random()) + 1 if size > 1 else []
            ends.extend(base + int(e) for e in [*inner, size])
        base += size
        starts.append(len(a_ends))
    a_cut, b_cut = alignment.lockstep(np.array(a_ends), np.array(b_ends), np.array(starts), stretch)
    common = set(a_ends) & set(b_ends)
    assert a_cut.tolist() == [e in common for e in a_ends] and b_cut.tolist() == [e in common for e in b_ends]


def test_small_blocks_change_nothing(spark):
    tools = alignment.load(A, B, RANKS)
    whole = alignment.Slice(TEXTS, tools)
    parts = [alignment.Slice([t], tools) for t in TEXTS]
    assert whole.groups == [p.groups[0] for p in parts]
    assert whole.pairs.tolist() == [k for p in parts for k in p.pairs.tolist()]
    places = np.array([5, 0, 5, 900_000, 2])
    assert alignment._unpacked(alignment._packed(places), 5).tolist() == sorted(places.tolist())


def test_alignment_edges(docs, odd):
    found = run(alignment.report(odd, A, B, RANKS))
    assert sorted(r["doc_id"] for r in found) == [1, 2, 3, 4, 5, 5, 6]
    assert all(r["n_a"] == 0 and r["groups_sha256"] == "" for r in found if r["doc_id"] < 3)
    assert len({r["groups_sha256"] for r in found if r["doc_id"] in (4, 6)}) == 1
    assert all(r["n_groups"] == r["n_links"] <= min(r["n_a"], r["n_b"]) for r in found)
    assert [r["doc_id"] for r in run(alignment.report(docs((None, "a b"), (None, "c")), A, B))] == [None, None]
    assert run(alignment.report(odd.limit(0), A, B)) == []


# --- order-sensitive fingerprints ---------------------------------------------------------------------------


MASK = 2**64 - 1


def brute_fingerprint(text, width=8, take=2, values=64):
    base, turn = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

    def mixed(v):
        v = (v ^ v >> 32) * turn & MASK
        v = (v ^ v >> 32) * turn & MASK
        return v ^ v >> 32

    width = min(width, len(text))
    if not width:
        return [0] * values
    kmers, seen, numbered = [], Counter(), []
    for i in range(len(text) - width + 1):
        rolled = width
        for c in text[i : i + width]:
            rolled = (rolled * base + ord(c)) & MASK
        kmers.append(mixed(rolled))
        n = seen[kmers[-1]]
        seen[kmers[-1]] += 1
        numbered.append(mixed((kmers[-1] + n * base) & MASK) if n else kmers[-1])
    out = []
    for j in range(values):
        point = j * (2**64 // values) + 2**63 // values
        chosen = sorted(sorted(range(len(kmers)), key=lambda i: (numbered[i] - point) & MASK)[:take])
        value = len(chosen)
        for i in chosen:
            value = mixed((value * base + kmers[i]) & MASK)
        out.append(value % 65535 + 1)
    return out


@pytest.mark.parametrize("text", ["", "a", "abc", "abcdefgh", "aaaaaaaaaaaaaaaaaaaa", "abab" * 30, "Some words, ünïcödé 😀, and again some words."])
def test_fingerprint_equals_brute_force(text):
    made = orderhash.fingerprint(text)
    assert made.tolist() == brute_fingerprint(text)
    assert orderhash.read(orderhash.written(made)).tolist() == made.tolist()


def test_neighbours_equal_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    rows = sorted(((r.doc_id, r.text or "") for r in rows), reverse=True)
    found = {r["doc_id"]: r for r in run(queries.op13_fingerprints(spark, data))}
    assert len(found) == len(rows)
    prints = {i: orderhash.fingerprint(t) for i, t in rows}
    for (i, text), (j, other) in zip(rows, [*rows[1:], rows[0]]):
        r, n = found[i], len(text)
        changed = text[: n - n // 3] + other[: n // 3]
        after = orderhash.fingerprint(changed)
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(changed.encode()).hexdigest())
        assert r["fingerprint"] == orderhash.written(prints[i]) and r["edited_fingerprint"] == orderhash.written(after)
        assert r["near_edited"] == (prints[i] == after).mean() and r["near_next"] == (prints[i] == prints[j]).mean()
    near = [r["near_edited"] for r in found.values() if r["n_chars"] > 300]
    assert np.mean(near) > 0.2 > 10 * np.mean([r["near_next"] for r in found.values() if r["n_chars"] > 300])


def test_order_counts_not_only_the_set():
    random = np.random.default_rng(1)
    parts = ["".join(random.choice(list("abcdefghij "), 400)) for _ in range(2)]
    own = orderhash.fingerprint(parts[0] + parts[1])
    swapped = orderhash.fingerprint(parts[1] + parts[0])
    one_letter = orderhash.fingerprint(parts[0][:200] + "X" + parts[0][201:] + parts[1])
    assert orderhash.likeness(own, one_letter) > 0.8
    assert 0.3 < orderhash.likeness(own, swapped) < 0.7  # the same k-mers but for seven


def test_fingerprint_edges(docs, odd):
    found = run(orderhash.compare_neighbours(odd))
    assert sorted(r["doc_id"] for r in found) == [1, 2, 3, 4, 5, 5, 6]
    by = {r["doc_id"]: r for r in found}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] == "0" * 256 and by[4]["fingerprint"] == by[6]["fingerprint"]
    assert by[2]["near_next"] == 1.0 and by[3]["near_next"] == 0.0  # 2 is followed by 1, 3 by 2
    assert by[1]["edited_sha256"] == hashlib.sha256(b"").hexdigest()
    one = run(orderhash.compare_neighbours(docs((None, "abcdef"))))
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one[0]["near_next"] == 1.0
    last = run(orderhash.compare_neighbours(docs((None, "nnnnnn"), (1, "abcdef"), (2, "uvwxyz"))))
    made = {r["doc_id"]: r["edited_sha256"] for r in last}
    assert made == {
        2: hashlib.sha256(b"uvwxab").hexdigest(), 1: hashlib.sha256(b"abcdnn").hexdigest(),
        None: hashlib.sha256(b"nnnnuv").hexdigest(),
    }
    assert run(orderhash.compare_neighbours(odd.limit(0))) == []
    plain = run(orderhash.fingerprints(odd.where(F.col("doc_id") == 4)))
    assert plain[0]["fingerprint"] == by[4]["fingerprint"]


# --- stages and long texts ------------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", ["-" * 1000, "-" * 20_000, "-=" * 3000, "a" * 5000, "ab" * 2500 + "-" * 2500])
def test_equal_paths_are_finished_one_by_one(chunk):
    model = pieces.load(B)
    start = time.process_time()
    found = pieces.chunk_nbest(model, chunk, 4)
    assert time.process_time() - start < 20
    assert len(found) == 4 and [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)


def test_stages_with_null_and_repeated_ids(spark, docs):
    long = " ".join(f"w{i}" for i in range(60))
    near = long.replace("w30 ", "v30 ")
    rows = docs(
        (1, long, "en", "a"), (1, long, "en", "a"), (1, near, "en", "a"), (None, long, "en", "a"), (None, "other words", "en", None),
        (None, "other words", "en", None), (2, "other words", "en", None), (3, None, "en", "a"), (4, "", "en", "a"),
    ).withColumns({n: F.lit("mine") for n in ("_key", "_copies", "_copy", "_near_id", "_near_hash")})
    left = queries.stage_near_duplicates(spark, rows, "")
    assert left.columns == rows.columns
    found = sorted(((r.doc_id, r.text) for r in left.collect()), key=repr)
    assert len(found) == 3 and found[1:] == [(2, "other words"), (3, None)] and found[0][0] == 1
    alone = queries.stage_near_duplicates(spark, rows.where("doc_id is null"), "").collect()
    assert sorted((r.doc_id, r.text) for r in alone if r.text) == [(None, "other words"), (None, long)]
    mixed = queries.stage_mix(spark, rows, "").collect()
    assert {(r.doc_id, r.text) for r in mixed} <= {(r.doc_id, r.text) for r in rows.collect() if r.text}
    words = [len(r.text.split()) for r in mixed]
    assert None in {r.doc_id for r in mixed} and sum(words) <= sum({(1, long): 60, (1, near): 60, (None, long): 60}.values()) + 60 + 4
    assert queries.stage_mix(spark, rows.limit(0), "").collect() == []
    assert queries.stage_near_duplicates(spark, rows.limit(0), "").collect() == []
