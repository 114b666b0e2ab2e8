"""What the Python side of a task holds at once, and that cutting work into slices changes no result."""

import random
import tracemalloc

import numpy as np
import public_tokenizers as TOKENIZERS
import pyarrow as pa

from assaylake.llm import language, pieces


def predicted(monkeypatch, docs, filters):
    """The function that `identify` runs in tasks, here on one batch of texts."""
    table, kept = docs((1, "a")), []
    with monkeypatch.context() as patch:
        patch.setattr(type(table), "mapInArrow", lambda self, f, layout: kept.append(f))
        language.identify(table, filters)

    def run(some):
        batch = pa.RecordBatch.from_arrays(
            [pa.array(range(len(some)), pa.int64()), pa.array([False] * len(some)), pa.array(some, pa.string())],
            names=["doc_id", "held_out", "text"],
        )
        return [r for b in kept[0](iter([batch])) for r in b.to_pylist()]

    return run


def peak_mb(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def grams(text):
    """The definition, letter by letter."""
    padded = f" {text.lower()}   "
    plain = [ord(c) if c.isalpha() else 32 for c in padded]
    out = []
    for at in (i for i, c in enumerate(padded) if c.isalpha()):
        mixed = sum(plain[at - 1 + k] * int(p) for k, p in enumerate(language.PLACES)) % (1 << 64)
        out.append(mixed ^ mixed >> 29)
    return out


ODD = ["", "a", "der hund und die katze", " \n1", "ΟΔΟΣ ΣΑΣ", "İstanbul", "😀ab😀", "x" * 23, "the cat, the dog"]


def test_language_holds_a_slice_of_a_batch(monkeypatch, docs):
    draw = random.Random(3)
    some = ["".join(draw.choices("abcdefgh ", k=2500)) for _ in range(1024)]
    few = {lang: language.gram_hashes([text])[0] for lang, text in zip(("de", "en"), some)}
    run = predicted(monkeypatch, docs, language.build(few, 18))
    run(some[:1])
    assert peak_mb(lambda: run(some)) < 40
    one = ["".join(some)]  # a single long text
    assert peak_mb(lambda: run(one)) < 40


def test_slices_hash_as_whole_texts(monkeypatch, docs):
    texts = {"de": "der hund und die katze sind im haus", "en": "the cat and the dog are in the house"}
    filters = language.build({k: language.gram_hashes([t])[0] for k, t in texts.items()}, 12)
    run = predicted(monkeypatch, docs, filters)
    whole = run(ODD)
    assert [r["lang_pred"] for r in whole[:3]] == ["und", whole[1]["lang_pred"], "de"]
    for size in (1, 2, 5, 17):
        monkeypatch.setattr(language, "SLICE", size)
        assert run(ODD) == whole
        hashes, counts = language.gram_hashes(ODD)
        ends = np.cumsum(counts)
        assert [hashes[e - c : e].tolist() for e, c in zip(ends, counts)] == [grams(t) for t in ODD]


def test_pieces_hold_some_chunks_of_like_length():
    draw = random.Random(5)
    model = pieces.load(TOKENIZERS.path("piece_bpe_32k.model"))
    chunks = list({" " + "".join(draw.choices("abcdefghijklmnop", k=draw.randint(3, 6))) for _ in range(40_000)})
    chunks += [" " + "ab" * 23, " ☃x", "\n", "ab" * 20]
    found = []
    pieces.chunks_best(model, chunks[-4:])
    assert peak_mb(lambda: found.extend(pieces.chunks_best(model, chunks))) < 40
    some = [*range(0, len(chunks), 997), *range(len(chunks) - 4, len(chunks))]
    assert [found[i] for i in some] == [pieces.chunk_best(model, chunks[i].replace(" ", pieces.MARK)) for i in some]
