"""Texts with very many matches, more than 64 languages, vectors of unequal length."""

import random
import re
import time
import zlib

import numpy as np

from assaylake.llm import language, neighbours, pii


def run(df):
    return [r.asDict() for r in df.collect()]


def test_texts_of_very_many_matches(spark, docs):
    rng = random.Random(5)
    texts = [
        " ".join(str(rng.randint(10, 99)) for _ in range(40_000)),
        " é ".join(f"{rng.randint(1, 255)}.{rng.randint(0, 400)}.7.{i % 300}" for i in range(20_000)),
        ";".join(f"a{i}@b.org" for i in range(600)), "", None,
    ]
    scorer = pii.Scorer()
    run(pii.report(docs((9, "warm 1.2.3.4")), scorer))
    begin = time.time()
    found = {r["doc_id"]: r for r in run(pii.report(docs(*enumerate(texts)), scorer))}
    assert time.time() - begin < 30
    for number, text in enumerate(texts):
        spans = [
            f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text or "")
        ] + [
            f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", text or "")
            if all(int(p) <= 255 for p in m.group().split("."))
        ]
        assert found[number]["spans"] == ",".join(spans)


def test_context_of_matches(spark, docs):
    """Left and right of a candidate are the text's own characters around it."""
    text = "x" * 30 + " 1.2.3.4,5.6.7.8;" + "mail é a@b.org" + " 10.0.0.1" * 600
    wide = run(pii.with_candidates(pii.with_base(docs((1, text)))))[0]["_wide"]
    assert len(wide) >= 602
    for c in wide:
        assert text[c["start"] : c["end"]] == c["value"]
        assert c["left"] == text[max(0, c["start"] - pii.CONTEXT) : c["start"]]
        assert c["right"] == text[c["end"] : c["end"] + 2]


def test_redaction_of_many_matches(spark, docs):
    table = docs((1, "call a@b.org or c@d.org now"), (2, "none"), (3, None), (4, " ".join(["a@b.org"] * 700)))
    masked = {r["doc_id"]: r["text"] for r in run(pii.redact(table, pii.Scorer()))}
    assert masked == {1: "call [email] or [email] now", 2: "none", 3: None, 4: " ".join(["[email]"] * 700)}


def test_more_than_64_languages(spark, docs):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    known, rows = {}, []
    for number in range(130):
        words = ["".join(rng.choice(letters) for _ in range(6)) for _ in range(12)]
        known[f"l{number:03}"] = words
        rows += [(number * 100 + i, " ".join(rng.choice(words) for _ in range(30)), f"l{number:03}") for i in range(12)]
    table = docs(*rows)
    filters = language.learn(table)
    assert len(filters.languages) == 130 and filters.slots().shape == (3, 1 << 18)
    true = {doc: lang for doc, _, lang in rows}
    found = run(language.identify(table, filters))
    assert sum(r["lang_pred"] == true[r["doc_id"]] for r in found) >= 0.98 * len(rows)
    assert {r["lang_pred"] for r in found if r["lang_pred"] == true[r["doc_id"]]} >= {"l000", "l064", "l129"}


def test_filters_decide_like_exact_sets(spark, docs):
    """Bloom filters give the exact shares, within what false positives change."""
    rows = [(i, f"der hund und die katze {i % 7} lesen", "de") for i in range(40)]
    rows += [(100 + i, f"the dog and the cat {i % 5} read", "en") for i in range(40)]
    table = docs(*rows)
    grams = {"de": set(), "en": set()}
    for doc, text, lang in rows:
        if zlib.crc32(str(doc).encode()) % 4 != 2:
            grams[lang] |= set(language.gram_hashes([text])[0].tolist())
    for r in run(language.identify(table, language.learn(table))):
        text = next(t for d, t, _ in rows if d == r["doc_id"])
        hashes = language.gram_hashes([text])[0].tolist()
        shares = {lang: sum(h in of for h in hashes) / len(hashes) for lang, of in grams.items()}
        best = max(sorted(shares), key=shares.get)
        assert r["lang_pred"] == best and abs(r["score"] - shares[best]) < 0.05


def test_vectors_of_unequal_length(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(100 + i, rng.normal(size=3).tolist()) for i in range(20)]
    rows += [(200, []), (201, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = run(neighbours.nearest(table, factor=1.0))
    assert {r["query_id"] for r in found} == {0, 20, 40}
    for query in (0, 20, 40):
        scores = sorted(((-float(np.dot(rows[query][1], v)), i) for i, v in rows[:60] if i != query))[:20]
        mine = sorted((r for r in found if r["query_id"] == query), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in mine] == [i for _, i in scores]
