"""Near copies among texts that share passages: few candidates, no pair lost."""

import numpy as np

from assaylake.llm import queries, resemblance

from .test_text_operators import brute_kept


def test_texts_of_shared_passages_are_hardly_ever_compared(spark, docs, monkeypatch):
    """Every shingle is in many texts, so that no order of shingles keeps unlike texts apart."""
    random = np.random.default_rng(3)
    passages = [" ".join(f"p{p}w{i}" for i in range(20)) for p in range(12)]
    texts = {}
    for number in range(60):
        texts[number] = " ".join(passages[p] for p in random.choice(12, 6, replace=False))
    for number in range(0, 12, 2):
        texts[100 + number] = texts[number].replace("w7 ", "x7 ", 1)
    sent, store = [], resemblance.store

    def counted(df, *by):
        made = store(df, *by)
        if made.columns == ["u", "v"]:
            sent.append(made.count())
        return made

    monkeypatch.setattr(resemblance, "store", counted)
    left = queries.stage_near_duplicates(spark, docs(*texts.items()), "")
    true = brute_kept(texts)
    assert 40 < len(true) < 62
    assert sorted(r.doc_id for r in left.collect()) == true
    assert max(sent) < 2 * len(texts)


def test_bitmaps_never_rule_out_similar_sets():
    random = np.random.default_rng(4)
    for size in (0, 1, 3, 63, 64, 65, 200, 1025, 5000):
        own = np.unique(random.integers(-(1 << 63), 1 << 63, size))
        for changed in (0, 1, size // 9, size // 2):
            other = np.union1d(own[changed:], random.integers(-(1 << 63), 1 << 63, changed // 2))
            apart = resemblance.least_apart(resemblance.bitmap(own), resemblance.bitmap(other))
            assert apart == resemblance.least_apart(resemblance.bitmap(other), resemblance.bitmap(own))
            assert apart <= len(np.setxor1d(own, other))
    unlike = [resemblance.bitmap(random.integers(-(1 << 63), 1 << 63, n)) for n in (600, 700)]
    assert resemblance.least_apart(*unlike) * 9 > 1300
