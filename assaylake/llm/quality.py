"""Quality rules, line first: bad lines go, then documents that lost too much."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BLANKS, record, texts, type_of

SYMBOLS = "#*$%&|<>"
NAVIGATION = re.compile(r"[|»›«‹•·→]")
BOILERPLATE = re.compile(
    r"all rights reserved|terms of (?:use|service)|privacy policy|cookie|enable javascript|click here"
    r"|sign (?:in|up)\b|log ?in\b|subscribe|share (?:this|on)|powered by|copyright|©|read more|skip to content"
    r"|licensed under|released under the|lorem ipsum",
    re.IGNORECASE,
)


@dataclass(frozen=True)
class Rules:
    """Limits of the line and document rules.

    A line fails if more than `punctuation` of its characters are punctuation or symbols;
    if it has `separators` or more navigation marks, one for each four words at least; or
    if it has a boilerplate phrase and at most `boilerplate_words` words. A document is
    rejected if the failed lines hold more than `loss` of its characters in words.
    """

    punctuation: float = 0.2
    separators: int = 3
    boilerplate_words: int = 20
    loss: float = 0.5
    min_words: int = 50
    repeats: int = 50  # percent of words in repeated 3-word windows


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """1 for punctuation and symbols, 2 for white space of the word rule, else 0."""
    kinds = np.fromiter((unicodedata.category(chr(c))[0] in "PS" for c in range(0x110000)), np.uint8, 0x110000)
    kinds[[ord(c) for c in BLANKS]] = 2
    return kinds


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three that occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) >= 1 << 21:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(number) + ids[2:]
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= twice
    return int(covered.sum())


def line_verdicts(text: str, rules: Rules) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Lines, whether each fails, and its characters in words."""
    lines = text.split("\n")
    kinds = _classes()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    lengths = np.array([len(x) for x in lines])
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    marks = np.concatenate([[0], np.cumsum(kinds == 1)])
    blanks = np.concatenate([[0], np.cumsum(kinds == 2)])
    in_words = lengths - (blanks[ends] - blanks[starts])
    failed = (marks[ends] - marks[starts]) > rules.punctuation * np.maximum(in_words, 1)
    for i, line in enumerate(lines):
        if failed[i] or not in_words[i]:
            continue
        if len(NAVIGATION.findall(line)) >= rules.separators:
            failed[i] = 4 * len(NAVIGATION.findall(line)) >= len(line.split())
        elif BOILERPLATE.search(line):
            failed[i] = len(line.split()) <= rules.boilerplate_words
    return lines, failed & (in_words > 0), in_words


@dataclass(frozen=True)
class Report:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept: bool
    n_bad_lines: int
    clean: str


def examine(text: str, rules: Rules) -> Report:
    words = text.encode("utf-8", "replace").split()
    lines, failed, in_words = line_verdicts(text, rules)
    seen: set[str] = set()
    again = 0
    for line, size in zip(lines, in_words.tolist()):
        if size:
            again += line in seen
            seen.add(line)
    total = int(in_words.sum())
    repeats = repeated_words(words)
    base_failed = len(words) < rules.min_words or 100 * repeats > rules.repeats * len(words)
    lost = int(in_words[failed].sum())
    bad = int(failed.sum())
    return Report(
        len(words), total, sum(map(text.count, SYMBOLS)), again, repeats, base_failed,
        not base_failed and lost <= rules.loss * total, bad,
        "\n".join(x for x, f in zip(lines, failed.tolist()) if not f) if bad else text,
    )


def clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Counts, verdicts and the cleaned text of every row.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_bad_lines, clean_text. A null text counts as empty: it has no words and fails. Rows
    that repeat a doc_id or text each get their row; other columns are ignored.
    """
    names = [
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_bad_lines", "clean_text",
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [examine(t, rules) for t in texts(batch.column(1))]
            columns = [
                pa.array([getattr(r, f) for r in found], kind)
                for f, kind in [
                    *((n, pa.int64()) for n in names[1:6]), ("base_failed", pa.bool_()),
                    ("kept", pa.bool_()), ("n_bad_lines", pa.int64()), ("clean", pa.string()),
                ]
            ]
            yield record(names, [batch.column(0), *columns])

    layout = ", ".join(
        [f"doc_id {type_of(docs, 'doc_id')}", *(f"{n} bigint" for n in names[1:6]),
         "base_failed boolean, kept boolean, n_bad_lines bigint, clean_text string"]
    )
    return docs.select("doc_id", "text").mapInArrow(run, layout)
