"""License scans: Dice coefficient over word bigrams against license templates, in SQL.

A text's units are its lines, its paragraphs of several lines and the whole. A unit is
normalised to lower-case words; a template is a candidate only if the unit's number of
bigrams lies within the bounds that the least coefficient allows. Notices inside longer
lines, or over several paragraphs of a larger text, are met by runs of words that begin and
end with a bigram of the template.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free

# License notices and texts, by SPDX identifier.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See "
        "the GNU General Public License for more details.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        'copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY '
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
]

BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR '
    "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
    "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER "
    "IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF"
    " THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse"
    " or promote products derived from this software without specific prior written permission."
)
ISC_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS '
    "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
    "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE"
    " OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
    "SOFTWARE."
)

# The longer texts above with what follows them.
FULL = [
    (name, " ".join((next(t for n, t in TEMPLATES if n == start and len(t) > 100), *more)))
    for name, start, more in (
        ("BSD-2-Clause", "BSD-2-Clause", (BSD_DISCLAIMER,)),
        ("BSD-3-Clause", "BSD-2-Clause", (BSD_THIRD, BSD_DISCLAIMER)),
        ("ISC", "ISC", (ISC_DISCLAIMER,)),
    )
]
TEMPLATES += FULL

NO_WORD = r"[^\p{L}\p{N}]+"


@dataclass(frozen=True)
class Template:
    license: str
    bigrams: tuple[str, ...]
    low: int
    high: int

    @property
    def lengths(self) -> tuple[int, ...]:
        """Lengths of runs that are compared, in bigrams."""
        n = len(self.bigrams)
        return tuple(sorted({self.low, (self.low + n) // 2, n, (n + self.high) // 2, self.high}))

    @property
    def anchors(self) -> list[list[str]]:
        """Groups of words, without common ones, of each of which a unit like this holds a word.

        A unit that reaches the least coefficient shares at least `low` bigrams, so it can't
        miss all of any `n - low + 1`; each group touches so many. Long words come first.
        """
        groups, group, met = [], [], set()
        for word in sorted({w for b in self.bigrams for w in b.split()}, key=lambda w: (-len(w), w)):
            group.append(word)
            met |= {b for b in self.bigrams if word in b.split()}
            if len(met) > len(self.bigrams) - self.low:
                groups.append(group)
                group, met = [], set()
        return groups


def compiled(templates: list[tuple[str, str]], least: float) -> list[Template]:
    """Templates with the sizes of units that can reach `least`: with c common bigrams of a
    and b, 2c / (a + b) is at most 2 min(a, b) / (a + b)."""
    out = []
    for name, text in templates:
        words = re.sub(r"[\W_]+", " ", text.lower()).split()
        pairs = tuple(sorted({f"{a} {b}" for a, b in zip(words, words[1:])}))
        n = len(pairs)
        if not n:
            raise ValueError(f"template of {name} has fewer than two words")
        low = math.ceil(n * least / (2 - least) - 1e-9)
        high = math.floor(n * (2 - least) / least + 1e-9)
        out.append(Template(name, pairs, low, high))
    return out


def _units(text: Column) -> Column:
    """struct(kind, number, text): lines, paragraphs of several lines, the whole."""

    def numbered(kind: int):
        return lambda t, i: F.struct(F.lit(kind).alias("kind"), i.alias("number"), t.alias("text"))

    paragraphs = F.transform(F.split(text, r"\n[\x20\x09\x0B-\x0D]*\n", -1), numbered(1))
    several = F.filter(paragraphs, lambda p: p["text"].contains("\n"))
    whole = F.when(
        F.size(paragraphs) > 1, F.array(F.struct(F.lit(2).alias("kind"), F.lit(0).alias("number"), text.alias("text")))
    ).otherwise(F.array().cast("array<struct<kind:int,number:int,text:string>>"))
    return F.concat(F.transform(F.split(text, "\n", -1), numbered(0)), several, whole)


def _with_runs(docs: DataFrame, keep: list[str], units: str, words: str, known: list[Template], least: float) -> DataFrame:
    """`keep` and `licenses`: the entries in `units`, and best runs of `words` for other licenses.

    A run begins and ends with a bigram of its template and spans at most one of the
    template's `lengths`. Only places after which `low` of its bigrams come soon enough
    begin one, so work is linear in the words and in the length of the templates met.
    """
    w, hits = F.col(words), free(docs, "_hits")
    met = sorted({b for t in known for b in t.bigrams})
    begun = sorted({b.split()[0] for b in met})
    in_any = sorted({w for b in met for w in b.split()})

    def pair(i: Column) -> Column:
        return F.concat_ws(" ", w[i], w[i + 1])

    vocabulary = free(docs, "_vocabulary")
    docs = docs.withColumn(vocabulary, F.array_intersect(w, F.array(*map(F.lit, in_any))))

    def may_hold(t: Template) -> Column:
        each = [F.arrays_overlap(vocabulary, F.array(*map(F.lit, group))) for group in t.anchors]
        return reduce(and_, each)

    places = F.filter(
        F.sequence(F.lit(0), F.size(w) - 2), lambda i: w[i].isin(begun) & pair(i).isin(met)
    )
    placed = F.transform(places, lambda i: F.struct(i.alias("place"), pair(i).alias("pair")))
    fits = (F.size(w) > 1) & reduce(or_, map(may_hold, known))
    docs = docs.withColumn(hits, F.when(fits, placed))
    own = [free(docs, f"_hits{k}") for k in range(len(known))]
    starts = [free(docs, f"_starts{k}") for k in range(len(known))]

    def of(t: Template) -> Column:
        return F.filter(hits, lambda p: p["pair"].isin(list(t.bigrams)))

    docs = docs.select("*", *[of(t).alias(c) for t, c in zip(known, own)])

    def dense(t: Template, column: str) -> Column:
        h = F.col(column)
        near = F.filter(
            F.sequence(F.lit(0), F.size(h) - t.low), lambda i: h[i + (t.low - 1)]["place"] - h[i]["place"] < t.high
        )
        return F.when(F.size(h) >= t.low, near)

    docs = docs.select("*", *[dense(t, c).alias(s) for t, c, s in zip(known, own, starts)])

    def best(t: Template, column: str, start: str) -> Column:
        h = F.col(column)

        def run(length: int):
            def at(i: Column) -> Column:
                first = h[i]["place"]
                following = F.sequence(i, F.least(i + (length - 1), F.size(h) - 1))
                inside = F.filter(following, lambda k: h[k]["place"] < first + length)
                bounds = F.struct(first.alias("first"), h[F.element_at(inside, -1)]["place"].alias("last"))
                common = F.size(F.array_distinct(F.transform(inside, lambda k: h[k]["pair"])))
                return F.struct(bounds.alias("run"), common.alias("common"))

            return at

        def scored(r: Column) -> Column:
            run = r["run"]
            size = F.size(F.array_distinct(F.transform(F.sequence(run["first"], run["last"]), pair)))
            score = F.when(size.between(t.low, t.high), 2.0 * r["common"] / (size + len(t.bigrams)))
            return F.struct(F.coalesce(score, F.lit(0.0)).alias("score"), (-run["first"]).alias("back"))

        runs = F.concat(*[F.transform(start, run(length)) for length in t.lengths])
        return F.array_max(F.transform(runs, scored))

    top = {}
    for t, c, s in zip(known, own, starts):
        top.setdefault(t.license, []).append(best(t, c, s))
    none = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back"))
    tops = F.array(
        *[
            F.struct(F.lit(name).alias("license"), F.array_max(F.array(none, *found)).alias("best"))
            for name, found in top.items()
        ]
    )
    shown = F.transform(units, lambda u: u["license"])
    entries = F.transform(
        F.filter(tops, lambda b: (b["best"]["score"] >= least) & ~F.array_contains(shown, b["license"])),
        lambda b: F.struct(
            F.lit(3).alias("kind"), (-b["best"]["back"]).alias("number"), b["best"]["score"].alias("score"),
            b["license"].alias("license"),
        ),
    )
    several = F.when(F.col(hits).isNull(), F.col(units)).otherwise(F.concat(F.col(units), F.array_sort(entries)))
    return docs.select(*keep, several.alias("licenses"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = 0.8) -> DataFrame:
    """All columns of `docs` and `licenses`: array of struct(kind, number, score, license).

    One entry for each unit whose best template reaches `least`, in the order of units; of
    equal templates the one whose name sorts last counts. `kind` is 0 for a line, 1 for a paragraph, 2 for
    the whole. Each license that no unit shows but a run of words does has one more entry, of kind 3, with
    the place of the best run's first word (the first of equal ones), in the order of places.
    Null and empty texts have none; a column `licenses` in `docs` is replaced.
    """
    known = compiled(TEMPLATES if templates is None else templates, least)
    keep = [c for c in docs.columns if c.lower() != "licenses"]
    low, high = min(t.low for t in known), max(t.high for t in known)

    def split(unit: Column) -> Column:
        plain = F.trim(F.regexp_replace(F.lower(unit["text"]), NO_WORD, " "))
        return F.struct(unit["kind"].alias("kind"), unit["number"].alias("number"), F.split(plain, " ").alias("words"))

    def may_fit(unit: Column) -> Column:
        # n words with d different ones make at least d - 1 and at most n - 1 bigrams.
        return (F.size(unit["words"]) > low) & (F.size(F.array_distinct(unit["words"])) <= high + 1)

    def paired(unit: Column) -> Column:
        words = unit["words"]
        pairs = F.transform(
            F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", words[i], words[i + 1])
        )
        return F.struct(unit["kind"].alias("kind"), unit["number"].alias("number"), F.array_distinct(pairs).alias("pairs"))

    def judged(unit: Column) -> Column:
        size = F.size(unit["pairs"])
        scores = []
        for t in known:
            common = F.size(F.array_intersect(unit["pairs"], F.array(*map(F.lit, t.bigrams))))
            score = F.when(size.between(t.low, t.high), 2.0 * common / (size + len(t.bigrams)))
            scores.append(F.struct(F.coalesce(score, F.lit(0.0)).alias("score"), F.lit(t.license).alias("license")))
        best = F.array_max(F.array(*scores))
        return F.struct(
            unit["kind"].alias("kind"), unit["number"].alias("number"), best["score"].alias("score"), best["license"].alias("license")
        )

    units = F.filter(F.transform(_units(F.coalesce(F.col("text"), F.lit(""))), split), may_fit)
    found = F.filter(F.transform(F.transform(units, paired), judged), lambda u: u["score"] >= least)
    words, units_found = free(docs, "_words"), free(docs, "_units")
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col("text"), F.lit(""))), NO_WORD, " "))
    whole = docs.select(*keep, found.alias(units_found), F.split(plain, " ").alias(words))
    return _with_runs(whole, keep, units_found, words, known, least)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, license and score of the best unit, n_matches, matches of every row.

    Of equal scores the license whose name sorts last counts; documents without one have
    null, null, 0 and an empty text.
    """
    found = scan(docs.select("doc_id", "text"))
    best = F.array_max(F.transform("licenses", lambda u: F.struct(u["score"].alias("score"), u["license"].alias("license"))))
    names = F.array(F.lit("line"), F.lit("paragraph"), F.lit("text"), F.lit("run"))
    written = F.transform(
        "licenses", lambda u: F.concat_ws(":", names[u["kind"]], u["number"].cast("string"), u["license"])
    )
    return found.select("doc_id", "licenses").select(
        "doc_id", best["license"].alias("license"), F.round(best["score"], 6).alias("score"),
        F.size("licenses").cast("bigint").alias("n_matches"), F.array_join(written, ",").alias("matches"),
    )
