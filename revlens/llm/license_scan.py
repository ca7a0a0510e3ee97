"""License scans by patience alignment.

A template is aligned with a region of a text by anchoring on the words that occur once
in both; of these anchors the longest increasing subsequence stays, and the gaps between
them are aligned the same way (in a gap more words are unique). Coverage is the share of
the template's words that are aligned.

Regions: a text holds a template at coverage c only if it holds at least one of the
floor((1 - c) n) + 1 rarest of its n words (here: the longest), so only texts with such a
word are looked at, around each of its places, in windows of one template length and
somewhat more (words put in). An aligned region is at most one and a half times as long as its
template, so it never joins two notices. All regions of all templates are candidates; of
those on the same words the one with most aligned words stays.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from importlib import resources

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from revlens.llm.text import bounded_batches

MIN_COVERAGE = 0.8

# Notices by which texts name their license.
TEMPLATES = {
    "MIT": "Released under the MIT License",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "all-rights-reserved": "All rights reserved",
}

_GNU = ("This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name}General Public License "
        "as published by the Free Software Foundation, either version {version} of the License")
_CC = {"": "", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives", "NC-SA": "NonCommercial-ShareAlike", "NC-ND": "NonCommercial-NoDerivatives"}

# Headers of source files and further notices; what follows # tells a license's templates apart.
HEADERS = {
    **{f"GPL-{v}.0#header": _GNU.format(what="program", name="", version=v) for v in (2, 3)},
    **{f"LGPL-{v}#header": _GNU.format(what="library", name="Lesser ", version=v) for v in ("2.1", "3")},
    "AGPL-3.0#header": _GNU.format(what="program", name="Affero ", version=3),
    **{f"CC-BY-{k + '-' if k else ''}4.0#name": f"Creative Commons Attribution{'-' + v if v else ''} 4.0 International License" for k, v in _CC.items()},
    **{f"CC-BY-{k}-4.0#long": f"This work is licensed under a Creative Commons Attribution-{v} 4.0 International License" for k, v in _CC.items() if k},
    **{f"CC-BY-{k + '-' if k else ''}4.0#short": f"Licensed under CC BY{'-' + k if k else ''} 4.0" for k in _CC},
}
HEADERS["LGPL-3.0#header"] = HEADERS.pop("LGPL-3#header")

# Words that tell a template from its neighbours: all of them must be aligned. GPL-3.0's text
# is told from the Affero text by the date of its title.
DISTINCT = {
    "MIT": "MIT", "Apache-2.0": "Apache 2", "GPL-3.0": "3", "GPL-2.0": "2", "CC-BY-4.0": "Attribution 4", "CC-BY-NC-4.0": "NC 4",
    "MPL-2.0": "Mozilla 2", "BSD-3-Clause#text": "endorse", "GPL-3.0#text": "29 June", "GPL-3.0#header": "3", "GPL-2.0#header": "2",
    "LGPL-2.1#header": "Lesser 2 1", "LGPL-3.0#header": "Lesser 3", "AGPL-3.0#header": "Affero 3", "LGPL-2.1#text": "Lesser",
    **{f"CC-BY-{k + '-' if k else ''}4.0#{part}": f"Attribution {v} 4" for k, v in _CC.items() for part in ("name", "long")},
    **{f"CC-BY-{k + '-' if k else ''}4.0#short": f"CC BY {k} 4" for k in _CC},
}


def all_templates() -> dict[str, str]:
    """TEMPLATES, HEADERS and the license texts of the folder licenses. Read on the driver."""
    files = sorted((f for f in resources.files("revlens.llm").joinpath("licenses").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    names = [f.name.removesuffix(".txt") for f in files]
    return {**TEMPLATES, **HEADERS, **{n if "#" in n else f"{n}#text": f.read_text("utf-8") for n, f in zip(names, files)}}


_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (sorted by the first) that rises in the second: patience piles."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        back.append(piles[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(y)
            piles.append(k)
        else:
            tops[pile], piles[pile] = y, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Patience alignment: (text place, template place) of aligned words, rising in both."""
    def once(ws: list[str], lo: int, hi: int) -> dict[str, int]:
        at: dict[str, int] = {}
        for i in range(lo, hi):
            at[ws[i]] = -1 if ws[i] in at else i
        return {w: i for w, i in at.items() if i >= 0}
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        # equal ends need no anchor
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        own, other = once(text, a, b), once(template, c, d)
        anchors = _rising(sorted((own[w], other[w]) for w in own.keys() & other.keys()))
        if not anchors:
            continue
        out += anchors
        edge = (a, c)
        for x, y in [*anchors, (b, d)]:
            todo.append((edge[0], x, edge[1], y))
            edge = (x + 1, y + 1)
    return sorted(out)


class Scanner:
    """Finds templates (name -> notice) in texts. Templates whose names differ only after a #
    are of one license, which is what is reported."""

    def __init__(self, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE):
        self.min_coverage = min_coverage
        self.templates = {n: words(t) for n, t in (templates or TEMPLATES).items() if words(t)}
        self.keys = {}
        for name, ws in self.templates.items():
            spare = int((1 - min_coverage) * len(ws) + 1e-9)
            self.keys[name] = set(sorted(ws, key=lambda w: (-len(w), w))[:spare + 1])
        self.counts = {name: Counter(ws) for name, ws in self.templates.items()}
        self.at = {name: {k: [j for j, w in enumerate(ws) if w == k] for k in self.keys[name]} for name, ws in self.templates.items()}
        # template places that must be aligned
        self.must = {name: {j for j, w in enumerate(ws) if w in set(words(DISTINCT.get(name, "")))} for name, ws in self.templates.items()}

    def regions(self, text: list[str], name: str) -> list[tuple[int, int]]:
        """Places around the template's key words: as many words to each side as an alignment may span."""
        reach = 2 * len(self.templates[name])
        out: list[tuple[int, int]] = []
        for i, w in enumerate(text):
            if w in self.keys[name]:
                lo, hi = max(0, i - reach), min(len(text), i + reach + 1)
                if out and lo <= out[-1][1]:
                    out[-1] = (out[-1][0], hi)
                else:
                    out.append((lo, hi))
        return out

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, end word) of each license found, by license.

        Every region that reaches min_coverage is a candidate, of every template. On
        overlapping words the one with most aligned words stays (less the words put in), then the
        best covered, then by name; a template that loses one region may keep another. Of a
        license's regions the first in this order is reported."""
        ws = words((text or "").lower())
        have = set(ws)
        found: set[tuple[int, float, str, int, int]] = set()
        for name, template in self.templates.items():
            # no alignment has more words than both sides share
            if (len(ws) / len(template) < self.min_coverage or self.keys[name].isdisjoint(have)
                    or sum(self.counts[name][w] for w in have & self.counts[name].keys()) / len(template) < self.min_coverage):
                continue
            for lo, hi in self.regions(ws, name):
                for a, b in self.places(ws, lo, hi, name):
                    found |= self.fit(ws, a, b, name)
        out: dict[str, tuple[str, float, int, int]] = {}
        taken: list[tuple[int, int]] = []
        for _, cover, name, first, end in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[3])):
            if all(end <= lo or first >= hi for lo, hi in taken):
                taken.append((first, end))
                name = name.split("#")[0]
                out.setdefault(name, (name, cover, first, end))
        return sorted(out.values())

    def fit(self, ws: list[str], a: int, b: int, name: str) -> set[tuple[int, float, str, int, int]]:
        """Regions of the template in the words a to b. An alignment that spreads over more than the
        template's length and a half joins parts of different notices: it is cut at its widest
        gap and both sides are aligned anew."""
        template, out = self.templates[name], set()
        n = len(template)
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if (Counter(ws[a:b]) & self.counts[name]).total() / n < self.min_coverage:
                continue
            pairs = align(ws[a:b], template)
            if len(pairs) / n < self.min_coverage:
                continue
            first, end = a + pairs[0][0], a + pairs[-1][0] + 1
            if end - first > n + n // 2 + 1:
                gap, cut = max((y[0] - x[0], -x[0]) for x, y in zip(pairs, pairs[1:]))
                todo += [(a, a - cut + 1), (a - cut + gap, b)]
            elif self.must[name] <= {y for _, y in pairs}:
                # words put in count against a region
                out.add((2 * len(pairs) - (end - first), len(pairs) / n, name, first, end))
        return out

    def places(self, ws: list[str], lo: int, hi: int, name: str):
        """Windows of about one template length where a key word would stand at its place in
        the template (in a wider one a notice that stands twice has no word that is unique), with
        slack for words put in; long templates on a coarser grid."""
        n, at = len(self.templates[name]), self.at[name]
        spare = int((1 - self.min_coverage) * n + 1e-9)
        grid = max(1, spare // 2)
        starts = sorted({(i - j) // grid * grid for i in range(lo, hi) for j in at.get(ws[i], ())})
        for s in starts:
            for slack in sorted({0, spare + 1, n // 2 + 1}):
                yield max(0, s - slack), min(len(ws), s + grid - 1 + n + slack)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """All columns of docs plus licenses: array of (name, coverage, first_word, end_word),
    one per license found, by name; without ``templates``, those of ``all_templates()``.

    Null, empty and unmarked texts have an empty array. A column of docs named licenses
    is replaced. Row-local, whole texts.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(templates or all_templates(), min_coverage))

    @pandas_udf("array<struct<name:string,coverage:double,first_word:int,end_word:int>>")
    def found(text: pd.Series) -> pd.Series:
        scanner = shared.value
        return pd.Series([[{"name": n, "coverage": c, "first_word": a, "end_word": b} for n, c, a, b in scanner.scan(t)]
                          for t in text], dtype=object)
    return docs.drop("licenses").withColumn("licenses", found("text"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scan(docs).select("doc_id", "licenses")
    return out.select("doc_id", F.size("licenses").alias("n_licenses"),
                      F.transform("licenses", lambda x: x["name"]).alias("names"),
                      F.array_max(F.transform("licenses", lambda x: x["coverage"])).alias("best_coverage"))
