"""License scan by conditional compression (operator 8)."""

from __future__ import annotations

import bisect
import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import ready

LEVEL, DIFFERENCE = 9, 0.25
#: Longer regions are aligned in parts of so many words, which overlap.
SPAN = 20_000
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_2 = " Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AD = " All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
_AS_IS = " This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties"


def _gnu(what: str, version: str, program: str = "program") -> tuple[str, ...]:
    """The notice for source files and the one that has the version first."""
    return (f"This {program} is free software: you can redistribute it and/or modify it under the terms of the GNU {what} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
            f"This {program} is free software; you can redistribute it and/or modify it under the terms of version {version} of the GNU {what} as published by the Free Software Foundation.")


_GPL, _LESSER, _AFFERO = "General Public License", "Lesser General Public License", "Affero General Public License"
#: Short public notices and the distinctive passages of longer ones, by SPDX identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": ("Released under the MIT License.", "This project is licensed under the terms of the MIT license.", _MIT),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                   "Apache License Version 2.0, January 2004"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", *_gnu(_GPL, "3"), "GNU General Public License Version 3, 29 June 2007"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", *_gnu(_GPL, "2"), "GNU General Public License Version 2, June 1991"),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", *_gnu(_LESSER, "3", "library"), "GNU Lesser General Public License Version 3, 29 June 2007"),
    "LGPL-2.1": ("This work is licensed under the GNU Lesser General Public License, version 2.1.", *_gnu(_LESSER, "2.1", "library"), "GNU Lesser General Public License Version 2.1, February 1999"),
    "LGPL-2.0": _gnu("Library General Public License", "2", "library"),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", *_gnu(_AFFERO, "3"), "GNU Affero General Public License Version 3, 19 November 2007"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    # The passage on source and binary forms is common to all BSD licenses and counts as the usual one, unless more of the notice tells which it is.
    "BSD-3-Clause": (_BSD, "Released under the BSD 3-Clause License.", _BSD + _BSD_2 + _BSD_NAME),
    "BSD-2-Clause": (_BSD + _BSD_2 + _AS_IS,),
    "BSD-4-Clause": (_BSD + _BSD_2 + _BSD_AD + _BSD_NAME,),
    "CC0-1.0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "proprietary": ("All rights reserved.",),
}
#: The names under which a license is "licensed under" and so on.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("the MIT License", "MIT", "the Expat License"),
    "Apache-2.0": ("the Apache License 2.0", "the Apache License Version 2.0", "the Apache 2.0 License", "Apache 2.0", "the Apache-2.0 license", "the Apache License v2.0"),
    "MPL-2.0": ("the Mozilla Public License 2.0", "the Mozilla Public License Version 2.0", "the Mozilla Public License v2.0", "the MPL 2.0", "the MPL-2.0"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License", "the Modified BSD License"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License", "the FreeBSD License"),
    "BSD-4-Clause": ("the BSD 4-Clause License", "the 4-Clause BSD License", "the Original BSD License"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "the Creative Commons Zero 1.0 license", "the Creative Commons CC0 1.0 Universal license"),
}
for _id, _long, _short, _v in (("GPL-3.0", _GPL, "GPL", "3"), ("GPL-2.0", _GPL, "GPL", "2"), ("LGPL-3.0", _LESSER, "LGPL", "3"), ("LGPL-2.1", _LESSER, "LGPL", "2.1"), ("AGPL-3.0", _AFFERO, "AGPL", "3")):
    _dotted = _v if "." in _v else f"{_v}.0"
    NAMES[_id] = tuple(f"the {g}{n}" for n in dict.fromkeys(
        [f"{_long} {x}{v}" for x in ("version ", "v") for v in (_v, _dotted)] + [f"{_short} {x}{v}" for x in ("version ", "v", "") for v in (_v, _dotted)] + [f"{_short}v{_v}", f"{_short}-{_dotted}"]) for g in ("GNU ", ""))
for _part, _words in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
                      ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    for _v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        _kind = "International" if _v == "4.0" else "Unported" if _v == "3.0" else "Generic"
        TEMPLATES[f"CC-{_part}-{_v}"] = (f"Licensed under CC {_part} {_v}.", f"This work is licensed under a Creative Commons {_words} {_v} {_kind} License.")
        NAMES[f"CC-{_part}-{_v}"] = (f"CC {_part} {_v}", f"a Creative Commons {_words} {_v} License", f"the Creative Commons {_words} {_v} {_kind} License")
VERBS = ("licensed under", "released under", "distributed under", "available under", "licensed under the terms of", "under the terms of")
#: A block is a candidate if it has one of these; every template has one.
SIGNS = r"(?i)licen[sc]|copyright|all\W+rights\W+reserved|hereby\W+granted|redistribution|cc0|creative\W+commons|public\W+domain|free\W+software|cc[ -]+by|under\W+(the\W+)?(terms\W+of\W+)?(the\W+)?(gnu|mit|bsd|[al]?gpl|mpl|apache|expat)"
#: License tags: an SPDX identifier or expression after its name.
TAG = re.compile(r"(?i)\b(?:SPDX-License-Identifier|licen[sc]e)[\"']?[ \t]*[:=][ \t]*[\"'(]*([\w.+-]+(?:[ \t)(]+(?:OR|AND|WITH)[ \t(]+[\w.+-]+)*)")
WORD = re.compile(r"[\w.+-]*\w")
_SPLIT, _VERSION = re.compile(r"(?:cc-by|by|attribution|noncommercial|sharealike)(?:-[\w.]+)+$"), r"v?\d(?:\.\d+)*"
#: The words that tell licenses of a family apart; a match that lacks or adds one is rejected.
TELLS = tuple((re.compile(k), re.compile(f"(?:{w})$")) for k, w in (
    (r"A?GPL|LGPL", rf"lesser|affero|gnu|[al]?gpl.*|{_VERSION}"),
    (r"CC", rf"cc0?|by|nc|sa|nd|attribution|noncommercial|sharealike|noderiv\w*|zero|{_VERSION}"),
    (r"Apache", rf"apache.*|mit|{_VERSION}|license-\d.*"),
    (r"MPL", rf"mozilla|mpl.+|{_VERSION}"),
    (r"BSD", r"bsd|freebsd|\d-clause|new|modified|simplified|original|neither|endorse|promote|advertising|acknowledge?ment"),
    (r"MIT", r"mit|mit-.*|expat|apache|bsd|isc")))


def tokens(text: str) -> list[tuple[str, int]]:
    """(lower-cased word, its place) of a text; the parts of Creative Commons names are words of their own."""
    out = []
    for m in WORD.finditer(text):
        w = m.group().lower()
        if "-" in w:
            w = w.replace("non-commercial", "noncommercial").replace("share-alike", "sharealike").replace("no-deriv", "noderiv")
            if _SPLIT.match(w):
                out += [(x, m.start()) for x in w.split("-") if x]
                continue
        out.append((w, m.start()))
    return out


def words(text: str) -> list[str]:
    return [w for w, _ in tokens(text)]


def spdx(expression: str) -> list[str]:
    """The licenses of an SPDX expression, without 'only' and 'or later'; exceptions after WITH are left out."""
    out, skip = [], False
    for x in re.findall(r"[\w.+-]+", expression):
        if x.upper() in ("OR", "AND", "WITH"):
            skip = x.upper() == "WITH"
        elif not skip:
            out.append(re.sub(r"(?i)(-only|-or-later|\+)$", "", x.rstrip(".-")))
    return out


class Scanner:
    """Each template as a raw zstandard dictionary."""

    def __init__(self, templates=None):
        self.open = templates is None  # tags may name licenses that have no template
        rows = [(k, words(t)) for k, ts in (templates or TEMPLATES).items() for t in ts]
        if self.open:
            rows += [(k, words(f"{v} {n}")) for k, ns in NAMES.items() for n in ns for v in VERBS]
        self.rows = [(k, list(w)) for k, w in dict.fromkeys((k, tuple(w)) for k, w in rows)]
        self.vocabulary = {w: n for n, w in enumerate(dict.fromkeys(w for _, ws in self.rows for w in ws))}
        self.bags = np.zeros((len(self.rows), len(self.vocabulary)), np.int16)
        for i, (_, ws) in enumerate(self.rows):
            for w in ws:
                self.bags[i, self.vocabulary[w]] += 1
        self.most = np.array([int(DIFFERENCE * len(w) + 1e-9) for _, w in self.rows])
        self.names = {k.lower(): k for k, _ in self.rows}
        self.tells = [next((t.match for p, t in TELLS if p.match(k)), None) for k, _ in self.rows]
        # A match with so few differences lies within this many words of the sign in it.
        self.reach = int(max(len(w) for _, w in self.rows) * (1 + DIFFERENCE)) + 2
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.alone = functools.lru_cache(maxsize=1 << 14)(lambda raw: len(self.plain.compress(raw)))
        self.saved = functools.lru_cache(maxsize=1 << 14)(self._saved)

    @functools.lru_cache(maxsize=64)
    def _with(self, i: int):
        d = zstandard.ZstdCompressionDict(" ".join(self.rows[i][1]).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False)

    def _saved(self, i: int, raw: bytes) -> float:
        return 1 - len(self._with(i).compress(raw)) / self.alone(raw)

    def scan(self, text: str) -> list[tuple]:
        """(line, license, size reduction, wording difference, missing, added, exact) of each license stated,
        by place.  Words are joined over lines: the text within reach of a sign is searched as one region."""
        signs = [m.start() for m in re.finditer(SIGNS, text)]
        tags = [(m.start(1), m.group(1)) for m in TAG.finditer(text)] if signs else []
        own = tokens(text) if signs else []
        if not own:
            return []
        at = [p for _, p in own]
        breaks = [m.start() for m in re.finditer("\n", text)]
        ranges: list[list[int]] = []
        for s in signs:
            k = max(0, bisect.bisect_right(at, s) - 1)
            a, z = max(0, k - self.reach), min(len(own), k + self.reach)
            if ranges and a <= ranges[-1][1]:
                ranges[-1][1] = z
            else:
                ranges.append([a, z])
        found = []
        for a, z, c in ((max(a, c - self.reach), min(z, c + SPAN + self.reach), c) for a, z in ranges for c in range(a, z, SPAN)):
            lines = tuple(bisect.bisect_left(breaks, p) for p in at[a:z])
            first = lines[0]
            found += [(at[a + n], first + k, *h) for n, k, *h in self._region(tuple(w for w, _ in own[a:z]), tuple(x - first for x in lines)) if c <= a + n < c + SPAN]
        for p, expression in tags:
            line = bisect.bisect_left(breaks, p)
            for x in spdx(expression):
                name = self.names.get(x.lower(), x if self.open and "-Identifier" in text[max(0, p - 24):p] else None)
                if name and not any(f[1] == line and f[2] == name for f in found):
                    found.append((p, line, name, 1.0, 0.0, [], [], True))
        return [f[1:] for f in sorted(found, key=lambda f: (f[0], f[2]))]

    def _region(self, own: tuple[str, ...], lines: tuple[int, ...]) -> tuple[tuple, ...]:
        """Matches (word, line, license, saved, difference, missing, added, exact) in the words of a region.
        Every template of which enough words are there is aligned; of matches that claim the same words the
        one that explains most of them stands, of equal ones the one that saves the most bytes."""
        bag = Counter(own)
        code = {w: n for n, w in enumerate(bag)}
        ids = np.array([code[w] for w in own])
        there = np.zeros(len(self.vocabulary), np.int16)
        for w in bag.keys() & self.vocabulary.keys():
            there[self.vocabulary[w]] = min(bag[w], 1 << 14)
        hits = []
        for i in np.flatnonzero(np.maximum(self.bags - there, 0).sum(1) <= self.most).tolist():
            name, want = self.rows[i]
            for a, z, missing, added in self._align(ids, [code.get(w, -1) for w in want], own, want, lines, self.tells[i]):
                raw = " ".join(own[bisect.bisect_left(lines, lines[a]):bisect.bisect_right(lines, lines[z - 1])]).encode()
                hits.append((len(want) - 2 * len(missing) - len(added), self.saved(i, raw), name, a, z, missing, added, len(want)))
        taken, kept = np.zeros(len(own), bool), []
        for _, saved, name, a, z, missing, added, n in sorted(hits, key=lambda h: (-h[0], -h[1], h[2], h[3])):
            if not taken[a:z].any():
                taken[a:z] = True
                kept.append((a, lines[a], name, saved, (len(missing) + len(added)) / n, missing, added, not missing and not added))
        return tuple(kept)

    @staticmethod
    def _align(ids, code, own, want, lines, tell):
        """The disjoint parts [a, z) of the words that a template fits with the least number of words missing
        and added, best first.  Missing words at an end also count the words of the line that stand for them."""
        n, m, most = len(ids), len(code), int(DIFFERENCE * len(code) + 1e-9)
        place = np.arange(n + 1)
        cost = np.zeros((m + 1, n + 1), np.int32)
        for j in range(m):  # cost[j, i]: of the first j words of the template, in a part that ends at i
            row = cost[j] + 1
            np.minimum(row[1:], np.where(ids == code[j], cost[j, :-1], 1 << 20), out=row[1:])
            cost[j + 1] = np.minimum.accumulate(row - place) + place
        taken, out = np.zeros(n + 1, bool), []
        for end in sorted(np.flatnonzero(cost[m] <= most), key=lambda e: (cost[m, e], e)):
            i, j, missing, added, pairs = int(end), m, [], [], []
            if i and taken[i - 1]:
                continue
            while j:
                if i and ids[i - 1] == code[j - 1] and cost[j, i] == cost[j - 1, i - 1]:
                    i, j = i - 1, j - 1
                    pairs.append((i, j))
                elif cost[j, i] == cost[j - 1, i] + 1:
                    j -= 1
                    missing.append(j)
                else:
                    i -= 1
                    added.append(i)
            if not pairs:
                continue
            a, z = pairs[-1][0], pairs[0][0] + 1
            added = [x for x in added if a <= x < z]
            before, after = pairs[-1][1], m - 1 - pairs[0][1]
            while before and a and lines[a - 1] == lines[a]:
                a, before = a - 1, before - 1
                added.append(a)
            while after and z < n and lines[z] == lines[z - 1]:
                added.append(z)
                z, after = z + 1, after - 1
            if taken[a:z].any() or len(missing) + len(added) > most:
                continue
            if tell and (any(tell(want[x]) for x in missing) or any(tell(own[x]) or own[x:x + 2] == ("library", "general") for x in added)):
                continue
            taken[a:z] = True
            out.append((a, z, [want[x] for x in sorted(missing)], [own[x] for x in sorted(added)]))
        return out


OUT = "array<struct<line:int,license:string,saved:double,difference:double,missing:array<string>,added:array<string>,exact:boolean>>"


def license_scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> one row per stated license: doc_id, line (from 0, where the statement
    begins), license, saved (share of the compressed lines that the template saves), difference (words
    missing and added over the template's words), missing, added, exact.

    Texts that hold one of SIGNS, chosen in the JVM, go to Python whole; there the words around each sign,
    over line ends, are aligned with the templates.  Words that tell licenses of a family apart (version,
    Lesser, Affero, NC, SA ...) must be as in the template.  SPDX tags give each license of their
    expression.  A line may state several licenses in different words of it.  Null and empty texts and
    texts without a license give no row; null doc_ids are kept as null; repeated rows each give theirs;
    other columns are ignored; an empty table gives no rows."""
    ready(docs.sparkSession)
    scanner: list[Scanner] = []

    @F.pandas_udf(OUT)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not scanner:
            scanner.append(Scanner(templates))
        for texts in batches:
            yield pd.Series([[dict(zip(("line", "license", "saved", "difference", "missing", "added", "exact"), h)) for h in scanner[0].scan(t)] if t else [] for t in texts])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").rlike(SIGNS))
    return found.select("doc_id", F.explode(scan("text")).alias("h")).select("doc_id", "h.*")
