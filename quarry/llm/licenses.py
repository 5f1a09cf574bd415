"""Operator 2, license scans: patience alignment of texts with license texts and notices, and names of licenses.

Full public license texts (license_texts/) and the notices by which licenses are applied are aligned with the text.
A license that is only named is found by its name, which must stand whole: a word more or less, or another version,
is another license.
"""

from __future__ import annotations

import pkgutil
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Notices by which public licenses are applied to a work.
TEMPLATES = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "GFDL-1.3": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation",
}
#: Words of a template that must align without a gap: those that tell it from its like.
DECIDING = {
    "Apache-2.0": ["apache license version 2.0"],
    "GPL-2.0": ["gnu general public license", "version 2 of"],
    "GPL-3.0": ["gnu general public license", "version 3 of"],
    "LGPL-2.0": ["gnu library general public license", "version 2 of"],
    "LGPL-2.1": ["gnu lesser general public license", "version 2.1 of"],
    "LGPL-3.0": ["gnu lesser general public license", "version 3 of"],
    "AGPL-3.0": ["gnu affero general public license", "version 3 of"],
    "MPL-2.0": ["mozilla public license v 2.0"],
    "GFDL-1.3": ["gnu free documentation license version 1.3"],
    "BSD-3-Clause-text": ["neither the name"],
    "BSD-4-Clause-text": ["all advertising materials mentioning features", "neither the name"],
    "ISC-text": ["provided that the above copyright notice"],
}
TEXTS = ("Apache-2.0", "Artistic-1.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0", "Unicode-3.0", "Unlicense", "WTFPL", "Zlib")
#: Words that make a name a notice: the lead within so many words before it, a label just before it, and for an id the lead after one of the last set.
LEAD, LEAD_WORDS, LABEL = "under", 12, frozenset(("license", "licence", "licenses", "licensed", "spdx-license-identifier"))
APPLIED = frozenset(("licensed", "released", "distributed", "available", "published", "license"))


def full_texts() -> dict[str, str]:
    """Full license texts by template name."""
    out = {f"{k}-text": pkgutil.get_data(__package__, f"license_texts/{k}.txt").decode() for k in TEXTS}
    clause = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the copyright holder.\n\n4. Neither"
    return out | {"BSD-4-Clause-text": out["BSD-3-Clause-text"].replace("3. Neither", clause)}


def names() -> dict[tuple[str, ...], tuple[str, str]]:
    """Words that name a license: its template name, and kind: name, id (needs a word of license just before) or whole (stands alone)."""
    out = {}

    def put(name, kind, *phrases):
        for p in phrases:
            out.setdefault(tuple(tokens(p)), (f"{name}-line", kind))

    put("all-rights-reserved", "whole", "all rights reserved")
    put("MIT", "name", "MIT License", "MIT Licence", "MIT/X11 License", "Expat License")
    put("BSD", "name", "BSD License", "BSD-style License")
    for n, word, also in ((2, "two", "Simplified"), (3, "three", "New"), (4, "four", "Original")):
        kinds = (f"{n}-clause BSD", f"{word}-clause BSD", f"{also} BSD", f"BSD {n}-clause", f"BSD-{n}-clause", f"BSD {word}-clause")
        put(f"BSD-{n}-Clause", "name", *[f"{k} License" for k in kinds], *[f'{k} "{also}" License' for k in kinds])
    put("BSD-3-Clause", "name", "Modified BSD License", "Revised BSD License")
    put("BSD-2-Clause", "name", "FreeBSD License")
    put("ISC", "name", "ISC License")
    put("Unlicense", "name", "The Unlicense", "Unlicense")
    put("Zlib", "name", "zlib License")
    put("WTFPL", "name", "Do What The Fuck You Want To Public License")
    put("CC0-1.0", "name", "CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero", "Creative Commons CC0")
    versioned = {
        "Apache": (("1.1", "2.0"), ("Apache License", "Apache Software License")), "BSL": (("1.0",), ("Boost Software License",)), "MPL": (("1.0", "1.1", "2.0"), ("Mozilla Public License",)), "EPL": (("1.0", "2.0"), ("Eclipse Public License",)),
        "GPL": (("1.0", "2.0", "3.0"), ("GNU General Public License", "GNU General Public License (GPL)", "GNU GPL", "GPL", "General Public License")), "LGPL": (("2.0", "2.1", "3.0"), ("GNU Lesser General Public License", "GNU Lesser General Public License (LGPL)", "GNU Library General Public License", "GNU LGPL", "LGPL", "Lesser General Public License", "Library General Public License")),
        "AGPL": (("1.0", "3.0"), ("GNU Affero General Public License", "GNU Affero General Public License (AGPL)", "GNU AGPL", "AGPL", "Affero General Public License")), "GFDL": (("1.1", "1.2", "1.3"), ("GNU Free Documentation License", "GFDL")), "Artistic": (("1.0", "2.0"), ("Artistic License",)),
    }
    for family, (versions, called) in versioned.items():
        put(family, "name", *called)
        for version in versions:
            name = f"{family}-{version}"
            for v in {version, version.removesuffix(".0")}:
                for c in called:
                    put(name, "name", f"{c}, version {v}", f"{c} {v}", f"{c} v{v}", f"{c} v. {v}", f"version {v} of the {c}", f"{c} as published by the Free Software Foundation, version {v}")
                    if "License" in c:
                        put(name, "name", c.replace("License", f"{v} License"))
                put(name, "name", f"{family}v{v}", f"{family}-{v} license", f"{family} {v} license", f"{family}-{v}-or-later", f"{family}v{v}+")
                put(name, "id", f"{family}-{v}", f"{family}-{v}-only", f"{family}-{v}+", f"{family}{v}", f"{family} {v}")
    for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        for parts in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
            long = "-".join({"BY": "Attribution", "SA": "ShareAlike", "ND": "NoDerivatives", "NC": "NonCommercial"}[x] for x in parts.split("-"))
            spelt = {parts, parts.replace("-", " ")}, {f(long) for f in (str, lambda x: x.replace("-", " "), lambda x: x.replace("NoDerivatives", "NoDerivs"), lambda x: x.replace("NonCommercial", "Noncommercial").replace("ShareAlike", "Share Alike"), lambda x: x.replace("ShareAlike", "Share-Alike").replace("NonCommercial", "Non-Commercial"))}
            name = f"CC-{parts}-{v}"
            put(name, "name", name, *[f"CC {x} {v}" for x in spelt[0]], *[f"CC-{x} {v}" for x in spelt[0]], *[f"Creative Commons {x} {v}" for x in (*spelt[0], *spelt[1])], *[f"Creative Commons {x} License {v}" for x in spelt[1]])
            put(name, "whole", *[f"{h}creativecommons.org/licenses/{parts.lower()}/{v}{e}" for h in ("http://", "https://", "http://www.", "https://www.", "") for e in ("", "/legalcode", "/deed.en")])
    for url, name in (("apache.org/licenses/LICENSE-2.0", "Apache-2.0"), ("opensource.org/licenses/MIT", "MIT"), ("creativecommons.org/publicdomain/zero/1.0", "CC0-1.0"), ("mozilla.org/MPL/2.0", "MPL-2.0")):
        put(name, "whole", *[f"{h}{url}" for h in ("http://", "https://", "http://www.", "https://www.")])
    for k in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "Zlib", "WTFPL", "CC0-1.0", "BSL-1.0", "Unicode-3.0"):
        put(k, "id", k)
    return out


def tokens(text: str) -> list[str]:
    """Words in lower case without punctuation at their ends."""
    return [w for x in text.lower().split() if (w := x.strip(".,;:!?\"'()[]{}*#/<>-"))]


def longest_rising(places: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence: patience sorting with back pointers."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(places)
    for i, p in enumerate(places):
        k = bisect_left(tops, p)
        if k == len(tops):
            tops.append(p), at.append(i)
        else:
            tops[k], at[k] = p, i
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, rising in both: anchors are words unique in both, gaps are aligned in turn."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if cb[w] == 1 and ca[w] == 1}
        both = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if w in place]
        anchors = [both[k] for k in longest_rising([j for _, j in both])]
        if not anchors:
            continue
        i0, j0 = a0, b0
        for i, j in [*anchors, (a1, b1)]:
            if i0 < i and j0 < j:
                work.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
        out.extend(anchors)
    return sorted(out)


def named(words: list[str], known: dict[str, list[tuple[tuple[str, ...], str, str]]]) -> list[tuple]:
    """Spans (license, coverage, n_matched, first_word, last_word, places) where a license is named in a notice."""
    out, ends, past = [], set(), -1
    for i, w in enumerate(words):
        if i < past or w not in known:
            continue
        for phrase, name, kind in known[w]:  # longest first
            if tuple(words[i : i + len(phrase)]) != phrase:
                continue
            end, lead = i + len(phrase), None
            before = words[max(0, i - LEAD_WORDS) : i]
            under = next((k for k in (1, 2) if before[-k : len(before) - k + 1] == [LEAD]), None)  # under X, under the X
            if kind == "whole":
                lead = i
            elif before and (before[-1] in LABEL or before[-1] in ("or", "and", "with") and i - 1 in ends):
                lead = i - 1
            elif kind == "id" and under and i > under and words[i - under - 1] in APPLIED:
                lead = i - under
            elif kind == "name" and LEAD in before:
                lead = i - 1 - before[::-1].index(LEAD)
            if lead is None:
                continue
            places = sorted({lead, *range(i, end)})
            out.append((name, 1.0, len(places), lead, end - 1, places))
            ends.add(end)
            past = end
            break
    return out


def license_scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, coverage: float = 0.8) -> DataFrame:
    """Per input row: the id, license, coverage (double), n_matched, first_word, last_word (long), spans, n_words (long).

    spans lists every license found, by place: structs of license, coverage, n_matched, first_word, last_word. A template
    is found where a share of its words of at least coverage aligns with the text, in order, and its deciding words
    align without a gap. Full texts are called ...-text, notices by the license alone. A name of a license (...-line)
    is found where it stands whole after a word that makes it a notice. Of finds that share most of their words the one
    with the most matched words stays (ties: larger share, then name). license and the columns after it are the span with
    the largest share (ties: more matched words, then name), else null, 0.0 and nulls. A template is aligned with every
    text that holds enough of its words at all, which no alignment can exceed, and only within the stretches where its
    words stand dense: each start of its words opens a stretch of three times its length. Words are compared in lower
    case without punctuation at their ends. Null text has no words. Given templates replace all texts, notices and names.
    """
    own = templates is None
    known = {k: tokens(v) for k, v in sorted((TEMPLATES | full_texts() if own else templates).items())}
    deciding = {k: [tuple(tokens(p)) for p in v] for k, v in DECIDING.items()} if own else {}
    lines = defaultdict(list)
    for phrase, (name, kind) in sorted(names().items(), key=lambda x: -len(x[0])) if own else ():
        lines[phrase[0]].append((phrase, name, kind))
    lines = dict(lines)
    spent = "license string, coverage double, n_matched long, first_word long, last_word long"
    schema = f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, {spent}, spans array<struct<{spent.replace(' ', ':').replace(',:', ',')}>>, n_words long"
    # Of each template the long words, which tell texts apart best, and how many of those a text must hold.
    rare = {}
    for name, t in known.items():
        need = Counter(w for w in t if len(w) >= 6) or Counter(t)
        rare[name] = need, frozenset(need), sum(need.values()) - (1 - coverage) * len(t) - 1e-9

    def decided(name: str, hits: list[tuple[int, int]]) -> bool:
        """Whether the deciding words of a template align without a gap."""
        t, at = known[name], {j: i for i, j in hits}
        for phrase in deciding.get(name, ()):
            n = len(phrase)
            if not any(tuple(t[j : j + n]) == phrase and all(at.get(j + k, -1) == at.get(j, -2) + k for k in range(n)) for j in range(len(t) - n + 1)):
                return False
        return True

    def spans(words: list[str]) -> list[tuple]:
        found, here = named(words, lines), set(words)
        have = None
        for name, t in known.items():
            need, some, least = rare[name]
            if len(words) < coverage * len(t) or not (both := some & here) and least > 0:
                continue
            if sum(need[w] for w in both) < least:
                continue
            have = have or Counter(words)
            need = Counter(t)
            if sum(min(n, have[w]) for w, n in need.items()) < coverage * len(t):
                continue
            places = [i for i, w in enumerate(words) if w in need]
            reach, k = 3 * len(t), 0
            while k < len(places):
                start = places[k]
                hits = aligned(words[start : start + reach], t)
                share = len(hits) / len(t)
                half = start + len(t)  # stretches overlap, so that none is cut by all
                if share >= coverage and decided(name, hits):
                    found.append((name, share, len(hits), start + hits[0][0], start + hits[-1][0], [start + i for i, _ in hits]))
                    if share == 1:
                        half = start + hits[-1][0] + 1
                opening = next((m for m in range(k + 1, len(places)) if places[m] < half and words[places[m] : places[m] + 4] == t[:4]), None)
                k = opening or next((m for m in range(k + 1, len(places)) if places[m] >= half), len(places))
        out, claimed = [], set()
        for f in sorted(found, key=lambda f: (-f[2], -f[1], f[0], f[3])):
            if 2 * sum(i in claimed for i in f[5]) <= len(f[5]):
                claimed.update(f[5])
                out.append(f[:5])
        return sorted(out, key=lambda f: (f[3], f[4], f[0]))

    fields = ["license", "coverage", "n_matched", "first_word", "last_word"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d, s in zip(batch[doc_id].array, batch[text].array, strict=True):
                words = tokens(s) if isinstance(s, str) else []
                found = spans(words)
                best = min(found, key=lambda f: (-f[1], -f[2], f[0]), default=(None, 0.0, None, None, None))
                rows.append((None if pd.isna(d) else d, *best, [dict(zip(fields, f, strict=True)) for f in found], len(words)))
            out = pd.DataFrame(rows, columns=[doc_id, *fields, "spans", "n_words"])
            yield out.astype({doc_id: object, "n_matched": "Int64", "first_word": "Int64", "last_word": "Int64"})

    return docs.select(doc_id, text).mapInPandas(scan, schema)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
