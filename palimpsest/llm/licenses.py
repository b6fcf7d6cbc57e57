"""License scan by conditional compression.

Every text is read in short overlapping windows, each compressed alone and with all templates as one raw
zstandard dictionary: windows that this shortens by some bytes, wherever they stand in a line, make up
the candidate regions. Within a region each license's texts are looked for by their pairs of words;
the blocks found so are compressed with each license's own texts as a dictionary, and the licenses
ranked by how much that saves. All that save enough are then compared word by word, and each whose
wording differs little enough is a finding, with the words that differ.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._kernel import row_slices

#: Notices and headers by which well-known licenses are stated (fixed values).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "MPL-2.0": ("Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "Unlicense": ("Released under the Unlicense.", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software for any purpose."),
}
#: Words that tell a license from its relatives: a block must have the same ones (fixed values).
TELLING = {"affero", "lesser", "apache", "mozilla", "mit", "bsd", "isc", "gnu", "cc0", "noncommercial", "nc", "sharealike", "sa", "nd", "noderivatives", "unlicense", "clause"}

_WORD = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")
#: Numbers and letters of list items, which copies of a text leave out or change.
_ITEM = re.compile(r"\b[0-9a-z][.)]\s+(?=redistributions|neither)")
#: Code points of a window and of its step; bytes that the templates must save of it; the gap that regions reach over.
_WINDOW, _STEP, _SAVED, _REACH = 48, 16, 7, 200
#: Lines that are a license's title and nothing else, as words (fixed values).
TITLES = {
    "MIT": ("mit license", "the mit license", "the mit license mit"),
    "BSD-2-Clause": ("bsd 2 clause license", "the bsd 2 clause license"),
    "BSD-3-Clause": ("bsd 3 clause license", "the bsd 3 clause license"),
    "ISC": ("isc license", "the isc license"),
}
#: A license whose text has all of another's.
CONTAINS = {"BSD-3-Clause": "BSD-2-Clause"}


def _words(text: str) -> list[tuple[str, int, int]]:
    """Words with their ranges; items' numbers are left out. Lower-casing keeps ASCII in its place."""
    low = "".join(c.lower() if c.isascii() else c for c in text) if not text.isascii() else text.lower()
    items = {m.start() for m in _ITEM.finditer(low)}
    return [(m[0], m.start(), m.end()) for m in _WORD.finditer(low) if m.start() not in items]


def wording(text: str) -> list[str]:
    return [w for w, _, _ in _words(text)]


def _flat(text: str) -> str:
    """Lower-cased, with every white space a blank: a text in which all places stay the same."""
    low = "".join(c.lower() if c.isascii() else c for c in text) if not text.isascii() else text.lower()
    return low.translate(_BLANKS)


_BLANKS = dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")


def _raw(texts: tuple[str, ...]) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict("\n".join(texts).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Scanner:
    """Finds candidate blocks, ranks the licenses for each and confirms those that save enough."""

    def __init__(self, templates: dict[str, tuple[str, ...]], agreement: float, level: int = 19):
        self._plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self._agreement = agreement
        self._licenses, self._texts, self._pairs = [], [], defaultdict(list)
        whole = {name: (f"SPDX-License-Identifier: {name}", *texts) for name, texts in templates.items()}
        fast = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=0, write_dict_id=0, min_match=6, window_log=18)
        shared = _raw(tuple(_flat(t) for texts in whole.values() for t in texts))
        shared.precompute_compress(compression_params=fast)
        self._alone = zstandard.ZstdCompressor(compression_params=fast).compress
        self._given = zstandard.ZstdCompressor(compression_params=fast, dict_data=shared).compress
        self._titles = {t: name for name in templates for t in TITLES.get(name, ())}
        self._memo: dict[str, dict[str, float]] = {}
        for name, texts in whole.items():
            raw = _raw(texts)
            raw.precompute_compress(level=level)
            self._licenses.append((name, zstandard.ZstdCompressor(level=level, dict_data=raw, write_content_size=False)))
            for text in texts:
                want = wording(text)
                for pair in set(zip(want, want[1:], strict=False)):
                    self._pairs[pair].append(len(self._texts))
                self._texts.append((name, want))

    def regions(self, text: str) -> list[tuple[int, int]]:
        """Ranges about the windows that the templates shorten by _SAVED bytes more than they shorten themselves."""
        low, found = _flat(text), []
        for at in range(0, max(1, len(low) - _STEP), _STEP):
            window = low[at : at + _WINDOW].encode("utf-8", "surrogatepass")
            given = len(self._given(window))
            if given + _SAVED <= len(window) + 9 and len(self._alone(window)) - given >= _SAVED:
                start, end = max(0, at - _WINDOW), at + 2 * _WINDOW
                if found and start <= found[-1][1] + _REACH:
                    found[-1][1] = end
                else:
                    found.append([start, end])
        return [(a, min(b, len(text))) for a, b in found]

    def ranking(self, block: str) -> dict[str, float]:
        """License -> share of the block's compressed length that its dictionary saves, best first."""
        if block in self._memo:
            return self._memo[block]
        data = block.encode("utf-8", "surrogatepass")
        alone = len(self._plain.compress(data))
        ranked = sorted(((1 - len(c.compress(data)) / alone, name) for name, c in self._licenses), key=lambda r: (-r[0], r[1]))
        out = {name: gain for gain, name in ranked}
        if len(block) <= 1000 and len(self._memo) < 10_000:
            self._memo[block] = out
        return out

    def confirm(self, placed: list[tuple[str, int, int]], want: list[str]) -> tuple[int, int, float, int, str, int] | None:
        """(start, end, agreement, differing words, the differences, words read) if the wording is close enough."""
        have = [w for w, _, _ in placed]
        m = SequenceMatcher(None, have, want, autojunk=False)
        equal = [b for b in m.get_matching_blocks() if b.size]
        share = sum(b.size for b in equal) / len(want)
        if share < self._agreement:
            return None
        inside = [op for op in m.get_opcodes() if op[0] != "equal" and not (op[0] == "delete" and op[3] in (0, len(want)))]
        minus = [w for _, a, b, _, _ in inside for w in have[a:b]]
        plus = [w for _, _, _, a, b in inside for w in want[a:b]]
        if any(w in TELLING or w[0].isdigit() for w in (*minus, *plus)) or len(minus) > len(want):
            return None
        last = equal[-1].a + equal[-1].size
        return placed[equal[0].a][1], placed[last - 1][2], share, len(minus) + len(plus), " ".join([*(f"-{w}" for w in minus), *(f"+{w}" for w in plus)]), last

    def scan(self, text: str, least: float) -> list[tuple]:
        """(start, end, license, reduction, runner-up, agreement, number and words that differ) of all licenses confirmed."""
        found = []
        for a, b in self.regions(text):
            placed = [(w, a + s, a + e) for w, s, e in _words(text[a:b])]
            hits: dict[int, list[int]] = defaultdict(list)
            for i, (one, two) in enumerate(zip(placed, placed[1:], strict=False)):
                for t in self._pairs.get((one[0], two[0]), ()):
                    hits[t].append(i)
            for t, at in hits.items():
                found += self._blocks(text, placed, at, *self._texts[t], least)
        for line in _TITLE.finditer(text):
            if (name := self._titles.get(" ".join(wording(line[0])))) is not None:
                ranks = self.ranking(line[0])
                found.append((line.start(), line.end(), name, ranks[name], next((n for n in ranks if n != name), None), 1.0, 0, ""))
        return settled(found)

    def _blocks(self, text: str, placed: list, hits: list[int], name: str, want: list[str], least: float) -> Iterator[tuple]:
        """The findings of one template in a region, by blocks of not much more than its length about its pairs of words."""
        n, slack, i = len(want), max(3, len(want) // 6), 0
        while i < len(hits):
            low = hits[i]
            j = bisect_left(hits, low + n + 2 * slack, i)
            if len(set(zip((placed[h][0] for h in hits[i:j]), (placed[h + 1][0] for h in hits[i:j]), strict=True))) >= 0.4 * (n - 1):
                ranks = self.ranking(text[placed[low][1] : placed[hits[j - 1] + 1][2]])
                first = max(0, low - slack)
                if ranks[name] >= least and (hit := self.confirm(placed[first : hits[j - 1] + 2 + slack], want)):
                    yield (*hit[:2], name, ranks[name], next((r for r in ranks if r != name), None), *hit[2:5])
                    i = max(i + 1, bisect_left(hits, first + hit[5], i))
                    continue
            i = max(i + 1, bisect_left(hits, low + max(1, n // 8), i))


_TITLE = re.compile(r"^[^\w\n]*(?:the )?(?:mit|isc|bsd [23][- ]clause) license\b.*$", re.IGNORECASE | re.MULTILINE)


def settled(found: list[tuple]) -> list[tuple]:
    """Of findings of one license that overlap the longest, in order; a text within another's that has it all goes."""
    out: list[tuple] = []
    for f in sorted(dict.fromkeys(found), key=lambda f: (f[0] - f[1], -f[5], -f[3], f[0])):
        if not any(f[2] == g[2] and f[0] < g[1] and g[0] < f[1] for g in out):
            out.append(f)
    whole = {CONTAINS[f[2]] for f in out if f[2] in CONTAINS}
    longest = {name: max((f[1] - f[0] for f in out if f[2] == name), default=0) for name in whole}
    return sorted(f for f in out if not (f[2] in whole and f[1] - f[0] == longest[f[2]] > 200))


SCHEMA = "doc_id long, start long, end long, license string, reduction double, runner_up string, agreement double, n_different long, differences string"


def scan_licenses(
    df: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, *, reduction: float = 0.25, agreement: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per license stated in a text: the range of its words (code points, end exclusive) and the license.

    ``reduction`` is the least share of a block's compressed length that a dictionary must save,
    ``agreement`` the least share of a template's words that the block must have in order. All
    licenses of at least ``reduction`` are compared. Equal reductions rank by name.

    A null or empty text has no blocks; a null id is passed on; repeated rows each give their rows;
    no rows give no rows. Columns other than the two named are never read. Texts are read in whole,
    however long a line is. A worker remembers the ranks of up to 10,000 short blocks.
    """
    templates = templates or TEMPLATES

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, agreement)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.int64()] * 3 + [pa.string(), pa.float64(), pa.string(), pa.float64(), pa.int64(), pa.string()]
        for batch in batches:
            for part in row_slices(batch, 1):
                rows = [(doc, *f) for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for f in scanner.scan(text or "", reduction)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, SCHEMA)
