"""License scan by conditional compression, confirmed by exact wording.

1. Words are numbered over line ends and comment marks. Word pairs that also stand in a template vote for the place
   where it would begin; a place with as many votes as an allowed change of wording must leave is a candidate block.
2. Each template with a candidate there compresses the block as a raw zstandard dictionary; templates are ranked by
   the bytes they save against the block compressed alone.
3. In that order the exact wording is compared, until one is confirmed. It takes its part of the block; what is left
   before and behind is tried again, so statements side by side are all found.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import map_arrow, slices, text_bytes
from strandline.llm.shingles import Powers, _chain, word_hashes

# Usual statements of well-known licences, by identifier, from a line to a whole licence.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
}


@dataclass(frozen=True)
class Scan:
    """least_saved: share of a part's own compressed size that its template must save; most_changed: share of
    differing words that still confirms it."""

    least_saved: float = 0.25
    most_changed: float = 0.2
    level: int = 3


#: A word is a run of letters, digits and plus signs of ASCII.
_WORD = re.compile(rb"[a-z0-9+]+")
_GAP = np.ones(256, bool)
_GAP[np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+", np.uint8)] = False
#: Words that tell licences apart which are otherwise worded alike; so do numbers.
_TELLING = {"lesser", "library", "affero", "noncommercial", "sharealike", "noderivatives", "noderivs", "nc", "sa", "nd"}


def words_of(text: str) -> list[str]:
    return [w.decode() for w in _WORD.findall(text.encode().lower())]


def telling(words: list[str]) -> set[str]:
    return {w for w in words if w in _TELLING or w.strip("0").isdigit() or (w[:1] == "v" and w[1:].strip("0").isdigit())}


def alignment(have: list[str], want: list[str]) -> tuple[float, int, int]:
    """(words changed, missing or put in between as a share of want, start, end) of the best place of want in have."""
    near = difflib.SequenceMatcher(None, have, want, autojunk=False)
    core = near.find_longest_match()
    if not core.size:
        return 1.0, 0, 0
    slack = len(want) // 4 + 1
    lo = max(0, core.a - core.b - slack)
    hi = core.a + len(want) - core.b + slack
    blocks = [m for m in difflib.SequenceMatcher(None, have[lo:hi], want, autojunk=False).get_matching_blocks() if m.size]
    best = (1.0, 0, 0)
    for i in range(len(blocks)):
        same = 0
        for j in range(i, len(blocks)):
            same += blocks[j].size
            inside = blocks[j].a + blocks[j].size - blocks[i].a
            best = min(best, (((len(want) - same) + (inside - same)) / len(want), lo + blocks[i].a, lo + blocks[j].a + blocks[j].size))
    return best


def wording_difference(have: list[str], want: list[str]) -> float:
    """Words changed, missing or put in between, as a share of the template; words around it are free."""
    return alignment(have, want)[0]


class Matcher:
    """One scan's templates, ready for a Python worker."""

    def __init__(self, templates: dict[str, list[str]], s: Scan):
        self.s, self.powers = s, Powers()
        self.alone = zstandard.ZstdCompressor(level=s.level)
        self.names, self.want, self.with_template = [], [], []
        votes = []
        for name, texts in templates.items():
            for text in texts:
                want = words_of(text)
                if len(want) < 2:
                    raise ValueError(f"a template of {name} has fewer than two words")
                raw = zstandard.ZstdCompressionDict(" ".join(want).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                pairs = _chain(word_hashes(np.frombuffer(" ".join(want).encode(), np.uint8), self.powers, _GAP)[2], 2)
                votes += [(h, len(self.names), k) for k, h in enumerate(pairs.tolist())]
                self.names.append(name)
                self.want.append(want)
                self.with_template.append(zstandard.ZstdCompressor(level=s.level, dict_data=raw))
        size = np.array([len(w) for w in self.want], np.int64)
        self.size, self.slack = size, size // 4 + 1
        self.widest = int((size + 4 * self.slack).max(initial=0))
        # Every changed word breaks two pairs at most, so this many are left of a statement that can be confirmed.
        self.need = np.maximum(1, np.ceil(size - 1 - 2 * s.most_changed * size - 1e-9)).astype(np.int64)
        votes.sort()
        pair = np.array([v[0] for v in votes], np.uint64)
        self.of, self.at = (np.array([v[i] for v in votes], np.int64) for i in (1, 2))
        self.pairs, self.first = np.unique(pair, return_index=True)
        self.count = np.diff(np.append(self.first, len(pair)))
        self.seen: dict[str, list] = {}

    def windows(self, pairs: np.ndarray) -> list[tuple[int, int, int]]:
        """(first word, end, template) of the places with votes enough; places may reach beyond the text."""
        if not len(self.pairs):
            return []
        near = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        pos = np.flatnonzero(self.pairs[near] == pairs)
        near, many = near[pos], self.count[near[pos]]
        vote = np.arange(many.sum()) + np.repeat(self.first[near] - np.cumsum(many) + many, many)
        of, start = self.of[vote], np.repeat(pos, many) - self.at[vote]
        order = np.lexsort((start, of))
        of, start = of[order], start[order]
        far = np.int64(1) << np.int64(40)
        key = of * far + start
        enough = np.searchsorted(key, key + 2 * self.slack[of], side="right") - np.arange(len(key)) >= self.need[of]
        out, last = [], (-1, 0)
        for t, a in zip(of[enough].tolist(), start[enough].tolist(), strict=True):
            if t != last[0] or a > last[1] + 2 * int(self.slack[t]):
                last = t, a
                out.append((a - int(self.slack[t]), a + int(self.size[t] + 3 * self.slack[t]), t))
        return sorted(out)

    def find(self, texts: pa.Array) -> list[list[tuple[int, int, str, float, float]]]:
        """For each text (start byte, end byte, licence, share saved, share of words changed) of all confirmed parts."""
        buffer, offsets = text_bytes(texts)
        base, out = offsets[0], [[] for _ in texts]
        data = np.frombuffer(buffer, np.uint8)[base : offsets[-1]]
        starts, ends, words = word_hashes(data, self.powers, _GAP)
        bounds = np.searchsorted(starts, np.array(offsets[1:]) - base)
        todo: dict[int, list] = {}
        for lo, hi, t in self.windows(_chain(words, 2)):
            # A place near a border between texts is tried on both sides.
            i = int(np.searchsorted(bounds, max(lo, 0), side="right"))
            while i < len(bounds) and (bounds[i - 1] if i else 0) < hi:
                todo.setdefault(i, []).append((lo, hi, t))
                i += 1
        for i, windows in todo.items():
            first, end = int(bounds[i - 1]) if i else 0, int(bounds[i])
            own = bytes(data[offsets[i] - base : offsets[i + 1] - base])
            shift = offsets[i] - base
            have = [own[a - shift : b - shift].lower().decode() for a, b in zip(starts[first:end], ends[first:end], strict=True)]
            windows = [(max(0, lo - first), min(end - first, hi - first), t) for lo, hi, t in windows if lo < end and hi > first]
            found = self.resolve(have, windows, 0, len(have))
            out[i] = [(int(starts[first + a]) - shift, int(ends[first + b - 1]) - shift, *rest) for a, b, *rest in found]
        return out

    def resolve(self, have: list[str], windows: list[tuple[int, int, int]], lo: int, hi: int) -> list[tuple[int, int, str, float, float]]:
        """All confirmed parts of have[lo:hi], windows sorted by their starts."""
        out, k = [], 0
        while k < len(windows):
            a, b = max(windows[k][0], lo), min(windows[k][1], hi)
            group = [w for w in islice(windows, k, bisect.bisect_left(windows, (b,), k)) if w[1] > a]
            b = min(hi, max(w[1] for w in group)) if group else b
            hit = self.confirm(have[a:b], sorted({w[2] for w in group})) if b > a else None
            if hit is None:
                k += 1
                continue
            x, y, *rest = hit
            if x > 1:
                reach = bisect.bisect_left(windows, (a - self.widest,)), bisect.bisect_left(windows, (a + x,))
                out += self.resolve(have, [w for w in windows[slice(*reach)] if w[1] > a], a, a + x)
            out.append((a + x, a + y, *rest))
            lo = a + y
            while k < len(windows) and windows[k][1] <= lo:
                k += 1
        return out

    def confirm(self, block: list[str], of: list[int]) -> tuple[int, int, str, float, float] | None:
        """The first template, by bytes saved over the block, whose wording is confirmed; words of the block it takes."""
        key = " ".join([*block, *map(str, of)])
        if key not in self.seen:
            if len(self.seen) > 20_000:
                self.seen.clear()
            self.seen[key] = self._confirm(block, of)
        return self.seen[key]

    def _confirm(self, block: list[str], of: list[int]) -> tuple[int, int, str, float, float] | None:
        text = " ".join(block).encode()
        ranked = sorted((len(self.with_template[t].compress(text)), t) for t in of)
        for _, t in ranked:
            changed, a, b = alignment(block, self.want[t])
            if changed > self.s.most_changed + 1e-9 or telling(block[a:b]) != telling(self.want[t]):
                continue
            part = " ".join(block[a:b]).encode()
            own = len(self.alone.compress(part))
            saved = (own - len(self.with_template[t].compress(part))) / own
            if saved >= self.s.least_saved:
                return a, b, self.names[t], saved, changed
        return None


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, s: Scan = Scan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, licenses (sorted distinct identifiers), spans of confirmed parts.

    spans: array of (start, end, license, saved, changed), byte bounds in the text. A document
    without confirmed statement, with an empty or a null text has empty arrays. Repeated rows give repeated
    rows, an empty table an empty one; very long texts are read whole; other columns, whatever their names, are
    not read. Ties between templates go to the one named first. A template of one word is refused.
    """
    templates = templates or TEMPLATES
    Matcher(templates, s)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, licenses array<string>, spans array<struct<start:bigint,end:bigint,license:string,saved:double,changed:double>>"
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("saved", pa.float64()), ("changed", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, s)
        for batch in slices(batches, "text", 512, 2_000_000):
            found = matcher.find(batch.column("text"))
            spans = [[dict(zip(("start", "end", "license", "saved", "changed"), x, strict=True)) for x in own] for own in found]
            names = [sorted({x[2] for x in own}) for own in found]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(span))], names=["id", "licenses", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, schema).withColumnRenamed("id", id_col)
