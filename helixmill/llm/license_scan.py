"""License notices found by MinHash bands over overlapping text windows.

Texts and templates are words (runs of digits, ASCII letters and non-ASCII
characters, A-Z lower-cased). A template's windows start at each of its words; a
document's windows of ``n`` words start at every ``step``-th word, for each (n, step)
of ``WINDOWS``; a template uses the longest windows with which a verbatim copy of it
always covers a whole document window, that is, at least n + step - 1 words. Each
window's ``WIDTH``-word shingles give ``BANDS`` bands of ``ROWS`` minima; windows of
similarity s share a band with probability 1 - (1 - s ** ROWS) ** BANDS, 0.999995 at
0.8 and 1 for equal windows. Where a band is shared, the share of the template's
shingles that the document holds around that place is counted; ``CONTAINED`` and more
is a match.

Templates are a parameter of bounded size (``TEMPLATE_BYTES``); documents are read
once, without a shuffle.

Cases: null and empty texts match nothing; templates of fewer than WIDTH words are
refused; overlapping matches of one template are one, and of different templates one goes
of whose words a better contained one holds half; rows that repeat count each time; null
ids are handed on; extra columns are not read; a very long text is one slice of its own;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from helixmill.llm import grams as G
from helixmill.llm.common import bounded_batches, slices, utf8

WIDTH, CONTAINED = 5, 0.8
WINDOWS = [(5, 1), (8, 2), (16, 4)]
BANDS, ROWS = 12, 2
TEMPLATE_BYTES = 16 << 20

# Public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
}


def _bands(shingles: np.ndarray, n: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each band, (window starts, band keys); windows may cross documents."""
    size = n - WIDTH + 1
    count = len(shingles) - size + 1
    if count <= 0:
        return
    starts = np.arange(0, count, step)
    factors = G.constants(BANDS * ROWS)
    for band in range(BANDS):
        key = np.full(len(starts), band + 1, G.U)
        for r in range(ROWS):
            h = (shingles * factors[band * ROWS + r]) >> G.U(32)
            done, least = 1, h
            while done < size:  # minimum over ever longer runs
                more = min(done, size - done)
                least = np.minimum(least[: len(least) - more], least[more:])
                done += more
            key = key * G.U(0x9E3779B97F4A7C15) + least[starts]
        yield starts, G.mix(key)


def _best(found: list[tuple]) -> list[tuple]:
    """Matches of whose words no better contained match holds half or more: of versions that
    differ by a word the right one stays, and a notice stays beside a shorter one inside it."""
    found, out = sorted(found, key=lambda m: (m[1], m[2])), []
    longest = max((m[2] - m[1] for m in found), default=0)
    beats = lambda x, m: x[3] > m[3] and 2 * (min(x[2], m[2]) - max(x[1], m[1])) >= m[2] - m[1]
    for i, m in enumerate(found):
        beaten, j = False, i - 1
        while j >= 0 and found[j][1] > m[1] - longest and not beaten:
            beaten, j = beats(found[j], m), j - 1
        j = i + 1
        while j < len(found) and found[j][1] < m[2] and not beaten:
            beaten, j = beats(found[j], m), j + 1
        if not beaten:
            out.append(m)
    return out


class Templates:
    def __init__(self, templates: dict[str, str]):
        if sum(len(t.encode()) for t in templates.values()) > TEMPLATE_BYTES:
            raise ValueError("templates are larger than TEMPLATE_BYTES; scan them in parts")
        self.ids = list(templates)
        self.sets, self.length, self.places = [], [], []
        entries: dict[tuple[int, int], list[list[np.ndarray]]] = {}
        for t, text in enumerate(templates.values()):
            raw, at = utf8(pa.array([text], pa.large_string()))
            h = G.words(raw, at, G.ALNUM).hashes
            if len(h) < WIDTH:
                raise ValueError(f"template {self.ids[t]} has fewer than {WIDTH} words")
            g = G.grams(h, WIDTH)
            self.sets.append(np.unique(g))
            self.length.append(len(h))
            order = np.argsort(g, kind="stable")
            self.places.append((g[order], order))
            window = max(w for w in WINDOWS if len(h) >= w[0] + w[1] - 1)
            for starts, keys in _bands(g, window[0], 1):
                entries.setdefault(window, []).append([keys, np.full(len(keys), t), starts])
        self.windows = {w: (G.Index(np.concatenate([e[0] for e in v])), np.concatenate([e[1] for e in v]), np.concatenate([e[2] for e in v])) for w, v in entries.items()}

    def _aligned(self, t: int, values: np.ndarray, at: np.ndarray, slack: int) -> np.ndarray:
        """Which shingles stand within ``slack`` words of their place in the template."""
        keys, order = self.places[t]
        row, end = np.searchsorted(keys, values), np.searchsorted(keys, values, "right")
        ok = np.zeros(len(values), bool)
        while (more := row < end).any():
            ok[more] |= np.abs(at[more] - order[row[more]]) <= slack
            row = row + 1
        return ok

    def matches(self, w: G.Words) -> list[list[tuple[str, int, int, float]]]:
        """Per document: (template, first word, end word, contained share)."""
        found: list[list] = [[] for _ in range(len(w.first) - 1)]
        g = G.grams(w.hashes, WIDTH)
        doc, room = G.doc_of(w.first), G.room(w.first)
        seen = set()
        for (n, step), (index, template, offset) in self.windows.items():
            for starts, keys in _bands(g, n, step):
                hit, row = index.find(keys)
                p = starts[hit]
                places = np.stack([doc[p], template[row], p - offset[row]])[:, room[p] >= n]
                seen.update(map(tuple, np.unique(places, axis=1).T.tolist()))
        for d, t, at in sorted(seen):
            slack = self.length[t] // 5 + 2
            first, last = int(w.first[d]), int(w.first[d + 1])
            if found[d] and (m := found[d][-1])[0] == t and at >= m[1] and at + self.length[t] <= m[2]:
                continue
            lo, hi = max(first, at - slack), min(last, at + self.length[t] + slack) - WIDTH + 1
            here = np.flatnonzero(np.isin(g[lo:hi], self.sets[t]))
            share = len(np.unique(g[lo:hi][here])) / len(self.sets[t])
            if share >= CONTAINED:
                # copies may follow each other: the match ends with its own copy's shingles
                own = here[self._aligned(t, g[lo:hi][here], lo + here - at, slack)]
                if len(np.unique(g[lo:hi][own])) / len(self.sets[t]) >= CONTAINED:
                    here = own
                elif found[d] and (m := found[d][-1])[0] == t and m[1] <= at < m[2]:
                    continue
                a, b = lo + int(here[0]), lo + int(here[-1]) + WIDTH
                if found[d] and found[d][-1][0] == t and a < found[d][-1][2]:
                    m = found[d][-1]
                    found[d][-1] = (t, min(a, m[1]), max(b, m[2]), max(share, m[3]))
                else:
                    found[d].append((t, a, b, share))
        found = [_best(x) for x in found]
        return [[(self.ids[t], a - int(w.first[d]), b - int(w.first[d]), s) for t, a, b, s in x] for d, x in enumerate(found)]


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_matches, licenses (ids, sorted, comma-joined) and
    matches (id:first word:end word, by place)."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(Templates(TEMPLATES if templates is None else templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = G.words(*utf8(b.column(1)), G.ALNUM)
            found = sent.value.matches(w)
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(np.diff(w.first)), pa.array([len(x) for x in found], pa.int64()),
                pa.array([",".join(sorted({m[0] for m in x})) for x in found], pa.string()),
                pa.array([",".join(f"{i}:{lo}:{hi}" for i, lo, hi, _ in sorted(x, key=lambda m: (m[1], m[0]))) for x in found], pa.string()),
            ], ["doc_id", "n_words", "n_matches", "licenses", "matches"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_matches long, licenses string, matches string")
