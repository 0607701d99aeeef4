"""Licence scans with a generalised suffix automaton of licence tokens.

The automaton is built over the token sequences of all templates. Every text streams through it once; after each word
the state and the match length tell the longest template passage that ends there (matching statistics). Matches that
cannot be prolonged and reach ``min_match`` words are placed in their templates and chained in template order; a template
counts as found when its chain covers at least ``min_cover`` of its words and holds a passage that no other template has, so that
wording common to several licences names none of them. Short phrase templates must match whole.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. Null or empty text: no words, no labels,
score 0. Equal rows give equal results. An empty table gives no row.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Passages of public licences and notices by label, word for word.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
}

#: Byte table: letters A-Z folded, every byte that is no part of a word made a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

COLUMNS = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())])))]
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,cover:double>>"


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Automaton:
    """Suffix automaton of several token sequences; each state knows one place where its strings end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for s, sequence in enumerate(sequences):
            last = 0
            for k, token in enumerate(sequence):
                last = self.extend(last, token)
                self.ends[last].add((s, k))
        for state in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            self.ends[self.link[state]] |= self.ends[state]
        self.ends[0] = set()

    def state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.len.append(length)
        self.ends.append(set())
        return len(self.len) - 1

    def split(self, p: int, token: int) -> int:
        """The state of p's longest string followed by token, split off if it is held together with longer ones."""
        q = self.next[p][token]
        if self.len[q] == self.len[p] + 1:
            return q
        clone = self.state(self.len[p] + 1)
        self.next[clone] = dict(self.next[q])
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self.split(last, token)
        new, p = self.state(self.len[last] + 1), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        self.link[new] = self.split(p, token) if p >= 0 else 0
        return new

    def walk(self, sequence: list[int]) -> int:
        state = 0
        for token in sequence:
            state = self.next[state][token]
        return state

    def matches(self, tokens: list[int], base: int) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) after each token that is in the alphabet; the match is the longest suffix in a template."""
        state = length = 0
        step, link, size = self.next, self.link, self.len
        for k, token in enumerate(tokens, base):
            while state and token not in step[state]:
                state = link[state]
                length = size[state]
            if token in step[state]:
                state, length = step[state][token], length + 1
            else:
                state = length = 0
            yield k, length, state


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str], min_match: int = 5, min_cover: float = 0.5, max_gap: int = 40):
        self.min_match, self.min_cover, self.max_gap = min_match, min_cover, max_gap
        self.labels, sequences = [], []
        for label, text in [*((v, k) for k, v in phrases.items()), *templates.items()]:
            self.labels.append(label)
            sequences.append(words(text.encode()))
        self.n_phrases = len(phrases)
        self.alphabet = {w: k for k, w in enumerate(dict.fromkeys(w for s in sequences for w in s))}
        self.size = [len(s) for s in sequences]
        self.automaton = a = Automaton([[self.alphabet[w] for w in s] for s in sequences])
        #: Phrases that are suffixes of a state's longest string; suffix links hand them down.
        own = defaultdict(list)
        for t in range(self.n_phrases):
            own[a.walk([self.alphabet[w] for w in sequences[t]])].append(t)
        self.phrases_at: dict[int, list[int]] = {}
        for state in sorted(range(1, len(a.len)), key=a.len.__getitem__):
            if found := own.get(state, []) + self.phrases_at.get(a.link[state], []):
                self.phrases_at[state] = found
        self.shortest = min(self.size)

    def scan(self, text: bytes) -> tuple:
        found = words(text)
        get = self.alphabet.get
        tokens = [get(w, -1) for w in found]
        base: list[tuple[int, int]] = []
        places: dict[int, list[tuple[int, int, int, bool]]] = defaultdict(list)
        for start, stop in runs(tokens, self.shortest):
            before = (0, 0, 0)
            for end, length, state in self.automaton.matches(tokens[start:stop], start):
                for t in self.phrases_at.get(state, ()):
                    if length >= self.size[t]:
                        base.append((end - self.size[t] + 1, t))
                if length <= before[1]:
                    self.place(before, places)
                before = (end, length, state)
            self.place(before, places)
        spans = [(self.labels[t], at, at + self.size[t], 1.0) for at, t in base]
        best = 1.0 if base else 0.0
        for t, found_at in places.items():
            for start, stop, cover, own in self.chains(found_at, self.size[t]):
                best = max(best, cover)
                if own and cover >= self.min_cover:
                    spans.append((self.labels[t], start, stop, cover))
        spans = sorted(set(spans))
        starts = [at for at, _ in base]
        base_labels = ",".join(sorted({self.labels[t] for _, t in base}))
        return len(found), len(base), min(starts, default=None), max(starts, default=None), base_labels, ",".join(sorted({s[0] for s in spans})), best, [dict(zip(("label", "start", "end", "cover"), s, strict=True)) for s in spans]

    def place(self, match: tuple[int, int, int], places: dict) -> None:
        """Note a match that could not be prolonged, in every template that holds it."""
        end, length, state = match
        if length >= self.min_match:
            held = [(t, k) for t, k in self.automaton.ends[state] if t >= self.n_phrases]
            own = len({t for t, _ in held}) == 1
            for t, k in held:
                places[t].append((end - length + 1, k - length + 1, length, own))

    def chains(self, found: list[tuple[int, int, int, bool]], size: int) -> Iterator[tuple[int, int, float, bool]]:
        """The heaviest chains of matches that follow each other in the text and in the template: (start, stop, part of the
        template, and whether a passage of the chain is in this template alone).

        A match continues the chain that covers most, among those that end before it in both and at most ``max_gap`` words
        ahead of it in the text; what overlaps counts once. Only matches that end less than a match and a gap before its own
        end can be continued, so the work is linear in the text. Of chains with the same first match the heaviest counts.
        """
        found = sorted(found, key=lambda m: (m[0] + m[2], m[1]))
        ends = [begin + length for begin, _, length, _ in found]
        weight, first, alone = [], [], []
        for i, (begin, place, length, own) in enumerate(found):
            most, root, single = length, begin, own
            for j in range(bisect_left(ends, begin - self.max_gap), bisect_left(ends, ends[i])):
                at = found[j][1] + found[j][2]
                gain = length - max(0, at - place, ends[j] - begin)
                if at < place + length and gain > 0 and weight[j] + gain >= most:
                    most, root, single = weight[j] + gain, first[j], alone[j] or own
            weight.append(most)
            first.append(root)
            alone.append(single)
        best: dict[int, int] = {}
        for i, root in enumerate(first):
            if root not in best or weight[i] > weight[best[root]]:
                best[root] = i
        for root, i in sorted(best.items()):
            yield root, ends[i], min(1.0, weight[i] / size), alone[i]


def runs(tokens: list[int], least: int) -> Iterator[tuple[int, int]]:
    """Stretches of at least ``least`` tokens that are all in the alphabet."""
    import numpy as np

    inside = np.array(tokens, np.int32) >= 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if b - a >= least:
            yield a, b


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """A row per document: base phrase places, labels of the chained templates and their spans (in words)."""
    common.ensure_workers(docs.sparkSession)
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    schema = pa.schema(COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases, **limits)
        rows = ((key, *scanner.scan(text.as_py() or b"")) for batch in batches for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True))
        yield from common.batches_of(rows, schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
