"""License scans by a positional index of rare words.

A template is the wording of a licence or of a notice, with mandatory key phrases. It stands in a file at the place of
its first key phrase if every other key phrase stands, word by word, where the template has it, give or take the
template's drift (words that were added or left out in between).

1. One pass counts in how many files each word of the templates occurs; the sums, a row a word, give every word its
   inverse document frequency (IDF).
2. The index has the postings (template, phrase, position) of each key phrase's word of highest IDF. A file's words are
   looked up from the rarest on: a template whose rarest word the file lacks ends there, as does one that lacks any other
   of its key words. So no number of words to look up has to be set, and nothing that stands in a file is missed.
3. The postings met are places of the template's start. Those of all phrases are intersected within the drift, and the
   key phrases are verified where they meet.
4. The score of a place is the share of the template's IDF that stands within the drift of where it should; that of a
   file is its best, 0 without a hit.

Beside it, the base phrases of BASE_PHRASES are found word by word wherever they stand.

Each file depends on its own text and on the index only; what is sent around is the index and the IDF of the templates'
words, whose size is that of TEMPLATES. Words are runs of ASCII letters, digits and all characters beyond ASCII, in
ASCII lower case.

Defined results: a null text counts as empty; a file without words has no hits and score 0. Repeated rows get equal
results (and each counts in the document frequencies); null ids pass through; other columns are not looked at. Over an
empty table all words have the same IDF.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 256
# Phrases and their labels as the contract of the query has them.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Wordings of public licences. Label, text, mandatory key phrases.
WORDINGS = (
    ("mit", "released under the MIT License", ["MIT License"]),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software.""",
     ["Permission is hereby granted, free of charge", "deal in the Software without restriction", "this permission notice shall be included"]),
    ("apache", "licensed under the Apache License, Version 2.0", ["Apache License"]),
    ("apache", """you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed
        under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
     ["you may not use this file except in compliance with the License", "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"]),
    ("gpl", "this work is licensed under the GNU General Public License, version 3", ["General Public License"]),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
     ["you can redistribute it and/or modify", "as published by the Free Software Foundation"]),
    ("lgpl", "licensed under the GNU Lesser General Public License, version 3", ["Lesser General Public License"]),
    ("agpl", "licensed under the GNU Affero General Public License, version 3", ["Affero General Public License"]),
    ("bsd", "released under the BSD License", ["BSD License"]),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer.""",
     ["Redistribution and use in source and binary forms", "permitted provided that the following conditions are met"]),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
     ["for any purpose with or without fee is hereby granted", "this permission notice appear in all copies"]),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["Mozilla Public License"]),
    ("epl", "made available under the terms of the Eclipse Public License 2.0", ["Eclipse Public License"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["free and unencumbered software", "the public domain"]),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software.""",
     ["provided as is without any express or implied warranty", "In no event will the authors be held liable"]),
    ("cc0", "licensed under CC0 1.0", ["CC0 1.0"]),
)
# The parts of Creative Commons licences, and the versions that were published.
CC_PARTS = (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nd", "Attribution-NoDerivatives"), ("by-nc", "Attribution-NonCommercial"),
            ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"))
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
# Identifiers of the public list of licences and their labels.
SPDX_IDS = (("MIT", "mit"), ("Apache-2.0", "apache"), ("GPL-2.0", "gpl"), ("GPL-3.0", "gpl"), ("LGPL-2.1", "lgpl"), ("LGPL-3.0", "lgpl"), ("AGPL-3.0", "agpl"),
            ("BSD-2-Clause", "bsd"), ("BSD-3-Clause", "bsd"), ("ISC", "isc"), ("MPL-2.0", "mpl"), ("EPL-2.0", "epl"), ("Unlicense", "unlicense"), ("Zlib", "zlib"),
            ("CC0-1.0", "cc0"))

#: What bytes become before a text is split at spaces.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def words_of(text: str | bytes | None) -> list[bytes]:
    """The words of a text in ASCII lower case, as UTF-8."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_FOLD).split()


def _place(words: Sequence[bytes], phrase: Sequence[bytes]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


class Template:
    """A wording: its words, and each key phrase with its place among them."""

    def __init__(self, label: str, text: str, phrases: Sequence[str]):
        self.label, self.words = label, words_of(text)
        self.phrases = [(words_of(p), _place(self.words, words_of(p))) for p in phrases]
        self.required = frozenset(w for p, _ in self.phrases for w in p)
        #: How far, in words, a part may stand from where the template has it.
        self.drift = 4 + len(self.words) // 8


def all_templates() -> list[Template]:
    """The wordings, and those made by rule."""
    cc = [(f"cc-{p}", f"licensed under CC {p} {v}", [f"CC {p} {v}"]) for p, _ in CC_PARTS for v in CC_VERSIONS]
    spelled = [(f"cc-{p}", f"licensed under a Creative Commons {full} {v} license", [f"Creative Commons {full} {v}"]) for p, full in CC_PARTS for v in CC_VERSIONS]
    ids = [(label, f"SPDX-License-Identifier: {i}", [f"SPDX-License-Identifier: {i}"]) for i, label in SPDX_IDS]
    return [Template(*x) for x in (*WORDINGS, *cc, *spelled, *ids)]


TEMPLATES = all_templates()


@dataclass(frozen=True)
class Hit:
    """A template that stands in a file: the words of its key phrases, from start to end (exclusive)."""

    label: str
    template: int
    start: int
    end: int
    score: float


class Index:
    """Postings of the rarest word of each key phrase."""

    def __init__(self, templates: Sequence[Template], idf: Mapping[bytes, float]):
        self.templates, self.idf = templates, idf
        self.vocabulary = frozenset(w for t in templates for w in t.words)
        rarity = lambda w: (idf[w], w)
        #: anchors[t][k]: the rarest word of phrase k and its place in the phrase.
        self.anchors = [[max(((w, i) for i, w in enumerate(p)), key=lambda a: rarity(a[0])) for p, _ in t.phrases] for t in templates]
        #: templates by their rarest key word, rarest first.
        by = defaultdict(list)
        for k, t in enumerate(templates):
            by[max(t.required, key=rarity)].append(k)
        self.by_rarest = dict(sorted(by.items(), key=lambda x: rarity(x[0]), reverse=True))
        self.total = [math.fsum(idf[w] for w in t.words) for t in templates]

    def hits(self, words: Sequence[bytes], bag: set[bytes] | None = None) -> list[Hit]:
        """Every place at which a template stands."""
        bag = set(words) if bag is None else bag
        alive = [k for w, ks in self.by_rarest.items() if w in bag for k in ks if self.templates[k].required <= bag]
        if not alive:
            return []
        need = {w for k in alive for w in self.templates[k].words}
        places: dict[bytes, list[int]] = {w: [] for w in need}
        for i, w in enumerate(words):
            if w in need:
                places[w].append(i)
        return sorted((h for k in alive for h in self._standing(k, words, places)), key=lambda h: (h.start, h.end, h.template))

    def _standing(self, k: int, words: Sequence[bytes], places: Mapping[bytes, list[int]]) -> Iterator[Hit]:
        t = self.templates[k]
        # places of the template's start, by each phrase's rarest word
        starts = [[p - i - at for p in places[w]] for (w, i), (_, at) in zip(self.anchors[k], t.phrases, strict=True)]
        met = self._verified(t, 0, starts[0], words)
        for o in met:
            spots = [o + t.phrases[0][1]]
            for n in range(1, len(t.phrases)):
                near = starts[n][bisect_left(starts[n], o - t.drift) : bisect_left(starts[n], o + t.drift + 1)]
                # the nearest one that is verified
                near = self._verified(t, n, sorted(near, key=lambda s: (abs(s - o), s)), words)
                spot = next(near, None)
                if spot is None:
                    break
                spots.append(spot + t.phrases[n][1])
            else:
                ends = [s + len(p) for s, (p, _) in zip(spots, t.phrases, strict=True)]
                yield Hit(t.label, k, min(spots), max(ends), self._coverage(k, o, places))

    @staticmethod
    def _verified(t: Template, n: int, starts: Sequence[int], words: Sequence[bytes]) -> Iterator[int]:
        phrase, at = t.phrases[n]
        return (s for s in starts if s + at >= 0 and words[s + at : s + at + len(phrase)] == phrase)

    def _coverage(self, k: int, start: int, places: Mapping[bytes, list[int]]) -> float:
        """The share of a template's IDF whose words stand within the drift of their places."""
        t = self.templates[k]
        held = 0.0
        for i, w in enumerate(t.words):
            p = places[w]
            at = bisect_left(p, start + i - t.drift)
            if at < len(p) and p[at] <= start + i + t.drift:
                held += self.idf[w]
        return min(1.0, held / self.total[k])


def base_places(words: Sequence[bytes], bag: set[bytes], phrases: Sequence[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """(place, label) of every place where a base phrase's words stand."""
    out = []
    for phrase, label in phrases:
        if bag.issuperset(phrase):
            out += [(i, label) for i, w in enumerate(words) if w == phrase[0] and words[i : i + len(phrase)] == phrase]
    return sorted(out)


def inverse_frequencies(docs: DataFrame, vocabulary: frozenset[bytes], text: str = "text") -> dict[bytes, float]:
    """IDF of the given words over all texts, ln((1 + n) / (1 + df)) + 1. The result has a row a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for x in batch.slice(at, ROWS).column(0).to_pylist():
                    n.update(vocabulary.intersection(words_of(x)))
                    n[b""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.binary()), pa.array(n.values(), pa.int64())], names=["word", "n"])

    counted = docs.select(F.col(f"`{text}`").cast("binary").alias("text")).mapInArrow(run, "word binary, n long")
    n = {bytes(r[0]): r[1] for r in counted.groupBy("word").agg(F.sum("n")).collect()}
    return {w: math.log((1 + n.get(b"", 0)) / (1 + n.get(w, 0))) + 1 for w in sorted(vocabulary)}


HITS = "array<struct<label: string, template: int, start: long, end: long, score: double>>"


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text: str = "text", templates: Sequence[Template] = TEMPLATES, base_phrases: Sequence[tuple[str, str]] = BASE_PHRASES) -> DataFrame:
    """(id, n_words, base array<struct<label, start>>, hits array<struct<label, template, start, end, score>>, score) of
    each whole text; places are numbers of words, from 0."""
    index = Index(templates, inverse_frequencies(docs, frozenset(w for t in templates for w in t.words), text))
    shared = docs.sparkSession.sparkContext.broadcast((index, [(words_of(p), label) for p, label in base_phrases]))
    base_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    hit_type = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    schema = pa.schema([("n_words", pa.int64()), ("base", base_type), ("hits", hit_type), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, phrases = shared.value

        def read(x: bytes | None) -> tuple:
            words = words_of(x)
            bag = set(words)
            base = [{"label": label, "start": i} for i, label in base_places(words, bag, phrases)]
            hits = found.hits(words, bag)
            return len(words), base, [vars(h) for h in hits], max((h.score for h in hits), default=0.0)

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                columns = zip(*map(read, b.column(1).to_pylist()), strict=True)
                made = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), *made], names=[id_column, *schema.names])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_column}`"), F.col(f"`{text}`").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"`{id_column}` {kind}, n_words long, base array<struct<label: string, start: long>>, hits {HITS}, score double")
