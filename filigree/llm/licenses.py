"""License scans by a positional index of rare words.

Base: places where the words of fixed phrases stand in a row.  The method goes
further: templates of licence statements are indexed by word and position;
the postings of each template's words of highest inverse document frequency,
as many as no alignment that passes can lack together, name the (template,
relative position) pairs of a file, and each is scored by the share of template
words, weighted by inverse frequency, that stand where the template has them;
enough words must agree.  No alignment is lost, whatever else the file states.  A template's
label is given if its mandatory key phrase is also there.

Document frequencies of the templates' few hundred words are counted over all
documents; the index, its frequencies and the phrases are all that is shipped.

Defined cases: a null or wordless text has no words, places or labels and
score 0; repeated rows are handled alike; words are numbered from 0 over the
whole text, however long; of alignments of one template the best score counts;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

#: Phrases and labels of the base.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Templates of our own: label, mandatory key phrase, statement.
TEMPLATES = [
    ("apache-2.0", "apache license", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "apache license", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE 2 0 apache license"),
    ("mit", "mit license", "Released under the MIT License"),
    ("mit", "free of charge", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "general public license", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "general public license", "redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "lesser general public license", "licensed under the GNU Lesser General Public License"),
    ("agpl", "affero general public license", "licensed under the GNU Affero General Public License"),
    ("bsd", "source and binary forms", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "mozilla public license", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "with or without fee", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "public domain", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "cc by nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "cc by sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "cc by 4 0", "Licensed under CC BY 4.0"),
    ("copyright", "all rights reserved", "Copyright. All rights reserved"),
    (
        "mit",
        "free of charge",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "apache-2.0",
        "apache license",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "bsd-3-clause",
        "neither the name",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "gpl",
        "general public license",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "isc",
        "with or without fee",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in "
        "all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    (
        "zlib",
        "express or implied warranty",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to "
        "anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ),
    (
        "unlicense",
        "public domain",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "mpl-2.0",
        "mozilla public license",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
]

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_FILTER_BITS = 16


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z lower-cased, and their documents."""
    starts, ends, doc = tk.runs(_WORD[data], offsets)
    return tk.span_hash(tk.prefix_hash(data, lower=True), starts, ends), doc


def hashed(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words_of(data, np.array([0, len(data)]))[0]


@dataclass
class Index:
    """Vocabulary (sorted hashes), its postings (template, position) and the phrases."""

    vocabulary: np.ndarray
    postings: list[list[tuple[int, int]]]
    templates: list[np.ndarray]  # of vocabulary numbers
    keys: list[np.ndarray]
    phrases: list[np.ndarray]
    near: np.ndarray  # which low hash bits the vocabulary has

    @classmethod
    def build(cls) -> Index:
        texts = [hashed(t) for _, _, t in TEMPLATES]
        phrases = [hashed(p) for p in PHRASES]
        keys = [hashed(k) for _, k, _ in TEMPLATES]
        vocabulary = np.unique(np.concatenate([*texts, *phrases, *keys]))
        postings: list[list[tuple[int, int]]] = [[] for _ in vocabulary]
        numbers = lambda h: np.searchsorted(vocabulary, h)
        for t, h in enumerate(texts):
            for position, v in enumerate(numbers(h).tolist()):
                postings[v].append((t, position))
        near = np.zeros(1 << _FILTER_BITS, bool)
        near[(vocabulary >> tk.U64(64 - _FILTER_BITS)).astype(np.int64)] = True
        return cls(vocabulary, postings, [numbers(h) for h in texts], [numbers(h) for h in keys], [numbers(h) for h in phrases], near)

    def known(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words of the vocabulary, and their numbers."""
        at = np.flatnonzero(self.near[(words >> tk.U64(64 - _FILTER_BITS)).astype(np.int64)])
        number = np.minimum(np.searchsorted(self.vocabulary, words[at]), len(self.vocabulary) - 1)
        hit = self.vocabulary[number] == words[at]
        return at[hit], number[hit]


def places(phrase: np.ndarray, at: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Starts of the phrase among the known words of one document or of many that are kept apart."""
    m = len(at) - len(phrase) + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    ok = np.ones(m, bool)
    for k, v in enumerate(phrase):
        ok &= (number[k : k + m] == v) & (at[k : k + m] == at[:m] + k)
    return at[:m][ok]


def seeds(index: Index, idf: np.ndarray, share: float) -> dict[int, list[tuple[int, int]]]:
    """Postings by word of each template's rarest words: without all of them, its score is under ``share``."""
    out: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for template, own in enumerate(index.templates):
        weight = idf[own]
        order = np.argsort(-weight, kind="stable")
        rest = weight.sum() - np.cumsum(weight[order])
        enough = int(np.argmax(rest < share * weight.sum() * (1 - 1e-9))) + 1
        for position in order[:enough].tolist():
            out[int(own[position])].append((template, position))
    return out


def align(index: Index, idf: np.ndarray, at: np.ndarray, number: np.ndarray, rare: dict[int, list[tuple[int, int]]], agree: int, share: float) -> dict[int, float]:
    """Templates that align with a document's known words, and their scores."""
    word_at = dict(zip(at.tolist(), number.tolist()))
    alignments = {(template, spot - position) for spot, v in word_at.items() for template, position in rare.get(v, ())}
    present = set(number.tolist())
    found: dict[int, float] = {}
    key: dict[int, bool] = {}
    for template, shift in alignments:
        own = index.templates[template]
        words = own.tolist()
        hit = np.array([word_at.get(shift + p) == v for p, v in enumerate(words)])
        agreed = len(set(own[hit].tolist()))
        if agreed < max(2, min(agree, len(present.intersection(words)))):
            continue
        weight = idf[own]
        score = float(weight[hit].sum() / weight.sum())
        if score >= share and score > found.get(template, 0):
            if template not in key:
                key[template] = len(places(index.keys[template], at, number)) > 0
            if key[template]:
                found[template] = score
    return found


def frequencies(docs: DataFrame, index: Index) -> np.ndarray:
    """Inverse document frequencies of the vocabulary over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(index.vocabulary), np.int64), 0
        for batch in batches:
            data, offsets = tk.utf8(batch.column(0))
            n += len(batch)
            for _, _, d, o in tk.blocks(data, offsets):
                words, doc = words_of(d, o)
                at, number = index.known(words)
                df += np.bincount(np.unique(doc[at] * len(df) + number) % len(df), minlength=len(df))
        seen = np.flatnonzero(df)
        yield pa.record_batch({"v": np.append(seen, -1), "n": np.append(df[seen], n)})

    counts = {r.v: r.n for r in docs.select("text").mapInArrow(run, "v long, n long").groupBy("v").agg(F.sum("n").alias("n")).collect()}
    n = counts.pop(-1, 0) or 0
    df = np.array([counts.get(v, 0) for v in range(len(index.vocabulary))], float)
    return np.log((n + 1) / (df + 0.5)).clip(0.1)


def scan(docs: DataFrame, agree: int = 3, share: float = 0.7) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each document."""
    index = Index.build()
    idf = frequencies(docs, index)
    rare = seeds(index, idf, share)
    names = list(PHRASES.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            data, offsets = tk.utf8(batch.column(1))
            n_words, n_base = np.zeros(n, np.int64), np.zeros(n, np.int64)
            first, last = np.full(n, -1), np.full(n, -1)
            base_labels, labels, score = [""] * n, [""] * n, np.zeros(n)
            for lo, hi, d, o in tk.blocks(data, offsets):
                words, doc = words_of(d, o)
                count = np.bincount(doc, minlength=hi - lo)
                n_words[lo:hi] = count
                begin = np.concatenate([[0], np.cumsum(count)])
                at, number = index.known(words)
                owner = doc[at]
                # a gap between documents keeps phrases inside one
                apart = at + owner
                found: dict[int, set[str]] = defaultdict(set)
                for phrase, name in zip(index.phrases, names):
                    starts = places(phrase, apart, number)
                    if not len(starts):
                        continue
                    whose = owner[np.searchsorted(apart, starts)]
                    within = starts - whose - begin[whose]
                    n_base[lo:hi] += np.bincount(whose, minlength=hi - lo)
                    for w, p in zip(whose.tolist(), within.tolist()):
                        found[w].add(name)
                        i = lo + w
                        first[i] = p if first[i] < 0 else min(first[i], p)
                        last[i] = max(last[i], p)
                cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
                for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(owner)).tolist()):
                    w = int(owner[a])
                    own = align(index, idf, at[a:b] - begin[w], number[a:b], rare, agree, share) if b - a > 1 else {}
                    if own or w in found:
                        base = found.get(w, set())
                        base_labels[lo + w] = ",".join(sorted(base))
                        labels[lo + w] = ",".join(sorted(base | {TEMPLATES[t][0] for t in own}))
                        score[lo + w] = max([1.0 if base else 0.0, *own.values()])
            none = n_base == 0
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0),
                    "n_words": n_words,
                    "n_base": n_base,
                    "first_word": pa.array(first, pa.int64(), mask=none),
                    "last_word": pa.array(last, pa.int64(), mask=none),
                    "base_labels": base_labels,
                    "labels": labels,
                    "score": np.minimum(score, 1.0),
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
