"""License scans by a positional rare-token index.

Words are runs of ASCII letters (lower-cased), digits and all bytes from 0x80 on. The templates' words are weighed by
their inverse document frequency over all documents (one pass that counts, for the templates' few hundred words only,
the documents that hold them). Only a template whose mandatory phrases all stand in the text can be found; of each such
template the `rare` highest-IDF words that the text holds are looked up in an index of its positions, so no template's words hide another's; each occurrence votes for (template, place where the template would begin). Votes of several
rare words at nearly one place are an intersection by relative position. A candidate is then verified: every
mandatory key phrase of the template must stand in the text, near that place.

A licence has several templates under one label: the notice that stands in source files, and parts of its text. Versions are
labels of their own, told apart by their mandatory phrases; a family's label (bsd, gpl, lgpl) is found besides its version's. Further
templates come from a table (`templates_of`), so a user's own licences are looked up in the same index.

Base labels are exact: all places where a phrase's words stand one after the other.

Defined results: null or empty text has no words; repeated rows get equal results; null ids stay null; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import log
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, pieces, texts_of

#: Phrases whose places are counted, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Label -> (opening words of a well-known public licence notice, phrases of it that must be there).
TEMPLATES = {
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    "apache-2": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license",)),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use", "source and binary forms")),
    "gpl": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("gnu general public license",)),
    "lgpl": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    "mpl-2": ("this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    "cc-by-nc": ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial 4 0",)),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee")),
    "unlicense": ("this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
    "proprietary": ("all rights reserved unauthorized copying of this file via any medium is strictly prohibited", ("all rights reserved",)),
}
#: Label -> (notice of one version of a licence, phrases of it that must be there).
VERSIONS = {
    "gpl-2": ("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ("gnu general public license", "version 2 of the license")),
    "gpl-3": ("under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license", "version 3 of the license")),
    "lgpl-2.1": ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", ("gnu lesser general public license", "version 2 1 of the license")),
    "lgpl-3": ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version", ("gnu lesser general public license", "version 3 of the license")),
    "agpl-3": ("under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu affero general public license", "version 3 of the license")),
    "cc-by-sa": ("this work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike 4 0",)),
    "cc-by-nc-nd": ("this work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", ("creative commons attribution noncommercial noderivatives",)),
    "epl-2": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", ("eclipse public license 2 0",)),
    "bsl-1": ("Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at", ("boost software license version 1 0",)),
}
#: Fixed values: (label, part of a licence's own text, phrases of it that must be there).
TEXTS = (
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT", ("copies or substantial portions of the software", "noninfringement")),
    ("apache-2", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions", ("apache license version 2 0 january 2004",)),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("nor the names of its contributors may be used to endorse or promote products",)),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", ("redistributions of source code must retain", "redistributions in binary form must reproduce")),
    ("gpl-2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc.", ("gnu general public license version 2 june 1991",)),
    ("gpl-3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.", ("gnu general public license version 3 29 june 2007",)),
    ("lgpl-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc.", ("gnu lesser general public license version 2 1 february 1999",)),
    ("lgpl-3", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.", ("gnu lesser general public license version 3 29 june 2007",)),
    ("agpl-3", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc.", ("gnu affero general public license version 3 19 november 2007",)),
    ("mpl-2", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software", ("mozilla public license version 2 0", "owns covered software")),
    ("isc", "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS", ("the author disclaims all warranties with regard to this software",)),
    ("epl-2", "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (AGREEMENT)", ("eclipse public license v 2 0",)),
    ("bsl-1", "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("boost software license version 1 0 august 17th 2003",)),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", ("in no event will the authors be held liable", "alter it and redistribute it freely")),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 3.0 Unported License", ("creative commons attribution 3 0",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 3.0 Unported License", ("creative commons attribution noncommercial 3 0",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License", ("creative commons attribution sharealike 3 0",)),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
)
SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, spans array<struct<label:string,start:long,stop:long,score:double>>"
_WORDS = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Template(NamedTuple):
    """A passage that tells a licence: its words, and phrases (words with single spaces) that must stand in it."""

    label: str
    body: list[bytes]
    must: list[bytes]


def template(label: str, body: str, must: tuple[str, ...] | list[str]) -> Template:
    """A template of plain text; its phrases must stand in its body."""
    made = Template(label, words_of(body.encode()), [b" ".join(words_of(p.encode())) for p in must])
    joined = b" " + b" ".join(made.body) + b" "
    if not made.body or not all(p and b" " + p + b" " in joined for p in made.must):
        raise ValueError(f"the template of {label} is empty, or a mandatory phrase isn't in it")
    return made


def own_templates() -> list[Template]:
    """The templates of this module."""
    return [template(label, body, must) for kind in (TEMPLATES, VERSIONS) for label, (body, must) in kind.items()] + [template(*t) for t in TEXTS]


def templates_of(table: DataFrame, most: int = 5000) -> list[Template]:
    """Templates from a table (label string, body string, must array<string>; other columns are ignored). Rows without a label or a body raise, as do
    more than `most` rows: every task holds the index. Equal rows count once."""
    rows = table.select("label", "body", F.coalesce("must", F.array().cast("array<string>")).alias("must")).distinct().limit(most + 1).collect()
    if len(rows) > most or any(r.label is None or r.body is None for r in rows):
        raise ValueError(f"templates need a label and a body, and at most {most} rows")
    return [template(*r) for r in sorted(rows)]


class Index:
    """Postings of the templates' words with their positions, and IDF weights. A template is known by its place in the list."""

    def __init__(self, frequency: dict[bytes, int], total: int, rare: int = 6, slack: int = 3, votes: int = 2, least: float = 0.6, templates: list[Template] | None = None) -> None:
        self.rare, self.slack, self.votes, self.least = rare, slack, votes, least
        listed = own_templates() if templates is None else templates
        self.labels = [t.label for t in listed]
        self.templates = {k: (t.body, t.must) for k, t in enumerate(listed)}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for name, (body, _) in self.templates.items():
            for k, w in enumerate(body):
                self.postings[w].append((name, k))
        self.idf = {w: log((total + 1) / (frequency.get(w, 0) + 1)) + 1e-9 for w in self.postings}
        self.weight = {name: sum(self.idf[w] for w in body) for name, (body, _) in self.templates.items()}
        self.vocabulary = frozenset(self.postings)
        self.places: dict[int, dict[bytes, list[int]]] = {name: defaultdict(list) for name in self.templates}
        for name, (body, _) in self.templates.items():
            for k, w in enumerate(body):
                self.places[name][w].append(k)

    def candidates(self, words: list[bytes], joined: bytes) -> list[tuple[int, int]]:
        """(template, beginning) pairs for which enough different rare words agree on the place. joined: the words with spaces between and around them."""
        held = self.vocabulary.intersection(words)
        if len(held) < self.votes:
            return []
        chosen: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        stands = {p: b" " + p + b" " in joined for p in {p for _, must in self.templates.values() for p in must} if held.issuperset(p.split())}
        for name, (_, must) in self.templates.items():
            if all(stands.get(p, False) for p in must):
                own = self.places[name]
                # the phrases' own words too, so that each place of a phrase is tried
                rarest = sorted(held.intersection(own), key=lambda w: (-self.idf[w], w))[: self.rare]
                for w in {*rarest, *b" ".join(must).split()}:
                    chosen[w] += [(name, k) for k in own[w]]
        if not chosen:
            return []
        votes: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for p, w in enumerate(words):
            if w in chosen:
                for name, k in chosen[w]:
                    votes[name].append((p - k, w))
        out = []
        for name, found in votes.items():
            found.sort()
            at = 0
            while at < len(found):
                end = bisect.bisect_right(found, (found[at][0] + self.slack, b"\xff" * 8))
                if len({w for _, w in found[at:end]}) >= self.votes:
                    out.append((name, found[at][0]))
                    at = end
                else:
                    at += 1
        return out

    def verify(self, words: list[bytes], name: int, begin: int) -> tuple[int, int, float] | None:
        """(start, stop, score) if the mandatory phrases stand near; score: IDF share of the template's words found there in order."""
        body, must = self.templates[name]
        start, stop = max(0, begin - self.slack), min(len(words), begin + len(body) + 2 * self.slack)
        window = words[start:stop]
        joined = b" " + b" ".join(window) + b" "
        if not all(b" " + p + b" " in joined for p in must):
            return None
        at, score, first, last = 0, 0.0, None, start
        for w in body:
            try:
                at = window.index(w, at, at + 2 * self.slack + 2) + 1
            except ValueError:
                continue
            score += self.idf[w]
            first, last = (start + at - 1 if first is None else first), start + at
        return (first if first is not None else start, last, min(1.0, score / self.weight[name]))

    def scan(self, text: bytes) -> tuple:
        words = words_of(text)
        places, base = [], set()
        joined = b" " + b" ".join(words) + b" "
        spans: list[tuple[str, int, int, float]] = []
        for phrase, label in BASE.items():
            key, at, before, p = b" " + phrase.encode() + b" ", -1, 0, 0
            while (at := joined.find(key, at + 1)) >= 0:
                p += joined.count(b" ", before, at)  # words since the hit before, so a text is counted once
                before = at
                places.append(p)
                base.add(label)
                spans.append((label, p, p + key.count(b" ") - 1, 1.0))
        for name, begin in self.candidates(words, joined):
            if (found := self.verify(words, name, begin)) and found[2] >= self.least:
                spans.append((self.labels[name], *found))
        spans = sorted(set(spans), key=lambda s: (s[1], s[2], s[0], s[3]))
        return len(words), len(places), min(places, default=None), max(places, default=None), sorted(base), sorted({s[0] for s in spans}), max((s[3] for s in spans), default=0.0), spans


def frequencies(docs: DataFrame, templates: list[Template]) -> tuple[dict[bytes, int], int]:
    """In how many of all documents each of the templates' words stands, and the number of documents."""
    vocabulary = frozenset(w for t in templates for w in t.body)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in pieces(batches, 8 << 20):
            held[b""] += batch.num_rows
            for t in texts_of(batch):
                held.update(vocabulary.intersection(words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    rows = documents(docs).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    got = {r.word.encode(): r.n for r in rows}
    return got, got.pop(b"", 0)


def scan(docs: DataFrame, rare: int = 6, votes: int = 2, least: float = 0.6, templates: DataFrame | None = None) -> DataFrame:
    """One row for each document: counts and places of the base phrases, all labels, and spans (label, start, stop in words, score).
    templates: a table of further templates (see templates_of)."""
    known = own_templates() + (templates_of(templates) if templates is not None else [])
    frequency, total = frequencies(docs, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(frequency, total, rare=rare, votes=votes, least=least, templates=known)
        kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in pieces(batches, 8 << 20):
            rows = [index.scan(t) for t in texts_of(batch)]
            columns = [[r[k] for r in rows] for k in range(8)]
            columns[7] = [[dict(zip(("label", "start", "stop", "score"), s, strict=True)) for s in spans] for spans in columns[7]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], names)

    return documents(docs).mapInArrow(run, SCAN)
