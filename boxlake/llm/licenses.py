"""License scans with a generalised suffix automaton of licence words.

The automaton holds every run of words of all templates. A text streams through it word by word, and the state tells the longest
run ending there that some template contains (matching statistics). Runs that cannot grow are anchors; anchors of one
template that keep its order are chained into a span, and a span that covers enough of the template names the licence.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlake.llm.common import arrow_batches, text_or_empty, written

# Phrases that name a licence wherever they stand, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Excerpts of public licence texts, in words, and their labels.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
]

# Letters and digits in lower case and all bytes of other characters stand; the rest of ASCII parts words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def license_words(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton over word ids: of each state its transitions, suffix link, longest length, and one end in each template."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest, self.ends = [-1], [0], [{}]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, symbol in enumerate(sequence):
                last = self._extend(last, symbol)
                self.ends[last].setdefault(number, place)
        for state in sorted(range(1, len(self.next)), key=self.longest.__getitem__, reverse=True):
            for number, place in self.ends[state].items():
                self.ends[self.link[state]].setdefault(number, place)

    def _new(self, longest: int, next_: dict[int, int], link: int) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.longest.append(longest)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, parent: int, symbol: int, child: int) -> int:
        """A state for the child's runs that are one longer than the parent's longest."""
        if self.longest[child] == self.longest[parent] + 1:
            return child
        copy = self._new(self.longest[parent] + 1, dict(self.next[child]), self.link[child])
        self.link[child] = copy
        while parent >= 0 and self.next[parent].get(symbol) == child:
            self.next[parent][symbol] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            return self._split(last, symbol, self.next[last][symbol])
        new = self._new(self.longest[last] + 1, {}, 0)
        at = last
        while at >= 0 and symbol not in self.next[at]:
            self.next[at][symbol] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, symbol, self.next[at][symbol])
        return new

    def run(self, symbols: list[int]) -> Iterator[tuple[int, int]]:
        """(state, matched length) after each symbol."""
        state, size = 0, 0
        for symbol in symbols:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                size = self.longest[state]
            to = self.next[state].get(symbol)
            if to is None:
                state, size = 0, 0
            else:
                state, size = to, size + 1
            yield state, size


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


class Scanner:
    def __init__(self, least_run: int = 4, gap: int = 12, cover: float = 0.6):
        self.least_run, self.gap, self.cover = least_run, gap, cover
        texts = [(label, phrase) for phrase, label in PHRASES.items()] + TEMPLATES
        words = [license_words(text) for _, text in texts]
        self.labels = [label for label, _ in texts]
        self.sizes = list(map(len, words))
        self.ids = _Ids({w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))})
        self.automaton = Automaton([[self.ids[w] for w in ws] for ws in words])
        # of each state the phrases that its runs end in
        self.phrases: list[list[tuple[int, str]]] = [[] for _ in self.automaton.next]
        own: dict[int, tuple[int, str]] = {}
        for i, label in enumerate(self.labels[: len(PHRASES)]):
            *_, (state, size) = self.automaton.run([self.ids[w] for w in words[i]])
            own[state] = (size, label)
        for state in range(1, len(self.phrases)):
            at = state
            while at > 0:
                if at in own:
                    self.phrases[state].append(own[at])
                at = self.automaton.link[at]

    def scan(self, text: str) -> tuple[int, list[tuple[str, int, int]], list[tuple[str, int, int, float]]]:
        """Number of words; (label, start, end) of every phrase place; (label, start, end, coverage) of every chained template span."""
        words = license_words(text)
        ids = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        known = np.flatnonzero(ids >= 0)
        places, anchors = [], []
        if len(known) > 1:
            for run in np.split(known, np.flatnonzero(np.diff(known) > 1) + 1):
                if len(run) > 1:
                    self._scan_run(int(run[0]), ids[run[0] : run[-1] + 1].tolist(), places, anchors)
        return len(words), places, self._chain(anchors)

    def _scan_run(self, start: int, ids: list[int], places: list, anchors: list) -> None:
        before, held = 0, 0
        for i, (state, size) in enumerate(self.automaton.run(ids), start):
            if size <= before and before >= self.least_run:
                anchors.append((held, i, before))
            for length, label in self.phrases[state]:
                if length <= size:
                    places.append((label, i - length + 1, i + 1))
            before, held = size, state
        if before >= self.least_run:
            anchors.append((held, start + len(ids), before))

    def _chain(self, anchors: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Anchors (state, end in text, length) into spans: an anchor joins the open span of a template if it follows in both within the gap."""
        open_: dict[int, list[int]] = {}
        spans = []

        def close(number: int) -> None:
            first, end, _, covered = open_.pop(number)
            share = min(1.0, covered / self.sizes[number])
            if share >= self.cover:
                spans.append((self.labels[number], first, end, share))

        for state, end, length in anchors:
            for number, place in self.automaton.ends[state].items():
                if number < len(PHRASES):
                    continue
                begin, template_begin = end - length, place + 1 - length
                at = open_.get(number)
                if at and (begin - at[1] > self.gap or template_begin < at[2] - length):
                    close(number)
                    at = None
                if at:
                    overlap = max(0, at[1] - begin, at[2] - template_begin)
                    at[1], at[2], at[3] = end, max(at[2], place + 1), at[3] + max(0, length - overlap)
                else:
                    open_[number] = [begin, end, place + 1, length]
        for number in list(open_):
            close(number)
        return sorted(spans, key=lambda s: (s[1], s[2], s[0]))


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A table of doc_id, counts and labels, and spans (label, start, end, coverage) in words, of every whole text.

    Null text counts as empty: no words, no places, null first_word and last_word, empty labels, score 0. The score is 1 where a
    phrase stands, else the best coverage of a chained span. Repeated rows and null ids each keep a row; other columns are left out.
    """

    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner().scan
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                n, places, spans = scan(text)
                starts = [p[1] for p in places]
                base = {p[0] for p in places}
                labels = base | {s[0] for s in spans}
                score = 1.0 if base else max((s[3] for s in spans), default=0.0)
                out.append((n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, [dict(zip(("label", "start", "end", "coverage"), s)) for s in spans]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(x), kind) for x, kind in zip(zip(*out), kinds))], names=["doc_id", *names])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    with arrow_batches(docs.sparkSession):
        return written(source.mapInArrow(run, f"doc_id long, {FIELDS}, spans array<struct<label:string,start:long,end:long,coverage:double>>"))
