"""Licence scans: matching statistics of texts against a generalised suffix automaton of licence tokens.

Every template is added to one automaton over word numbers. A text streams through it once: at each word the automaton
keeps the longest suffix of the words so far that stands in some template. Matches that can't be extended and are long
enough are chained, per template and in order, into spans; a template's score is the share of its words that one span
covers. The base phrases are templates of their own, so a phrase ends at a word exactly if its state is the current
state or one of its suffix links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Notices by which licences name themselves or grant their rights.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl-2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("gpl-3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc0", "has waived all copyright and related or neighboring rights to"),
]

#: Words of the shortest match that is chained, of the largest gap within a span, and the share that makes a label.
MIN_MATCH, MAX_GAP, MIN_COVER = 4, 8, 0.8

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lowered: runs of digits, letters a-z and everything beyond ASCII."""
    return _WORD.findall((text or "").encode().lower())


class Automaton:
    """Suffix automaton of several word sequences, each added from the root."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [-1]

    def _state(self, length: int, follow: dict[int, int], link: int, end: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        self.end.append(end)
        return len(self.link) - 1

    def _split(self, parent: int, state: int, word: int) -> int:
        """A copy of a state for its matches no longer than the parent's and one word."""
        copy = self._state(self.length[parent] + 1, dict(self.next[state]), self.link[state], self.end[state])
        self.link[state] = copy
        while parent >= 0 and self.next[parent].get(word) == state:
            self.next[parent][word] = copy
            parent = self.link[parent]
        return copy

    def add(self, words: list[int], base: int) -> list[int]:
        """Add a sequence; ``base`` is the place of its first word among the words of all templates."""
        last, states = 0, []
        for i, word in enumerate(words):
            known = self.next[last].get(word)
            if known is not None:
                last = known if self.length[known] == self.length[last] + 1 else self._split(last, known, word)
            else:
                made = self._state(self.length[last] + 1, {}, 0, base + i)
                at = last
                while at >= 0 and word not in self.next[at]:
                    self.next[at][word] = made
                    at = self.link[at]
                if at >= 0:
                    known = self.next[at][word]
                    self.link[made] = known if self.length[known] == self.length[at] + 1 else self._split(at, known, word)
                last = made
            states.append(last)
        return states


class Scanner:
    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> None:
        self.automaton, self.vocabulary, self.templates = Automaton(), {}, []
        base = 0
        self.owner: list[int] = []
        marks: dict[int, int] = {}
        self.phrases = list(phrases.items())
        sequences = [(label, text, None) for label, text in templates] + [(label, text, k) for k, (text, label) in enumerate(self.phrases)]
        every = []
        for number, (label, text, phrase) in enumerate(sequences):
            words = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            end = self.automaton.add(words, base)[-1]
            every.append((words, base, end, phrase))
            self.templates.append((label, base, len(words), phrase))
            self.owner += [number] * len(words)
            base += len(words)
        for words, _, _, phrase in every:  # a phrase's state may have been split since
            if phrase is not None:
                state = 0
                for w in words:
                    state = self.automaton.next[state][w]
                marks[state] = phrase
        #: For each state, the phrases that its longest match ends with, with their lengths.
        self.ends: list[list[tuple[int, int]]] = []
        lengths = [len(words_of(text)) for text, _ in self.phrases]
        for state in range(len(self.automaton.link)):
            found, at = [], state
            while at > 0:
                if at in marks:
                    found.append((marks[at], lengths[marks[at]]))
                at = self.automaton.link[at]
            self.ends.append(found)
        #: All places in templates where the matches of a state end: its own first place and those of the states linked to it.
        places: list[set[int]] = [{e} if e >= 0 else set() for e in self.automaton.end]
        for words, start, _, _ in every:
            state = 0
            for i, w in enumerate(words):
                state = self.automaton.next[state][w]
                places[state].add(start + i)
        for state in sorted(range(1, len(places)), key=lambda s: -self.automaton.length[s]):
            if self.automaton.link[state] > 0:
                places[self.automaton.link[state]] |= places[state]
        self.places = [sorted(p) for p in places]

    def statistics(self, numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place, state, length of the longest match that ends there) for each word of the vocabulary that has one of two words or more before it."""
        follow, link, length = self.automaton.next, self.automaton.link, self.automaton.length
        known = np.flatnonzero(numbers >= 0)
        if not len(known):
            return
        cuts = np.flatnonzero(np.diff(known) > 1) + 1
        for run in np.split(known, cuts):
            state = matched = 0
            if len(run) < 2:
                continue
            for at, word in zip(range(run[0], run[-1] + 1), numbers[run[0] : run[-1] + 1].tolist()):
                while state and word not in follow[state]:
                    state = link[state]
                    matched = length[state]
                if word in follow[state]:
                    state = follow[state][word]
                    matched += 1
                yield at, state, matched

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        find = self.vocabulary.get
        numbers = np.fromiter((find(w, -1) for w in words), np.int32, len(words))
        starts: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int]] = []  # end in the text, length, state; each can't be extended
        last = (-2, 0, 0)
        for at, state, matched in self.statistics(numbers):
            for phrase, size in self.ends[state]:
                if size <= matched:
                    starts.append((at - size + 1, phrase))
            if last[1] >= MIN_MATCH and not (at == last[0] + 1 and matched == last[1] + 1):
                matches.append((last[0], last[1], last[2]))
            last = (at, matched, state)
        if last[1] >= MIN_MATCH:
            matches.append((last[0], last[1], last[2]))
        spans = self.chain(matches)
        base = sorted({self.phrases[p][1] for _, p in starts})
        scored: dict[str, float] = {}
        for label, _, _, cover in spans:
            scored[label] = max(cover, scored.get(label, 0.0))
        more = {label for label, cover in scored.items() if cover >= MIN_COVER}
        return {
            "n_words": len(words),
            "n_base": len(starts),
            "first_word": min((s for s, _ in starts), default=None),
            "last_word": max((s for s, _ in starts), default=None),
            "base_labels": ",".join(base),
            "labels": ",".join(sorted(more.union(base))),
            "score": 1.0 if starts else max(scored.values(), default=0.0),
            "spans": [{"label": label, "first": first, "last": end, "cover": cover} for label, first, end, cover in spans],
        }

    def chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Chain matches that follow each other both in the text and in a template; the best span of each template and place."""
        open_spans: dict[int, list[int]] = {}  # template: first and last word in the text, last word in the template, words covered
        closed: list[tuple[int, list[int]]] = []
        for end, length, state in matches:
            for place in self.places[state]:
                template = self.owner[place]
                label, base, size, phrase = self.templates[template]
                if phrase is not None or place - base + 1 < length:
                    continue
                first, inner = end - length + 1, place - base - length + 1
                span = open_spans.get(template)
                if span and span[1] < end and span[2] < place - base and first - span[1] - 1 <= MAX_GAP and inner - span[2] - 1 <= MAX_GAP:
                    fresh = min(length, end - span[1], place - base - span[2])
                    open_spans[template] = [span[0], end, place - base, span[3] + fresh]
                else:
                    if span:
                        closed.append((template, span))
                    open_spans[template] = [first, end, place - base, length]
        closed += open_spans.items()
        best: dict[tuple[str, int], tuple[int, float]] = {}
        for template, (first, last, _, covered) in closed:
            label, _, size, _ = self.templates[template]
            cover = min(1.0, covered / size)
            if cover > best.get((label, first), (0, 0.0))[1]:
                best[(label, first)] = (last, cover)
        return sorted((label, first, last, cover) for (label, first), (last, cover) in best.items() if cover >= MIN_COVER / 2)


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


_FOUND = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())])))])
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: long, last: long, cover: double>>"


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: words, places of base phrases, labels, score and covered template spans.

    Null and empty texts have no words, no labels ('') and score 0. doc_id may be null or repeated; other columns are
    ignored. The scan is a map over rows: no shuffle, whole texts, one pass.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner()
        for batch in batches:
            found = pa.array([own.scan(t.as_py()) for t in batch.column(1)], _FOUND)
            yield pa.RecordBatch.from_arrays([batch.column(0), *found.flatten()], ["doc_id", *(f.name for f in _FOUND)])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(each, SCHEMA)
