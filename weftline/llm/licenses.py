"""Licence scanning with a generalised suffix automaton.

One automaton over the word sequences of all licence templates and base phrases is built once per
worker; its size follows the templates, not the corpus. Texts are streamed through it word by word,
which gives at each word the longest stretch ending there that occurs in some template (the matching
statistics). Stretches that cannot be extended and reach a minimum length are chained, per template,
into the spans that they cover in template order; the label of a template is added where its longest
chain covers enough of it. Base phrases are found by the same pass: a phrase ends at a word where the
automaton's state lies below the phrase's own state.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import text_batches

#: The base phrases with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Openings and core sentences of common licences and notices, by label.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
)

#: A stretch of at least so many words counts for a chain.
LEAST_WORDS = 4
#: A chain may skip so many words of the text between two stretches.
MOST_GAP = 12
#: A label is added if a chain covers this share of a template.
LEAST_COVER = 0.6

# Lower-cases A-Z and makes every separator a space; bytes above 127 stay.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


class SuffixAutomaton:
    """Of several sequences of integers. With ``notes``, each state knows its sequences and one end."""

    def __init__(self, sequences: Iterable[list[int]], notes: bool = True):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.where, self.end = [-1], [0], [0], [0]
        ends = []
        for k, seq in enumerate(sequences):
            last = 0
            for i, c in enumerate(seq):
                last = self._extend(last, c)
                if notes:
                    ends.append((last, k, i))
        # A longer state's sequences are those of its suffixes too; the first end is kept.
        self.at: list[dict[int, int]] = [{} for _ in self.link]
        for state, k, i in ends:
            self.at[state].setdefault(k, i)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            above = self.at[self.link[state]]
            for k, i in self.at[state].items():
                above.setdefault(k, i)

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state for the longest suffix that ends in p and c, taken out of q."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # an earlier sequence has this prefix's continuation
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def walk(self, items: Iterable[int]) -> Iterator[tuple[int, int]]:
        """After each item, the state and the length of the longest suffix that occurs."""
        state = length = 0
        following, link, lengths = self.next, self.link, self.length
        for c in items:
            while c not in following[state] and state:
                state = link[state]
                length = lengths[state]
            if c in following[state]:
                state, length = following[state][c], length + 1
            yield state, length


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        split_phrases = [words(p) for p in phrases]
        split_templates = [words(t) for _, t in templates]
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for s in split_phrases + split_templates for w in s))}
        coded = [[self.vocabulary[w] for w in s] for s in split_phrases + split_templates]
        self.automaton = a = SuffixAutomaton(coded)
        self.base_labels = list(phrases.values())
        self.template_labels = [label for label, _ in templates]
        self.sizes = [len(s) for s in split_templates]
        self.n_phrases = len(split_phrases)
        own = {}
        for k, seq in enumerate(coded[: self.n_phrases]):
            for state, _ in a.walk(seq):
                pass
            own[state] = (k, len(seq))
        # The phrases that end where a state is reached: its own and those of its suffixes.
        self.ending: list[tuple[tuple[int, int], ...]] = []
        for state in range(len(a.link)):
            found, s = [], state
            while s > 0:
                if s in own:
                    found.append(own[s])
                s = a.link[s]
            self.ending.append(tuple(found))

    def scan(self, text: str | None) -> tuple:
        w = words(text)
        ids = np.fromiter(map(self.vocabulary.get, w, repeat(-1)), np.int32, len(w))
        places: list[tuple[int, int]] = []
        stretches: list[tuple[int, int, int, int]] = []
        known = np.flatnonzero(ids >= 0)
        if len(known) > 1:
            cuts = np.flatnonzero(np.diff(known) > 1) + 1
            starts, ends = known[np.r_[0, cuts]], known[np.r_[cuts - 1, len(known) - 1]] + 1
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                self._stream(ids, s, e, places, stretches)
        cover, labels, spans = self._chained(stretches)
        base = {self.base_labels[k] for _, k in places}
        score = max([cover, *(0.5 for _ in places[:1])])
        first, last = (min(p for p, _ in places), max(p for p, _ in places)) if places else (None, None)
        return len(w), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), round(min(1.0, score), 6), spans

    def _stream(self, ids: np.ndarray, s: int, e: int, places: list, stretches: list) -> None:
        ending, before = self.ending, (0, 0)
        for i, (state, length) in enumerate(self.automaton.walk(ids[s:e].tolist()), s):
            for k, n in ending[state]:
                if n <= length:
                    places.append((i - n + 1, k))
            if length <= before[1] and before[1] >= LEAST_WORDS:
                self._note(before, i, stretches)
            before = state, length
        if before[1] >= LEAST_WORDS:
            self._note(before, e, stretches)

    def _note(self, match: tuple[int, int], end: int, stretches: list) -> None:
        state, length = match
        for k, at in self.automaton.at[state].items():
            if k >= self.n_phrases:
                stretches.append((k - self.n_phrases, end - length, at + 1 - length, length))

    def _chained(self, stretches: list) -> tuple[float, set[str], list[tuple[int, str, int, int, int]]]:
        """The largest share of a template that a chain covers, the labels that reach LEAST_COVER, and all
        chains that no longer one goes on from: template, label, words of the text from and to, words covered."""
        most: dict[int, float] = {}
        spans = []
        by: dict[int, list] = {}
        for k, start, at, n in stretches:
            by.setdefault(k, []).append((start, at, n))
        for k, found in by.items():
            open_: list[tuple[int, int, int, int]] = []  # text end, template end, words covered, text start
            chains: dict[tuple[int, int, int, int], None] = {}
            for start, at, n in sorted(found):
                open_ = [x for x in open_ if x[0] + MOST_GAP >= start]
                best = max((x for x in open_ if x[0] <= start and x[1] <= at), key=lambda x: x[2], default=None)
                chains.pop(best, None)
                covered = (best[2] if best else 0) + n
                open_.append((start + n, at + n, covered, best[3] if best else start))
                chains[open_[-1]] = None
                most[k] = max(most.get(k, 0.0), covered / self.sizes[k])
            spans += [(k, self.template_labels[k], first, end, covered) for end, _, covered, first in chains]
        labels = {self.template_labels[k] for k, x in most.items() if x >= LEAST_COVER}
        return max(most.values(), default=0.0), labels, sorted(spans, key=lambda x: (x[2], x[3], x[0], x[4]))


@lru_cache(maxsize=1)
def default_scanner() -> Scanner:
    return Scanner()


SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<template:int,label:string,start:int,end:int,covered:int>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` are the chains of every template, by place: its number and label, the words of the text from
    ``start`` up to but without ``end``, and how many of them it covers.

    ``score`` is the largest share of a template that a chain covers, and at least one half where a
    base phrase stands. Null and empty texts have no words, empty labels and score 0. Rows are
    independent, so ties and repeated rows need no rule. An empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = phrases is not None or templates is not None
        scanner = Scanner(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates) if own else default_scanner()
        names = [c.split()[0] for c in SCHEMA.split(", ")][1:]
        for batch in batches:
            out = pd.DataFrame([scanner.scan(t) for t in batch["text"]], columns=names)
            out[["first_word", "last_word"]] = out[["first_word", "last_word"]].astype("Int64")
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object) if batch["doc_id"].isna().any() else batch["doc_id"].to_numpy())
            yield out

    return text_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, SCHEMA)
