"""Licence scans with a generalised suffix automaton over licence templates.

The words of all templates and base phrases are built into one automaton over word numbers. A file is streamed through it
for its matching statistics, the longest match that ends at each word; maximal matches of at least LEAST words are chained
per template where they follow each other in file and template, and the words a chain covers make up the template's span.
A template is found where its covered share reaches COVER. Base phrases are read off the same matching statistics.

Only stretches in which every pair of neighbouring words is a pair of some template can hold a match of two words or more,
so the stretches are found for a whole text at once and only they are streamed.

Defined cases. A null or empty text has no words, no places, empty labels and score 0. Rows with equal or null ids stay
separate rows. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices by which licences are named in files, and openings of their texts.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "released under the MIT License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl-2.0", "GNU General Public License version 2"),
    ("gpl-3.0", "GNU General Public License version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the BSD License"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl-2.0", "Mozilla Public License Version 2.0"),
    ("epl-2.0", "Eclipse Public License Version 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "CC0 1.0 Universal"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "licensed under CC BY-ND 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("proprietary", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited"),
)
#: Words of a match that is chained, at least (a shorter template: all of it); words between two links of a chain, at most.
LEAST, GAP = 3, 12
#: Share of a template that its chain must cover: of one with up to SHORT words all.
COVER, SHORT = 0.7, 9
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    """Runs of digits, letters a-z and characters beyond ASCII, after lower-casing A-Z."""
    return WORD.findall(text.lower())


class Automaton:
    """Generalised suffix automaton of word numbers; number 0 stands for any other word."""

    def __init__(self, texts: list[list[bytes]]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.texts = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in t] for t in texts]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, text in enumerate(self.texts):
            last = 0
            for at, word in enumerate(text):
                last = self.extend(last, word)
                self.ends[last].add((k, at + 1))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]] |= self.ends[state]
        size = len(self.vocabulary) + 1
        self.pairs = np.zeros((size, size), bool)
        for text in self.texts:
            self.pairs[text[:-1], text[1:]] = True

    def new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(dict(following))
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def split(self, state: int, word: int, target: int) -> int:
        """A state for the shorter strings of `target`: those that end at `state` and `word`."""
        copy = self.new(self.length[state] + 1, self.link[target], self.next[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def extend(self, last: int, word: int) -> int:
        target = self.next[last].get(word)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self.split(last, word, target)
        own = self.new(self.length[last] + 1, 0, {})
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = own
            state = self.link[state]
        if state >= 0:
            target = self.next[state][word]
            self.link[own] = target if self.length[target] == self.length[state] + 1 else self.split(state, word, target)
        return own

    def walk(self, state: int, size: int, word: int) -> tuple[int, int]:
        """The longest suffix of what is matched so far plus `word` that is in a text."""
        while state and word not in self.next[state]:
            state = self.link[state]
            size = self.length[state]
        target = self.next[state].get(word)
        return (0, 0) if target is None else (target, size + 1)

    def stretches(self, numbers: np.ndarray) -> list[tuple[int, int]]:
        """Where all neighbouring pairs are pairs of a text: (first, end)."""
        hit = np.concatenate(([False], self.pairs[numbers[:-1], numbers[1:]], [False])) if len(numbers) > 1 else np.zeros(1, bool)
        edge = np.flatnonzero(hit[1:] != hit[:-1])
        return [(int(a), int(b) + 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES) -> None:
        self.labels = [label for _, label in phrases] + [label for label, _ in templates]
        texts = [words_of(p.encode()) for p, _ in phrases] + [words_of(t.encode()) for _, t in templates]
        self.sizes, self.phrases = [len(t) for t in texts], len(phrases)
        self.automaton = a = Automaton(texts)
        of_state: dict[int, list[int]] = {}
        for k in range(self.phrases):
            state = 0
            for word in a.texts[k]:
                state = a.next[state][word]
            of_state.setdefault(state, []).append(k)
        #: For each state the phrases that end its strings.
        self.ending: list[list[int]] = [[] for _ in a.next]
        for state in sorted(range(1, len(a.next)), key=lambda s: a.length[s]):
            self.ending[state] = of_state.get(state, []) + self.ending[a.link[state]]

    def scan(self, text: bytes) -> dict:
        a, words = self.automaton, words_of(text)
        numbers = np.fromiter(map(a.vocabulary.get, words, repeat(0)), np.int64, len(words))
        places: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int]] = []  # end in the file, words, state
        for first, end in a.stretches(numbers):
            state = size = 0
            for at, word in enumerate(numbers[first:end].tolist(), first + 1):
                state, grown = a.walk(state, size, word)
                if grown <= size and size >= 2:
                    matches.append((at - 1, size, before))
                size, before = grown, state
                for k in self.ending[state]:
                    if size >= self.sizes[k]:
                        places.append((k, at - self.sizes[k]))
            if size >= 2:
                matches.append((end, size, state))
        spans = self.chains(matches)
        best: dict[int, float] = {}
        for span in spans:
            best[span["template"]] = max(best.get(span["template"], 0.0), span["covered"] / self.sizes[span["template"]])
        base = sorted({self.labels[k] for k, _ in places})
        found = {self.labels[k] for k, share in best.items() if share >= (1.0 if self.sizes[k] <= SHORT else COVER)}
        starts = [s for _, s in places]
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(base),
            "labels": ",".join(sorted(found | set(base))),
            "score": min(1.0, max([float(bool(base)), *best.values()])),
            "spans": [{"label": self.labels[s["template"]], "first": s["first"], "end": s["end"], "covered": s["covered"]} for s in spans],
        }

    def chains(self, matches: list[tuple[int, int, int]]) -> list[dict]:
        """Spans of templates: matches that follow each other in file and template, with little between them."""
        open_: dict[int, dict] = {}
        spans: list[dict] = []
        for end, size, state in matches:
            for k, at in self.automaton.ends[state]:
                if k < self.phrases or size < min(LEAST, self.sizes[k]):
                    continue
                start, left = end - size, at - size
                chain = open_.get(k)
                if chain and chain["at"] <= left and start >= chain["end"] and start - chain["end"] <= GAP:
                    chain.update(end=end, at=at, covered=chain["covered"] + size)
                elif not chain or not (chain["end"] == end and chain["covered"] >= size):
                    open_[k] = {"template": k, "first": start, "end": end, "at": at, "covered": size}
                    spans.append(open_[k])
        return spans


@cache
def scanner() -> Scanner:
    return Scanner()


SPANS = "array<struct<label:string,first:long,end:long,covered:long>>"
FIELDS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
SCHEMA = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}"
KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("covered", pa.int64())])))


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = scanner()
    for batch in batches:
        found = [own.scan(t.as_py() or b"") for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([f[c] for f in found], kind) for c, kind in zip(FIELDS, KINDS, strict=True)]], ["doc_id", *FIELDS])


def scan(docs: DataFrame) -> DataFrame:
    """A row for each document, with the spans of the templates found in it."""
    texts = common.only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(scan_batches, SCHEMA)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents")).drop("spans")
