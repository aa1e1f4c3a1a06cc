"""Licence scan: templates with optional and replaceable regions, compiled to token automata.

A template is wording with marks. ``<<beginOptional>> ... <<endOptional>>`` may be there or not (marks nest);
``<<var;a,b>>`` stands for any words, from a to b of them. All other words are mandatory, and a text is
accepted where the automaton runs from its first word to its last over consecutive words of the text.
Words are compared as they are after lower-casing A-Z; marks, punctuation and white space do not count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import LOWER, Words, byte_set, runs, utf8

WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_BYTES = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))

# Phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Our own templates of public licence notices; the label of each follows from its name.
TEMPLATES = {
    "mit": [
        "Released under the <<beginOptional>>terms of the<<endOptional>> MIT License",
        "<<beginOptional>>This <<var;1,3>> is <<endOptional>>licensed under the <<beginOptional>>terms of the"
        "<<endOptional>> MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;1,12>> to deal in"
        " <<var;1,4>> without restriction, including without limitation the rights to use, copy, modify, merge,"
        " publish, distribute, sublicense, and/or sell copies of <<var;1,3>>",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 <<beginOptional>>(the \"License\"); you may not use"
        " <<var;1,4>> except in compliance with the License<<endOptional>>",
    ],
    "gpl-notice": [
        "<<beginOptional>>This <<var;1,3>> is <<endOptional>>licensed under the GNU <<beginOptional>>Lesser"
        "<<endOptional>> General Public License<<beginOptional>>, version <<var;1,2>><<endOptional>>",
        "under the terms of the GNU <<beginOptional>>Lesser<<endOptional>> General Public License as published by"
        " the Free Software Foundation",
    ],
    "cc-notice": [
        "<<beginOptional>>This <<var;1,3>> is <<endOptional>>licensed under <<beginOptional>>a<<endOptional>>"
        "<<beginOptional>>the<<endOptional>> CC BY<<beginOptional>>-NC<<endOptional>><<beginOptional>>-SA"
        "<<endOptional>><<beginOptional>>-ND<<endOptional>><<beginOptional>> <<var;1,2>><<endOptional>>",
        "licensed under a Creative Commons <<var;1,6>> License",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
        " that the following conditions are met",
    ],
    "isc": [
        "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any"
        " purpose with or without fee is hereby granted",
    ],
    "mpl-2.0": ["subject to the terms of the Mozilla Public License, v. 2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "spdx-tag": ["SPDX-License-Identifier: <<var;1,3>>"],
    "reserved-notice": [
        "Copyright <<beginOptional>>(c)<<endOptional>> <<beginOptional>><<var;1,8>><<endOptional>> All rights"
        " reserved",
    ],
}

_ANY = None


class Automaton:
    """States are places between words; ``after[state]`` maps a word (None: any word) to following states."""

    def __init__(self, template: str):
        self.after: list[dict] = [{}]
        self.skip: list[set[int]] = [set()]
        self.mandatory: list[bytes] = []
        pieces = re.split(r"(<<[^>]*>>)", template)
        open_: list[int] = []
        at = 0
        for piece in pieces:
            if piece == "<<beginOptional>>":
                open_.append(at)
            elif piece == "<<endOptional>>":
                self.skip[open_.pop()].add(at)
            elif piece.startswith("<<var;"):
                low, high = map(int, piece[6:-2].split(","))
                for k in range(high):
                    if k >= low:
                        self.skip[at].add(at + high - k)
                    at = self._step(at, _ANY)
            else:
                for word in re.findall(WORD, piece.encode().lower()):
                    if not open_:
                        self.mandatory.append(word)
                    at = self._step(at, word)
        self.last = at
        self.reach = [self._closed({s}) for s in range(at + 1)]
        self.first = {w for s in self.reach[0] for w in self.after[s]}

    def _step(self, at: int, word) -> int:
        self.after.append({})
        self.skip.append(set())
        self.after[at][word] = len(self.after) - 1
        return len(self.after) - 1

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def accepts(self, words: list[bytes], start: int) -> int:
        """The end of the longest accepted run of words from ``start``; ``start`` itself if there is none."""
        states, best = self.reach[0], start
        for i in range(start, len(words)):
            following: set[int] = set()
            for s in states:
                for word in (words[i], _ANY):
                    t = self.after[s].get(word)
                    if t is not None:
                        following |= self.reach[t]
            if not following:
                break
            states = following
            if self.last in states:
                best = i + 1
        return best


class Scanner:
    def __init__(self, templates: dict[str, list[str]], base: dict[str, str]):
        self._base = [(tuple(p.encode().split()), label) for p, label in base.items()]
        self._automata = [(Automaton(t), label) for label, several in templates.items() for t in several]
        # A text without any of these words holds no phrase and no template.
        needed = [max(words, key=len) for words, _ in self._base]
        needed += [max(a.mandatory, key=len) for a, _ in self._automata]
        self._needed = [w for w in set(needed) if not any(o != w and o in w for o in needed)]
        self._heads: dict[bytes, list] = {}
        for automaton, label in self._automata:
            for word in automaton.first:
                self._heads.setdefault(word, []).append((automaton, label))
        for words, label in self._base:
            self._heads.setdefault(words[0], [])

    def scan(self, text: bytes):
        """Places of base phrases as (start, label), accepted runs as (start, end, label), for lower-cased text."""
        if not any(w in text for w in self._needed):
            return [], []
        words = re.findall(WORD, text)
        places, accepted = [], []
        for i in [i for i, w in enumerate(words) if w in self._heads]:
            for phrase, label in self._base:
                if words[i] == phrase[0] and tuple(words[i : i + len(phrase)]) == phrase:
                    places.append((i, i + len(phrase), label))
            for automaton, label in self._heads[words[i]]:
                end = automaton.accepts(words, i)
                if end > i:
                    accepted.append((i, end, label))
        return places, accepted


def license_scan(docs: DataFrame, templates: dict | None = None, base: dict | None = None) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches``, a row per document.

    ``n_base`` counts the places of base phrases, ``first_word`` and ``last_word`` are the smallest and
    largest word number one starts at (null without any). ``labels`` joins base labels and those of accepted
    templates. ``score`` is the share of words that lie in a place or an accepted run. ``matches`` lists the
    accepted runs as (label, first word, word after the last). A null text counts as empty: no words, empty
    labels, score 0. Rows that repeat are scanned again, a null doc_id stays null, texts are read whole
    however long, and other columns are not read.
    """
    templates, base = templates or TEMPLATES, base or BASE
    kind = pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())])
    fields = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
              "labels string, score double, matches array<struct<label:string,first:bigint,end:bigint>>")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, base)
        for batch in batches:
            for part in runs(batch, "text"):
                data, at = utf8(part.column("text"))
                data = LOWER[data]
                counts = Words(data, at, WORD_BYTES).count
                whole, rows = data.tobytes(), []
                for i, n in enumerate(counts.tolist()):
                    places, accepted = scanner.scan(whole[at[i] : at[i + 1]])
                    starts = [p[0] for p in places]
                    own = {p[2] for p in places}
                    covered = set()
                    for first, end, _ in places + accepted:
                        covered.update(range(first, end))
                    rows.append((
                        n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)),
                        ",".join(sorted(own | {a[2] for a in accepted})), len(covered) / n if n else 0.0,
                        [{"label": label, "first": a, "end": b} for a, b, label in accepted]))
                columns = list(zip(*rows))
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(kind)]
                yield pa.record_batch(
                    [part.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types)]],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, fields)
