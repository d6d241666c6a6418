"""Operator 4: licence scan by template-markup matching.

A template is a licence text with two kinds of markup::

    <<beginOptional>> wording that may be missing <<endOptional>>
    <<var;match="A..B">>   between A and B words of any kind

Optional regions may be nested and may hold replaceable ones. A template is compiled into an automaton over
words: each state waits for one word, or for any word inside a replaceable region. A text is accepted from
the word where the mandatory wording, and nothing in between but what the markup allows, has been read. All
templates share one table from first words to automata, so a scan only stops at words that can begin one.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomry.llm.texts import fold_words, text_bytes

#: Wording of each label: phrases that must stand word for word.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: Notices and opening wording of common licences.
TEMPLATES = {
    "agpl-notice": '<<beginOptional>>licensed under the<<endOptional>> GNU Affero General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> version <<var;match="1..2">>',
    "apache-notice": 'Licensed under the Apache License, Version <<var;match="1..2">> <<beginOptional>>(the "License")<<endOptional>>',
    "bsd-grant": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met',
    "cc-by-nc-notice": '<<beginOptional>>This work is<<endOptional>> Licensed under <<beginOptional>>a<<endOptional>> CC BY-NC <<var;match="1..2">>',
    "cc-by-notice": '<<beginOptional>>This work is<<endOptional>> licensed under a Creative Commons Attribution <<var;match="1..2">> <<beginOptional>>International<<endOptional>> License',
    "copyright-notice": 'Copyright <<beginOptional>>(c)<<endOptional>> <<var;match="1..8">> All rights reserved',
    "gpl-notice": '<<beginOptional>>This work is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>GNU<<endOptional>> General Public License, version <<var;match="1..2">> <<beginOptional>>or later<<endOptional>>',
    "isc-grant": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted',
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files',
    "mit-notice": '<<beginOptional>>Released<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> MIT License',
    "mpl-notice": 'This Source Code Form is subject to the terms of the Mozilla Public License, v. <<var;match="1..2">>',
}

TAG = re.compile(r'<<(beginOptional|endOptional|var;match="(\d+)\.\.(\d+)")>>')


@dataclass
class Automaton:
    """States 0..accept. ``words``: word -> next states; ``free``: states any word leads to; ``skips``: states reached without a word."""

    label: str
    words: list[dict[bytes, list[int]]] = field(default_factory=lambda: [{}])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    skips: list[list[int]] = field(default_factory=lambda: [[]])

    def state(self) -> int:
        self.words.append({})
        self.free.append([])
        self.skips.append([])
        return len(self.words) - 1

    def seal(self) -> Automaton:
        """Fold the skips into the states, so that a step needs one look-up per state."""
        self.accept = len(self.words) - 1
        closure = []
        for i in range(len(self.words)):
            reach, rest = {i}, [i]
            while rest:
                for j in self.skips[rest.pop()]:
                    if j not in reach:
                        reach.add(j)
                        rest.append(j)
            closure.append(frozenset(reach))
        self.closure = closure
        self.first = frozenset(w for i in closure[0] for w in self.words[i])
        if any(self.free[i] for i in closure[0]) or self.accept in closure[0]:
            raise ValueError(f"template {self.label} must begin with wording")
        return self

    def longest(self, words: list[bytes], start: int) -> int:
        """End of the longest text accepted from ``start`` on, or ``start`` if there is none."""
        live, at, end = self.closure[0], start, start
        while live and at < len(words):
            found: set[int] = set()
            word = words[at]
            for i in live:
                for j in self.words[i].get(word, ()):
                    found |= self.closure[j]
                for j in self.free[i]:
                    found |= self.closure[j]
            at += 1
            live = found
            if self.accept in live:
                end = at
        return end


def compile_template(label: str, markup: str) -> Automaton:
    """Automaton of one template; wording is compared as folded words."""
    auto, now, open_at = Automaton(label), 0, []

    def read(text: str) -> None:
        nonlocal now
        for word in fold_words(text.encode()):
            to = auto.state()
            auto.words[now].setdefault(word, []).append(to)
            now = to

    at = 0
    for tag in TAG.finditer(markup):
        read(markup[at : tag.start()])
        at = tag.end()
        if tag[1] == "beginOptional":
            to = auto.state()
            auto.skips[now].append(to)
            open_at.append(now := to)
        elif tag[1] == "endOptional":
            if not open_at:
                raise ValueError(f"template {label}: endOptional without a beginning")
            to = auto.state()
            auto.skips[now].append(to)
            auto.skips[open_at.pop()].append(to)
            now = to
        else:
            least, most = int(tag[2]), int(tag[3])
            ways = []
            for i in range(most):
                if i >= least:
                    ways.append(now)
                to = auto.state()
                auto.free[now].append(to)
                now = to
            to = auto.state()
            for i in [*ways, now]:
                auto.skips[i].append(to)
            now = to
    if open_at:
        raise ValueError(f"template {label}: an optional region is not closed")
    read(markup[at:])
    end = auto.state()
    auto.skips[now].append(end)
    return auto.seal()


class Scanner:
    def __init__(self, phrases: Mapping[str, str], templates: Mapping[str, str]):
        self.base = set(phrases)
        self.by_first: dict[bytes, list[Automaton]] = defaultdict(list)
        for label, markup in [*phrases.items(), *templates.items()]:
            auto = compile_template(label, markup)
            for word in auto.first:
                self.by_first[word].append(auto)

    def scan(self, words: list[bytes]) -> list[tuple[int, int, str]]:
        """(first word, end, label) of every accepted place."""
        by_first, found = self.by_first, []
        for at in [i for i, w in enumerate(words) if w in by_first]:
            for auto in by_first[words[at]]:
                end = auto.longest(words, at)
                if end > at:
                    found.append((at, end, auto.label))
        return found


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<start:int,end:int,label:string>>"


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """Licence wording of every row's whole text.

    Returns the key and: n_words; n_base, places of a phrase, overlapping ones too; first_word and last_word,
    where the first and the last of them begin (words from 0, null if there is none); base_labels and labels,
    distinct and sorted, of the phrases and of everything accepted; score, the share of words inside accepted
    places; places (start, end, label). Null and empty texts have no words and score 0. Equal rows give equal
    results; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in names}
            for data in text_bytes(batch.column("text")):
                words = fold_words(data)
                places = scanner.scan(words)
                base = [p for p in places if p[2] in scanner.base]
                covered, at = 0, 0
                for start, end, _ in sorted(places):
                    covered += max(0, end - max(start, at))
                    at = max(at, end)
                row = (
                    len(words),
                    len(base),
                    min((p[0] for p in base), default=None),
                    max((p[0] for p in base), default=None),
                    ",".join(sorted({p[2] for p in base})),
                    ",".join(sorted({p[2] for p in places})),
                    covered / len(words) if words else 0.0,
                    [{"start": s, "end": e, "label": x} for s, e, x in places],
                )
                for c, v in zip(names, row):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([batch.column("key"), *[pa.array(out[c], k) for c, k in zip(names, kinds)]], names=["key", *names])

    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"]
    place = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())])
    kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.list_(place)]
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, {SCHEMA}").withColumnRenamed("key", key)
