"""Licence scan with a generalised suffix automaton of licence tokens.

The automaton holds every substring of every template. A text streams through it once and gives
matching statistics: at each word the longest suffix that is part of some template. Two things
are read off: whole phrases that end at a word (along the suffix links), and maximal matches of
MIN_MATCH words or more, which are chained per template into covered spans.

Defined cases: null and empty texts have no words and score 0; overlapping places of a phrase all
count; equal rows give equal results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, as_bytes

# Phrases of the contract, and short passages of public licences.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
TEMPLATES = {
    "cc-by-nc": "licensed under cc by nc 4 0",
    "gpl-3": "licensed under the gnu general public license version 3",
    "apache-2": "licensed under the apache license version 2 0",
    "mit": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software "
                "and associated documentation files the software to deal in the software without restriction",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted "
                "provided that the following conditions are met",
    "apache-text": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "agpl": "licensed under the gnu affero general public license",
    "lgpl": "licensed under the gnu lesser general public license",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
}
#: A match counts from so many words; words between chained matches; share of a template to name it.
MIN_MATCH, MAX_GAP, COVER = 2, 8, 0.8


class SuffixAutomaton:
    """Generalised suffix automaton over word ids; `words` maps words (bytes) to ids from 1."""

    def __init__(self, templates: list[str]):
        self.words: dict[bytes, int] = {}
        self.texts = [[self.words.setdefault(w.encode(), len(self.words) + 1) for w in t.split()]
                      for t in templates]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for k, text in enumerate(self.texts):
            last = 0
            for i, symbol in enumerate(text):
                last = self._extend(last, symbol)
                self.ends[last].append((k, i + 1))
        self._spread()
        pairs = np.zeros((len(self.words) + 1,) * 2, bool)
        for text in self.texts:
            pairs[text[:-1], text[1:]] = True
        self.pairs = pairs

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.next) - 1

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:  # the prefix is already there, from an earlier template
            to = self.next[last][symbol]
            return to if self.length[to] == self.length[last] + 1 else self._split(last, symbol, to)
        new, at = self._state(self.length[last] + 1, {}, 0), last
        while at >= 0 and symbol not in self.next[at]:
            self.next[at][symbol] = new
            at = self.link[at]
        if at >= 0:
            to = self.next[at][symbol]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, symbol, to)
        return new

    def _split(self, at: int, symbol: int, to: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.next[to]), self.link[to])
        while at >= 0 and self.next[at].get(symbol) == to:
            self.next[at][symbol] = copy
            at = self.link[at]
        self.link[to] = copy
        return copy

    def _spread(self) -> None:
        """Give every state all ends (template, end) of its strings, and the whole templates that
        are suffixes of them."""
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] += self.ends[state]
        self.whole: list[list[int]] = [[] for _ in self.next]
        for state in sorted(range(1, len(self.next)), key=lambda s: self.length[s]):
            up = self.link[state]
            own = {k for k, end in self.ends[state]
                   if end == len(self.texts[k]) and self.length[up] < end <= self.length[state]}
            self.whole[state] = [*(self.whole[up] if up > 0 else []), *own]

    def statistics(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """State and match length after each word id."""
        state = size = 0
        for symbol in ids:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if symbol in self.next[state]:
                state, size = self.next[state][symbol], size + 1
            yield state, size


def _chains(matches: list[tuple[int, int, int, int]], size: int) -> tuple[float, tuple[int, int] | None]:
    """Best share of a template covered by matches (from, to, template from, template to) that
    follow each other in text and template; and the span of words."""
    best: list[tuple[int, int]] = []  # covered words, first word
    top, span = 0, None
    for j, (a, b, c, d) in enumerate(matches):
        got, first = b - a, a
        for i in range(max(0, j - 32), j):  # matches sorted by end
            a2, b2, c2, d2 = matches[i]
            if b2 <= b and d2 <= d and a - b2 <= MAX_GAP and c2 <= c and a2 <= a:
                new = min(b - max(a, b2), d - max(c, d2))
                if new > 0 and best[i][0] + new > got:
                    got, first = best[i][0] + new, best[i][1]
        best.append((got, first))
        if got > top:
            top, span = got, (first, b)
    return min(1.0, top / size), span


def scan_words(words: list[bytes], sam: SuffixAutomaton, n_phrases: int) -> tuple[list[tuple[int, int]], dict[int, tuple[float, tuple[int, int]]]]:
    """Places (phrase, first word) of whole phrases, and per template its cover and span."""
    get = sam.words.get
    ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
    places: list[tuple[int, int]] = []
    covers: dict[int, tuple[float, tuple[int, int]]] = {}
    singles = [k for k in range(n_phrases) if len(sam.texts[k]) == 1]
    linked = np.zeros(len(ids) + 1, bool)
    if len(ids) > 1:
        linked[1:-1] = sam.pairs[ids[:-1], ids[1:]]  # word i follows word i-1 in some template
    live = linked[:-1] | linked[1:]
    if singles:
        live |= ids > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([False], live, [False])).astype(np.int8)))
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    for lo, hi in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
        seen = list(sam.statistics(ids[lo:hi].tolist()))
        for i, (state, size) in enumerate(seen):
            for k in sam.whole[state]:
                if k < n_phrases and len(sam.texts[k]) <= size:
                    places.append((k, lo + i + 1 - len(sam.texts[k])))
            if size >= MIN_MATCH and (i + 1 == len(seen) or seen[i + 1][1] <= size):
                for k, end in sam.ends[state]:
                    if k >= n_phrases:
                        found.setdefault(k, []).append((lo + i + 1 - size, lo + i + 1, end - size, end))
    for k, matches in found.items():
        share, span = _chains(matches, len(sam.texts[k]))
        if span:
            covers[k] = (share, span)
    return places, covers


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """Per document: n_words, n_base and first_word, last_word (places of phrases), base_labels,
    labels (also of templates covered to COVER or more), score (best cover; 1 with a phrase) and
    spans (label, from word, to word, share)."""
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    names = [*phrases.values(), *templates]
    texts = [*phrases, *templates.values()]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sam = SuffixAutomaton(texts)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word",
                                                    "base_labels", "labels", "score", "spans")}
            for raw in batch.column("raw").to_pylist():
                words = raw.translate(WORD_BYTES).split()
                places, covers = scan_words(words, sam, len(phrases))
                base = {names[k] for k, _ in places}
                more = {names[k] for k, (share, _) in covers.items() if share >= COVER}
                starts = [at for _, at in places]
                out["n_words"].append(len(words))
                out["n_base"].append(len(places))
                out["first_word"].append(min(starts, default=None))
                out["last_word"].append(max(starts, default=None))
                out["base_labels"].append(",".join(sorted(base)))
                out["labels"].append(",".join(sorted(base | more)))
                out["score"].append(1.0 if places else max((s for s, _ in covers.values()), default=0.0))
                out["spans"].append([{"label": names[k], "from": a, "to": b, "share": share}
                                     for k, (share, (a, b)) in sorted(covers.items()) if share >= COVER])
            yield pa.record_batch({"doc_id": batch.column("doc_id"), **{
                k: pa.array(v, _ARROW[k]) for k, v in out.items()}})

    frame = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), as_bytes(text_col).alias("raw"))
    return frame.mapInArrow(look, SCHEMA)


SCHEMA = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
          "base_labels string, labels string, score double, "
          "spans array<struct<label: string, `from`: bigint, `to`: bigint, share: double>>")
_ARROW = {
    "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
    "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(),
    "spans": pa.list_(pa.struct([("label", pa.string()), ("from", pa.int64()), ("to", pa.int64()),
                                 ("share", pa.float64())])),
}
