"""License scans by a positional index of rare words.

Each template is a short text of a known licence with the phrases that any copy of it must have.  The
corpus gives every licence word its inverse document frequency.  The index posts

* every phrase under its word of highest IDF, with that word's offset, and
* every template at its words of highest IDF, its anchors.  A template of n words of which m must stand
  at their places has n - m + 2 anchors; so many words can't all but one be missing from a copy, so two
  of them vote for its start.  No copy is lost, whatever else the text holds.

The words of a text are looked up once, for all its licence words.  Postings of the highest-IDF words give
the phrases, whose other words are intersected at their relative positions; templates with all their
phrases in the text get places near the first of them; anchors vote for starts, and voted starts are
compared with the whole template and verified to have each mandatory phrase within NEAR words of it.
Templates none of whose phrases is in a text cost nothing there, so time doesn't follow their number.

Base phrases are posted among the others.

Defined cases.  A null text is empty; a text without words has counts of 0, null places, empty labels
and a score of 0.  A copy cut off by the start or end of a text counts by the words that are there (its
start is then below 0).  Repeated rows get equal results.  Only the id and the text are read.  Templates
without words or mandatory phrases are an error, and so are more than TEMPLATE_WORDS words of templates.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwarden.llm import bytetext

#: Words around a placed template in which its mandatory phrases may stand.
NEAR = 4
#: Anchors that must agree on a start.
VOTES = 2
#: Words of all templates together: what the broadcast index is bounded by.
TEMPLATE_WORDS = 1 << 21
#: Comparisons of words that one numpy pass makes.
PASS = 1 << 21

# Base phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Sentences of public licences; the phrases in the third place are mandatory.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work cc0", ("waived all copyright",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("public-domain", "this work is dedicated to the public domain", ("dedicated to the public domain",)),
    ("reserved", "copyright all rights reserved", ("all rights reserved",)),
)


def _words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n numbers from each lo on, in a row."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class _Lists:
    """Lists of numbers, one after the other."""

    def __init__(self, lists: Sequence[Sequence[int]]):
        self.size = np.array([len(x) for x in lists], dtype=np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.array([v for x in lists for v in x], dtype=np.int64)

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in `keys`, value) of each value in the lists of the keys."""
        n = self.size[keys]
        return np.repeat(np.arange(len(keys)), n), self.flat[_ranges(self.first[keys], n)]


def _passes(sizes: np.ndarray) -> Iterator[slice]:
    """Slices with about PASS in sum of sizes, a member at least."""
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PASS, side="right")))
        yield slice(lo, hi)
        lo = hi


class _Index:
    """The words of templates and phrases with their ids; after `post`, the postings by highest IDF."""

    def __init__(self, templates: Sequence[tuple[str, str, Sequence[str]]], phrases: Mapping[str, str]):
        split = [(label, _words(t), [_words(p) for p in need]) for label, t, need in templates]
        base = [(label, _words(p)) for p, label in phrases.items()]
        if not all(t and need and all(need) for _, t, need in split) or not all(p for _, p in base):
            raise ValueError("a template needs words and mandatory phrases, a phrase needs words")
        if sum(len(t) for _, t, _ in split) > TEMPLATE_WORDS:
            raise ValueError(f"templates have more than {TEMPLATE_WORDS} words")
        self.words = sorted({w for _, t, need in split for x in (t, *need) for w in x} | {w for _, p in base for w in p})
        ids = {w: i for i, w in enumerate(self.words)}
        hashes = np.array([bytetext.word_hash(w) for w in self.words], dtype=np.uint64)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.low = np.zeros(1 << 16, dtype=bool)
        self.low[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        numbers: dict[tuple[int, ...], int] = {}
        number = lambda p: numbers.setdefault(tuple(ids[w] for w in p), len(numbers))
        self.base = {}
        for label, p in base:
            self.base.setdefault(number(p), set()).add(label)
        self.labels = [label for label, _, _ in split]
        self.template = _Lists([[ids[w] for w in t] for _, t, _ in split])
        self.need = _Lists([list(dict.fromkeys(number(p) for p in need)) for _, _, need in split])
        self.phrase = _Lists(list(numbers))
        needed, led = [[] for _ in numbers], [[] for _ in numbers]
        for t in range(len(split)):
            own = self.need.flat[self.need.first[t] : self.need.first[t] + self.need.size[t]].tolist()
            led[own[0]].append(t)
            for p in own:
                needed[p].append(t)
        self.needed, self.led = _Lists(needed), _Lists(led)

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        """The index's word ids of a sequence of words; -1 for the rest."""
        out = np.full(len(hashes), -1, dtype=np.int32)
        if not len(self.sorted):
            return out
        some = np.flatnonzero(self.low[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.sorted, hashes[some]), len(self.sorted) - 1)
        same = self.sorted[at] == hashes[some]
        out[some[same]] = self.order[at[same]]
        return out

    def post(self, idf: np.ndarray, coverage: float) -> _Index:
        """Post phrases under their word of highest IDF and choose each template's anchors."""
        under: list[list[int]] = [[] for _ in self.words]
        self.rare = np.zeros(len(self.phrase.size), dtype=np.int64)
        for p, (lo, n) in enumerate(zip(self.phrase.first.tolist(), self.phrase.size.tolist(), strict=True)):
            own = self.phrase.flat[lo : lo + n]
            self.rare[p] = int(np.argmax(idf[own]))
            under[own[self.rare[p]]].append(p)
        self.postings = _Lists(under)
        self.least, self.votes, anchors = [], [], []
        for lo, n in zip(self.template.first.tolist(), self.template.size.tolist(), strict=True):
            least = next((m for m in range(1, n + 1) if m / n >= coverage), n + 1)
            votes = min(VOTES, least)
            self.least.append(least)
            self.votes.append(votes)
            anchors.append(np.argsort(-idf[self.template.flat[lo : lo + n]], kind="stable")[: n - least + votes].tolist())
        self.least, self.votes = np.array(self.least, dtype=np.int64), np.array(self.votes, dtype=np.int64)
        self.anchors = _Lists(anchors)
        self.compared = 0
        return self

    def occurrences(self, coded: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, phrase, start), in order of phrase and start, of each place in texts that begin at `first`."""
        hits = np.flatnonzero(coded >= 0)
        hits = hits[self.postings.size[coded[hits]] > 0]
        found = [np.zeros((3, 0), dtype=np.int64)]
        for part in _passes(self.postings.size[coded[hits]]):
            at, phrase = self.postings.of(coded[hits[part]])
            start = hits[part][at] - self.rare[phrase]
            text = np.searchsorted(first, hits[part][at], side="right") - 1
            some = np.flatnonzero((start >= first[text]) & (start + self.phrase.size[phrase] <= first[text + 1]))
            k = 0
            while True:
                left = self.phrase.size[phrase[some]] > k
                if not left.any():
                    break
                ok = ~left
                at = some[left]
                ok[left] = coded[start[at] + k] == self.phrase.flat[self.phrase.first[phrase[at]] + k]
                some = some[ok]
                k += 1
            found.append(np.stack([text[some], phrase[some], start[some]]))
        text, phrase, start = np.concatenate(found, axis=1)
        order = np.lexsort((start, phrase))
        return text[order], phrase[order], start[order]

    def _agree(self, coded, lists: _Lists, values: np.ndarray | None, template, start, low, high) -> np.ndarray:
        """How many of each template's listed places hold their word when it begins at `start`."""
        at, place = lists.of(template)
        if values is None:  # all places
            place = _ranges(np.zeros(len(template), dtype=np.int64), lists.size[template])
        word = self.template.flat[self.template.first[template][at] + place]
        where = start[at] + place
        inside = (where >= low[at]) & (where < high[at])
        same = np.zeros(len(at), dtype=bool)
        same[inside] = coded[where[inside]] == word[inside]
        self.compared += len(at)
        return np.bincount(at, weights=same, minlength=len(template)).astype(np.int64)

    def places(self, coded: np.ndarray, first: np.ndarray, text: np.ndarray, phrase: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(text, template, start, share of its words) of each placed template, given the occurrences of phrases."""
        if not len(text) or not len(self.labels):
            return
        # templates with all their phrases in the text
        kinds = np.unique(text * len(self.phrase.size) + phrase)
        at, template = self.needed.of(kinds % len(self.phrase.size))
        whole, n = np.unique((kinds // len(self.phrase.size))[at] * len(self.labels) + template, return_counts=True)
        whole = whole[n == self.need.size[whole % len(self.labels)]]
        if not len(whole):
            return
        span = len(coded) + 1
        order = phrase * span + start
        at, template = self.led.of(phrase)
        key = text[at] * len(self.labels) + template
        live = whole[np.minimum(np.searchsorted(whole, key), len(whole) - 1)] == key
        at, template = at[live], template[live]
        # a placed template has its first phrase within NEAR words of it, so these are all starts it can have
        n = self.template.size[template] + 2 * NEAR - self.phrase.size[phrase[at]] + 1
        at, template, n = at[n > 0], template[n > 0], n[n > 0]
        for part in _passes(n * self.template.size[template]):
            t = np.repeat(template[part], n[part])
            begin = _ranges(start[at[part]] - (n[part] - 1 - NEAR), n[part])
            # a start is below its text's first word by less than a template's length
            doc = np.repeat(text[at[part]], n[part])
            once = np.unique(np.stack([doc, t, begin]), axis=1) if len(t) else np.zeros((3, 0), dtype=np.int64)
            doc, t, begin = once
            low, high = first[doc], first[doc + 1]
            some = np.flatnonzero(self._agree(coded, self.anchors, self.anchors.flat, t, begin, low, high) >= self.votes[t])
            doc, t, begin, low, high = (x[some] for x in (doc, t, begin, low, high))
            same = self._agree(coded, self.template, None, t, begin, low, high)
            some = np.flatnonzero(same >= self.least[t])
            doc, t, begin, low, high, same = (x[some] for x in (doc, t, begin, low, high, same))
            at_, p = self.need.of(t)
            lo = np.maximum(low[at_], begin[at_] - NEAR)
            hi = np.minimum(high[at_], begin[at_] + self.template.size[t][at_] + NEAR) - self.phrase.size[p]
            there = (hi >= lo) & (np.searchsorted(order, p * span + np.maximum(hi, 0), side="right") > np.searchsorted(order, p * span + lo, side="left"))
            verified = np.flatnonzero(np.bincount(at_, weights=there, minlength=len(t)) == self.need.size[t])
            yield from zip(doc[verified].tolist(), t[verified].tolist(), (begin - low)[verified].tolist(), (same / self.template.size[t])[verified].tolist(), strict=True)


def word_idf(docs: DataFrame, index: _Index) -> np.ndarray:
    """ln((1 + N) / (1 + df)) of the index's words over all rows of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(len(index.words), dtype=np.int64)
        for batch in batches:
            n += batch.num_rows
            for first, last, raw, offsets in bytetext.chunks(batch.column("text")):
                w = bytetext.words(raw, offsets, bytetext.NOT_ALPHANUMERIC)
                coded = index.encode(w.hashes)
                at = np.flatnonzero(coded >= 0)
                text = np.searchsorted(w.first, at, side="right") - 1
                df += np.bincount(np.unique(text * len(index.words) + coded[at]) % len(index.words), minlength=len(index.words))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(df)), pa.int32()), pa.array(np.concatenate([[n], df]))], names=["word", "n"])

    rows = docs.mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # one row a template word
    counts = {r["word"]: r["n"] for r in rows}
    return np.array([math.log((1 + counts.get(-1, 0)) / (1 + counts.get(i, 0))) for i in range(len(index.words))])


def template_table(table: DataFrame) -> list[tuple[str, str, list[str]]]:
    """Templates from a table of (label string, text string, phrases array<string>), for `scan`; rows with a null are left out.

    The rows come to the driver, since tasks carry the index: no more than TEMPLATE_WORDS words, or it is an error.
    """
    rows = table.select("label", "text", "phrases").dropna()
    words = rows.agg(F.coalesce(F.sum(F.size(F.split("text", " "))), F.lit(0)).alias("n")).first()["n"]
    if words > TEMPLATE_WORDS:
        raise ValueError(f"templates have more than {TEMPLATE_WORDS} words")
    return sorted((r["label"], r["text"], list(r["phrases"])) for r in rows.collect())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=BASE_PHRASES, coverage: float = 0.6) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches) for every row.

    templates: (label, text, mandatory phrases), here or from `template_table`.  coverage: the share of a
    template's words that must stand at their places, above 0.  matches: array of (label, start word,
    coverage).  score: the highest coverage, 1 for a base phrase.
    """
    if not 0 < coverage <= 1:
        raise ValueError("coverage is a share above 0")
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    index = _Index(templates, phrases)
    index.post(word_idf(named.select("text"), index), coverage)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        base_phrase = np.isin(np.arange(len(index.phrase.size)), list(index.base))
        for batch in batches:
            n = batch.num_rows
            n_words, n_base = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            low, high = [None] * n, [None] * n
            base = [set() for _ in range(n)]
            more: list[dict[tuple[str, int], float]] = [{} for _ in range(n)]
            for first, last, raw, offsets in bytetext.chunks(batch.column("text")):
                w = bytetext.words(raw, offsets, bytetext.NOT_ALPHANUMERIC)
                n_words[first:last] = np.diff(w.first)
                coded = index.encode(w.hashes)
                text, phrase, start = index.occurrences(coded, w.first)
                of_base = np.flatnonzero(base_phrase[phrase])
                for t, p, s in zip(text[of_base].tolist(), phrase[of_base].tolist(), (start - w.first[text])[of_base].tolist(), strict=True):
                    i = first + t
                    n_base[i] += len(index.base[p])
                    base[i] |= index.base[p]
                    low[i] = s if low[i] is None else min(low[i], s)
                    high[i] = s if high[i] is None else max(high[i], s)
                for t, template, s, share in index.places(coded, w.first, text, phrase, start):
                    key = (index.labels[template], s)
                    more[first + t][key] = max(share, more[first + t].get(key, 0.0))
            labels = [",".join(sorted(b | {m[0] for m in found})) for b, found in zip(base, more, strict=True)]
            score = [1.0 if b else max(found.values(), default=0.0) for b, found in zip(base, more, strict=True)]
            matches = pa.array([[{"label": a, "start_word": p, "coverage": s} for (a, p), s in sorted(found.items())] for found in more], pa.list_(pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("coverage", pa.float64())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words), pa.array(n_base), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array([",".join(sorted(b)) for b in base]), pa.array(labels), pa.array(score, pa.float64()), matches],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"],
            )

    found = named.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,start_word:long,coverage:double>>")
    return found.withColumnRenamed("doc_id", id_col)
