"""Licence scans with a positional rare-token index.

The index holds, for every word of the licence templates, its postings (template, place) and its
IDF over the templates. Every template has its own rare words: its places of highest IDF, so many
that a position of template and file cannot reach COVERAGE without VOTES of them. All rare words of a
file vote for relative positions; a position with enough votes is checked word by word over the
whole template, and the template's mandatory key phrases must stand where it was found.
The index is small and fixed by the parameter ``templates``; files stream through it.

Edge cases: a null, empty or word-less text has no words, no places and no labels, score 0.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectext import find_words, lookup, ranges, text_blocks

#: Phrases whose every place counts, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: label: (template text, key phrases that must stand in the found place)
TEMPLATES = {
    "agpl": ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("affero general public license",)),
    "apache": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache license",)),
    "apache-2.0": ("licensed under the apache license version 2 0", ("apache license version 2 0",)),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "conditions are met")),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    "cc-by-nc": ("licensed under cc by nc 4 0", ("cc by nc",)),
    "gpl": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("general public license",)),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", ("general public license version 3",)),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee",)),
    "lgpl": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted", "without restriction")),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    "unlicense": ("this is free and unencumbered software released into the public domain", ("public domain",)),
}
#: A template is found at this share of its IDF mass; the least votes for a position, where a template has enough words.
COVERAGE, VOTES = 0.8, 2


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return find_words(raw, np.array([0, len(raw)])).hash


class RareTokenIndex:
    def __init__(self, templates: dict[str, tuple[str, tuple[str, ...]]] | None = None, phrases=PHRASES):
        templates = TEMPLATES if templates is None else templates
        self.labels = sorted(templates)
        words = [_hashes(templates[k][0]) for k in self.labels]
        keys = [[_hashes(p) for p in templates[k][1]] for k in self.labels]
        self.phrases = [(_hashes(p), label) for p, label in phrases]
        self.vocab = np.unique(np.concatenate([*words, *(p for ps in keys for p in ps), *(p for p, _ in self.phrases)]))
        self.templates = [lookup(self.vocab, w) for w in words]
        self.keys = [[lookup(self.vocab, p) for p in ps] for ps in keys]
        self.phrase_ids = [(lookup(self.vocab, p), label) for p, label in self.phrases]
        df = Counter(int(t) for w in self.templates for t in set(w.tolist()))
        self.idf = np.array([math.log((1 + len(self.labels)) / df.get(i, 1)) for i in range(len(self.vocab))])
        self.rare = np.zeros(len(self.vocab), bool)
        self.need = np.ones(len(self.labels), np.int64)
        postings: list[tuple[int, int, int]] = []
        for t, w in enumerate(self.templates):
            chosen, self.need[t] = self._rare_places(w)
            self.rare[w[chosen]] = True
            postings += [(int(w[place]), t, int(place)) for place in chosen]
        self.postings = np.array(sorted(postings), np.int64).reshape(-1, 3)
        self.first = np.searchsorted(self.postings[:, 0], np.arange(len(self.vocab) + 1))
        self.least = int(self.need.min()) if len(self.need) else 1

    def _rare_places(self, w: np.ndarray) -> tuple[np.ndarray, int]:
        """The fewest places of highest IDF of which every position that reaches COVERAGE has VOTES
        right, and the votes; with fewer votes where all places cannot promise as many."""
        mass = self.idf[w]
        order = np.lexsort((np.arange(len(w)), -mass))
        sums = np.cumsum(mass[order])
        for votes in range(VOTES, 1, -1):
            # the mass that may be wrong, and the largest that fewer votes can hold
            missing = (1 - COVERAGE) * mass.sum() + mass[order][: votes - 1].sum()
            enough = np.flatnonzero(sums > missing + 1e-9)
            if len(enough):
                return order[: enough[0] + 1], votes
        return order, 1

    def found(self, ids: np.ndarray) -> dict[str, float]:
        """Label: best share of IDF mass, for the templates verified in a file's word ids."""
        out: dict[str, float] = {}
        at = np.flatnonzero(ids >= 0)
        at = at[self.rare[ids[at]]]
        lo, hi = self.first[ids[at]], self.first[ids[at] + 1]
        rows = self.postings[ranges(lo, hi)]
        begins = np.repeat(at, hi - lo) - rows[:, 2]
        pairs, votes = np.unique(begins * len(self.labels) + rows[:, 1], return_counts=True)
        enough = votes >= self.need[pairs % len(self.labels)]
        for pair in pairs[enough].tolist():
            begin, t = divmod(pair, len(self.labels))
            template = self.templates[t]
            span = np.arange(begin, begin + len(template))
            inside = (span >= 0) & (span < len(ids))
            same = np.zeros(len(template), bool)
            same[inside] = ids[span[inside]] == template[inside]
            mass = self.idf[template]
            share = float(mass[same].sum() / mass.sum())
            if share >= COVERAGE and all(len(places(ids[max(0, begin) : begin + len(template)], k)) for k in self.keys[t]):
                out[self.labels[t]] = max(out.get(self.labels[t], 0.0), share)
        return out


def places(ids: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the words of a phrase stand one after another."""
    if not len(phrase) or len(ids) < len(phrase):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(ids[: len(ids) - len(phrase) + 1] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[ids[at + k] == phrase[k]]
    return at


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=None, phrases=PHRASES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found array<struct<label, share>>).

    score: the largest verified share of a template, at least 0.5 with a base phrase, else 0."""
    index = docs.sparkSession.sparkContext.broadcast(RareTokenIndex(templates, phrases))
    id_type = docs.schema[doc_id].dataType.simpleString()
    shares = pa.list_(pa.struct([("label", pa.string()), ("share", pa.float64())]))

    def run(batches):
        x = index.value
        for batch in batches:
            for lo, hi, buf, offsets in text_blocks(batch.column(1)):
                words = find_words(buf, offsets)
                ids = lookup(x.vocab, words.hash)
                rare = np.concatenate([[0], np.cumsum((ids >= 0) & x.rare[ids])])
                maybe = rare[words.first[1:]] - rare[words.first[:-1]] >= x.least
                bases: dict[int, list[tuple[int, str]]] = {}
                for phrase, label in x.phrase_ids:
                    for p in places(ids, phrase).tolist():
                        d = int(np.searchsorted(words.first, p, "right")) - 1
                        if p + len(phrase) <= words.first[d + 1]:
                            bases.setdefault(d, []).append((p - int(words.first[d]), label))
                rows = []
                for d in range(hi - lo):
                    base = bases.get(d, ())
                    found = x.found(ids[words.first[d] : words.first[d + 1]]) if maybe[d] else {}
                    own = sorted({label for _, label in base})
                    at = [p for p, _ in base]
                    score = max([0.0, *found.values(), *([0.5] if own else [])])
                    rows.append((len(base), min(at, default=None), max(at, default=None), ",".join(own), ",".join(sorted({*own, *found})), min(1.0, score), [{"label": k, "share": v} for k, v in sorted(found.items())]))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), shares)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(words.counts(), pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found"],
                )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {id_type}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, found array<struct<label:string,share:double>>"
    )


