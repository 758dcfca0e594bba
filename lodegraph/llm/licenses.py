"""License scans: phrases in place, and an exact set-similarity join with license templates.

Templates are sets of distinct words. A block of a text meets a template if it holds at
least ``THRESHOLD`` of the template's words. For a template of n words the blocks are all
windows of 2n words, one from every word of the text.

The join is exact and follows prefix filtering: template words are ordered from rare to
frequent by the number of documents that hold them (counted over the whole corpus). A
block that holds a of n words must hold one of the n - a + 1 rarest; only template words
less than 2n from such a word are looked at. The distinct words of all windows over them
are counted in one pass: a word counts for the windows that begin after its last occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import textkernel as K
from lodegraph.llm.runtime import ship, table

THRESHOLD = Fraction(4, 5)
#: The phrases of the base scan and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Opening or grant sentences of public licenses, and their labels.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", "mit"),
    ("released under the terms of the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]


class Templates:
    """Templates with their words in global order, and what the scan needs to find candidates."""

    def __init__(self, templates: list[tuple[str, str]], spread: dict[int, int], threshold: Fraction = THRESHOLD):
        self.labels, self.sets, self.need = [], [], []
        vocab = sorted({h for text, _ in templates for h in K.word_hash(text)})
        self.order = sorted(vocab, key=lambda h: (spread.get(h, 0), h))
        rank = {h: i for i, h in enumerate(self.order)}
        self.vocab = np.array(vocab, dtype=K.U64)
        self.rank = np.array([rank[h] for h in vocab])
        #: By template and rank: the word's number in the template (-1 if it is none), and whether a match can begin with it.
        self.number = np.full((len(templates), len(vocab)), -1)
        self.prefix = np.zeros((len(templates), len(vocab)), dtype=bool)
        for t, (text, label) in enumerate(templates):
            words = sorted({rank[h] for h in K.word_hash(text)})
            need = -(-threshold.numerator * len(words) // threshold.denominator)
            self.labels.append(label)
            self.sets.append(np.array(words))
            self.need.append(need)
            self.number[t, words] = np.arange(len(words))
            self.prefix[t, words[: len(words) - need + 1]] = True
        self.gap = 2 * max(map(len, self.sets), default=0)

    def matches(self, places: np.ndarray, ranks: np.ndarray, rows: np.ndarray) -> dict[int, dict[int, float]]:
        """By row, template to best containment in a block of its text, where it meets the threshold.

        ``places`` of template words, ascending over all rows, their ranks and their rows.
        """
        out: dict[int, dict[int, float]] = {}
        places = places + rows * self.gap  # no window reaches into the next row
        for t, (words, need) in enumerate(zip(self.sets, self.need, strict=True)):
            rare = places[self.prefix[t][ranks]]
            if not len(rare):
                continue
            size = 2 * len(words)
            own = np.flatnonzero(self.number[t][ranks] >= 0)
            i = np.searchsorted(rare, places[own])
            own = own[(np.abs(rare[np.minimum(i, len(rare) - 1)] - places[own]) < size) | (np.abs(places[own] - rare[np.maximum(i - 1, 0)]) < size)]
            at, word, m = places[own], self.number[t][ranks[own]], len(own)
            order = np.argsort(word, kind="stable")
            again = np.flatnonzero(word[order][1:] == word[order][:-1])
            last = np.full(m, -1)
            last[order[again + 1]] = order[again]
            # Occurrence k counts for the windows that begin at occurrences begin[k] to k.
            begin = np.maximum(last + 1, np.searchsorted(at, at - size, "right"))
            held = np.cumsum(np.bincount(begin, minlength=m) - np.bincount(np.arange(1, m + 1), minlength=m)[:m])
            hit = np.flatnonzero(held >= need)
            row, first = np.unique(rows[own[hit]], return_index=True)
            if len(row):
                for r, best in zip(row.tolist(), np.maximum.reduceat(held[hit], first).tolist(), strict=True):
                    out.setdefault(r, {})[t] = best / len(words)
        return out


def _spread(vocab: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        total = np.zeros(len(vocab), dtype=np.int64)
        for b in batches:
            for _, _, buf, offs in K.chunks(*K.text_buffers(b["text"])):
                w = K.Words(buf, offs, K.ALNUM_WORDS)
                where, code = _template_words(w, vocab)
                pairs = np.unique(w.rows()[where] * len(vocab) + code)
                total += np.bincount(pairs % len(vocab), minlength=len(vocab))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocab)), pa.int64()), pa.array(total)], names=["code", "n"])

    return run


_FILTER = 18


def _filter(vocab: np.ndarray) -> np.ndarray:
    table_ = np.zeros(1 << _FILTER, dtype=bool)
    table_[(vocab >> K.U64(64 - _FILTER)).astype(np.int64)] = True
    return table_


def _template_words(w: K.Words, vocab: np.ndarray, sieve: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of template words and their number in ``vocab``."""
    sieve = _filter(vocab) if sieve is None else sieve
    at = np.flatnonzero(sieve[(w.hash >> K.U64(64 - _FILTER)).astype(np.int64)])
    code = np.minimum(np.searchsorted(vocab, w.hash[at]), len(vocab) - 1)
    same = vocab[code] == w.hash[at]
    return at[same], code[same]


def document_spread(docs: DataFrame, templates: list[tuple[str, str]], text_col: str = "text") -> dict[int, int]:
    """How many documents hold each template word: one small row a word from every task."""
    ship(docs.sparkSession)
    vocab = np.array(sorted({h for text, _ in templates for h in K.word_hash(text)}), dtype=K.U64)
    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_spread(vocab), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    return {int(vocab[r["code"]]): r["n"] for r in found}


def scan(docs: DataFrame, spread: dict[int, int], templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches``.

    ``matches`` are (template number, containment); ``score`` is the best containment, 1 where
    a phrase stands, 0 where nothing is found. A null text is an empty one; texts of any length are searched whole; a
    repeated row is scanned again, a null id stays null, an empty table gives no rows. Other columns are not read.
    """
    ship(docs.sparkSession)
    index = Templates(templates, spread)
    base: dict[int, list[tuple[int, str]]] = {}
    for phrase, label in phrases.items():
        h = np.array(K.word_hash(phrase), dtype=K.U64)
        with np.errstate(over="ignore"):
            base.setdefault(len(h), []).append((int(K.shingles(h, len(h))[0]), label))
    held = docs.sparkSession.sparkContext.broadcast((index, base, _filter(index.vocab)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        index, base, sieve = held.value
        for b in batches:
            for lo, hi, buf, offs in K.chunks(*K.text_buffers(b["text"])):
                w = K.Words(buf, offs, K.ALNUM_WORDS)
                n = hi - lo
                hits: dict[int, list[tuple[int, str]]] = {}
                for k, known in base.items():
                    runs = K.shingles(w.hash, k)
                    for h, label in known:
                        for p in np.flatnonzero(runs == K.U64(h)).tolist():
                            r = int(np.searchsorted(w.first, p, "right")) - 1
                            if p + k <= w.first[r + 1]:
                                hits.setdefault(r, []).append((p - int(w.first[r]), label))
                at, code = _template_words(w, index.vocab, sieve)
                ranks = index.rank[code]
                met = index.matches(at, ranks, w.rows()[at])
                cols: list[list] = [[] for _ in range(7)]
                for r in range(n):
                    own = hits.get(r, [])
                    found = met.get(r, {})
                    labels = {x for _, x in own}
                    places = [p for p, _ in own]
                    score = max([1.0 if own else 0.0, *found.values()])
                    for c, v in zip(cols, (len(own), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {index.labels[t] for t in found})), score, [{"template": t, "containment": s} for t, s in sorted(found.items())]), strict=True):
                        c.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("template", pa.int32()), ("containment", pa.float64())]))]
                names = ["n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(lo, n), pa.array(np.diff(w.first), pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_words", *names])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<template:int,containment:double>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: phrases and templates in every document."""
    docs = table(spark, sf_dir, "documents")
    return scan(docs, document_spread(docs, TEMPLATES)).drop("matches")
