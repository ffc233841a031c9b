"""Licence notices in texts by a positional index of rare words.

A template is a published notice with mandatory key phrases.  Texts are lower-cased
(A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.

1. One pass over all rows counts in how many documents each template word occurs
   (one row a word and task), which gives its inverse document frequency (IDF).
2. The index holds each key phrase under its word of highest IDF in the corpus, with the
   word's place in the phrase and the phrase's in the template.  A file with a template
   has all its key phrases, so looking up the file's words of highest IDF in the index
   misses none, however often common words occur.
3. A posting puts the phrase at a place of the file, where its words are compared byte by
   byte.  A template is found where all its key phrases stand at one relative position,
   give or take ``SLACK`` words.  Its ``share`` is that of its words, weighted by IDF,
   which the file has around that position.

Templates are a fixed table and the index is of that size; documents are read twice,
nothing but counts is shuffled.  Null or empty text: no words, no spans.  Null ids and
repeated rows are scanned like others; an empty table gives no rows; other columns are
not read.  Texts of any length are scanned whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty
from .textops import LETTER_GAPS, Words, text_blocks, word_hashes, xxh64

#: words that may be missing or added between two key phrases of a template
SLACK = 12


@dataclass(frozen=True)
class Template:
    """Words of a notice, its label, and the key phrases it cannot be without."""

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False


#: fixed values: the phrases that every scan counts
BASE = (
    Template("cc-by", "cc by", ("cc by",), True),
    Template("gpl", "general public license", ("general public license",), True),
    Template("reserved", "all rights reserved", ("all rights reserved",), True),
)

#: fixed values: published notices and their key phrases
NOTICES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2.0-or-later", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license as published by the free software foundation", "either version 2 of the license", "any later version")),
    Template("gpl-3.0-or-later", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license as published by the free software foundation", "either version 3 of the license", "any later version")),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "with or without modification are permitted")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software", "with or without fee is hereby granted")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("epl-2.0", "made available under the terms of the eclipse public license v 2 0", ("eclipse public license",)),
    Template("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license version 1 0",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
    Template("cc0-1.0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc-by-4.0", "creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international",)),
)


@dataclass
class Index:
    """Rare words of the key phrases: ``rare`` maps a vocabulary number to postings (phrase, place of the word in it)."""

    templates: tuple[Template, ...]
    words: list[str]
    idf: np.ndarray
    phrases: list[bytes] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    rare: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    #: by template: (phrase, its place in the template)
    keys: list[list[tuple[int, int]]] = field(default_factory=list)

    def __post_init__(self) -> None:
        number = {w: i for i, w in enumerate(self.words)}
        at: dict[str, int] = {}
        for t in self.templates:
            whole = t.text.split(" ")
            own = []
            for key in t.keys:
                parts = key.split(" ")
                start = next(i for i in range(len(whole)) if whole[i : i + len(parts)] == parts)
                if key not in at:
                    at[key] = len(self.phrases)
                    self.phrases.append(key.encode())
                    self.sizes.append(len(parts))
                    rarest = max(range(len(parts)), key=lambda i: (self.idf[number[parts[i]]], -i))
                    self.rare.setdefault(number[parts[rarest]], []).append((at[key], rarest))
                own.append((at[key], start))
            self.keys.append(own)
        self.weights = [(np.array(sorted({number[w] for w in t.text.split(" ")})), len(t.text.split(" "))) for t in self.templates]
        self.hashes, self.order = _vocabulary(self.words)
        self.is_rare = np.isin(np.arange(len(self.words)), list(self.rare))

    def numbers(self, words: Words) -> np.ndarray:
        """The vocabulary number of each word, -1 for others."""
        h = word_hashes(words)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.order[at], -1)

    def spans(self, words: Words, numbers: np.ndarray, a: int, b: int, rare: np.ndarray) -> list[tuple[str, bool, int, int, float]]:
        """(label, base, first word, word after the last, share) in the text of words ``a`` to
        ``b``; ``rare``: places of its words that the index holds."""
        places: dict[int, list[int]] = {}
        for i in rare[np.argsort(-self.idf[numbers[rare]], kind="stable")].tolist():
            for phrase, inside in self.rare[int(numbers[i])]:
                s = i - inside
                e = s + self.sizes[phrase]
                text = self.phrases[phrase]
                if s >= a and e <= b and words.end[e - 1] - words.start[s] == len(text) and words.buf[words.start[s] : words.end[e - 1]].tobytes() == text:
                    places.setdefault(phrase, []).append(s - a)
        for p in places.values():
            p.sort()
        out = []
        for t, keys, (own, size) in zip(self.templates, self.keys, self.weights, strict=True):
            if any(k not in places for k, _ in keys):
                continue
            first, offset = min(keys, key=lambda k: len(places[k[0]]))
            for s in places[first]:
                diagonal = s - offset
                ends = [s + self.sizes[first]]
                starts = [s]
                for k, o in keys:
                    near = places[k]
                    i = bisect_left(near, diagonal + o - SLACK)
                    if i == len(near) or near[i] > diagonal + o + SLACK:
                        break
                    starts.append(near[i])
                    ends.append(near[i] + self.sizes[k])
                else:
                    window = numbers[max(a, a + diagonal - SLACK) : min(b, a + diagonal + size + SLACK)]
                    weight = self.idf[own]
                    share = float(weight[np.isin(own, window)].sum() / weight.sum())
                    out.append((t.label, t.base, min(starts), max(ends), min(1.0, share)))
        return out


def _vocabulary(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words, and the number of each."""
    data = np.frombuffer("".join(words).encode() + b"\0" * 16, dtype=np.uint8)
    end = np.cumsum([len(w.encode()) for w in words])
    h = xxh64(data, np.concatenate(([0], end[:-1])), end)
    order = np.argsort(h)
    return h[order], order


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int, Words]]:
    for first, block in text_blocks(texts):
        yield first, len(block), Words(block, lower=True, separator=LETTER_GAPS)


def rarities(docs: DataFrame, words: list[str], text_col: str = "text") -> np.ndarray:
    """IDF of each of ``words`` over all rows: log((rows + 1) / (rows with it + 1)) + 1."""
    hashes, order = _vocabulary(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(words) + 1, dtype=np.int64)
        for batch in batches:
            sums[-1] += batch.num_rows
            for _, n, found in _blocks(batch.column(0).to_pylist()):
                h = word_hashes(found)
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = hashes[at] == h
                seen = np.unique(found.owner()[hit] * len(words) + order[at[hit]])
                sums[:-1] += np.bincount(seen % len(words), minlength=len(words))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["word", "n"])

    rows = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row a template word
    n = np.zeros(len(words) + 1)
    for r in rows:
        n[r["word"]] = r["n"]
    return np.log((n[-1] + 1) / (n[:-1] + 1)) + 1


def index(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, text_col: str = "text") -> Index:
    words = sorted({w for t in templates for w in t.text.split(" ")})
    return Index(templates, words, rarities(docs, words, text_col))


def scan(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, spans): where templates stand in each text, in words from 0."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    span = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            sizes, spans = [], []
            for _, n, words in _blocks(batch.column(1).to_pylist()):
                numbers = own.numbers(words)
                rare = np.flatnonzero((numbers >= 0) & own.is_rare[numbers])
                cut = np.searchsorted(rare, words.first)
                for i in range(n):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    sizes.append(b - a)
                    mine = rare[cut[i] : cut[i + 1]]
                    found = own.spans(words, numbers, a, b, mine) if len(mine) else []
                    spans.append([dict(zip(("label", "base", "start", "end", "share"), s, strict=True)) for s in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span)], names=["id", "n_words", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, n_words long, spans array<struct<label: string, base: boolean, start: long, end: long, share: double>>")
    return found.withColumnRenamed("id", id_col)


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, index(docs))
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels("spans").alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )
