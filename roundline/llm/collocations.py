"""Frequent phrases and how firmly their words belong together, by Rabin-Karp fingerprints.

Texts are lower-cased (A-Z), cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into
words ``[^\\x20\\x09]+``.  A task turns a block of texts into word hashes and prefix
polynomials over them in numpy: the fingerprint of any run of words is a difference
of two prefix values.

1. Words, then pairs, then runs of three words or more are counted.  A task adds up
   its own fingerprints first; one shuffle adds up the tasks'.  A run is only looked
   at where all its words (its pairs) may be frequent, as a bit table of the frequent
   fingerprints tells: it has a fixed greatest size, and a full one only costs time.
2. In a last pass every occurrence of a frequent fingerprint is compared with the
   bytes of the first one its task met; other texts of that fingerprint become rows of
   their own.  The shuffle adds these up by language, fingerprint and text, each with a
   pointer (document, word) to one occurrence, so counts are of texts, not of
   fingerprints, and only runs with a frequent fingerprint, and their words, ever become
   strings.
3. Scores, cuts and the test of longer phrases are joins over the frequent phrases,
   which are at most a hundredth of the words by number.

Null text: empty.  Null language: ``und``, together with rows of that name.  A row
without id takes part; its pointer is null.  Repeated rows count each time.  An empty
table gives no rows.  Other columns are not read.  Words and texts of any length are
kept whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch, table, text_or_empty, written
from .textops import U64, differs, mix, text_blocks, xxh64

UNDETERMINED = "und"
LONGEST = 5
LEAST_COUNT = 100
PER_LANGUAGE = 2000

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: rows that a task gathers before it hands its sums on
_HELD = 1 << 20
#: bits of the table of frequent fingerprints: at least 16 a fingerprint, up to 64 MB
_MOST_BITS, _LEAST_BITS, _BITS_EACH = 1 << 29, 1 << 16, 16
_BLOCK_BITS = 1 << 19
#: where in a fingerprint its bits of the table begin
_SHIFTS = (0, 17, 35)

_GAP, _CUT, _LOWER = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool), np.arange(256, dtype=np.uint8)
_CUT[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_GAP[list(b" \t")] = True
_GAP |= _CUT
_LOWER[65:91] += 32


class Runs:
    """Words of a block of texts, joined by single spaces in ``buf``: ``start``, ``end`` in
    bytes, ``owner`` (index of the text), ``number`` in it, and ``left``: how many words of
    the piece begin at or after each word."""

    def __init__(self, texts: list[bytes]):
        raw = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
        gap = _GAP[raw]
        before = np.concatenate(([True], gap[:-1]))
        begins = np.flatnonzero(~gap & before)
        size = np.flatnonzero(gap & ~before) - begins
        self.buf = np.concatenate((raw[~gap | ~before], np.zeros(64, dtype=np.uint8)))
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        self.buf[self.end] = 0x20
        at = np.concatenate(([0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))))
        first = np.searchsorted(begins, at)
        self.owner = np.repeat(np.arange(len(texts)), np.diff(first))
        self.number = np.arange(len(begins)) - first[self.owner]
        piece = np.cumsum(_CUT[raw])[begins]
        new = np.flatnonzero(np.concatenate((piece[1:] != piece[:-1], [True]))) + 1 if len(piece) else np.zeros(0, dtype=np.int64)
        self.left = np.repeat(new, np.diff(np.concatenate(([0], new)))) - np.arange(len(begins))
        # prefix polynomials: the sum of word hash times inverse power, so that a run's
        # difference times the base's power at its start does not depend on its place
        with np.errstate(over="ignore"):
            n = len(begins) + 1
            powers = np.ones((2, n), dtype=U64)
            powers[0, 1:], powers[1, 1:] = U64(_BASE), U64(_INVERSE)
            self._power, inverse = np.cumprod(powers, axis=1)
            self._prefix = np.concatenate((np.zeros(1, dtype=U64), np.cumsum(mix(xxh64(self.buf, self.start, self.end)) * inverse[:-1])))

    def fingerprints(self, size: int, at: np.ndarray, salts: np.ndarray) -> np.ndarray:
        """Of the runs of ``size`` words that begin at ``at``; ``salts`` by text."""
        with np.errstate(over="ignore"):
            return mix((self._prefix[at + size] - self._prefix[at]) * self._power[at] + salts[self.owner[at]] + U64(size))


class Bits:
    """Set of fingerprints by three bits of each: answers "no" only for what is not in it."""

    def __init__(self, data: np.ndarray):
        self._data, self._mask = data, U64(len(data) * 8 - 1)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), dtype=bool)
        left = np.arange(len(keys))
        for shift in _SHIFTS:
            at = (keys[left] >> U64(shift)) & self._mask
            left = left[(self._data[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1]
        out[left] = True
        return out


def bit_table(frequent: DataFrame) -> np.ndarray:
    """Column ``key`` as a bit table, put together by the executors."""
    count = frequent.count()
    size = _LEAST_BITS
    while size < min(_MOST_BITS, _BITS_EACH * count):
        size *= 2

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = np.zeros(size // 8, dtype=np.uint8)
        for b in batches:
            for shift in _SHIFTS:
                at = (np.asarray(b.column(0)).view(U64) >> U64(shift)) & U64(size - 1)
                np.bitwise_or.at(data, (at >> U64(3)).astype(np.int64), U64(1).astype(np.uint8) << (at & U64(7)).astype(np.uint8))
        step = min(size, _BLOCK_BITS) // 8
        for i in range(0, len(data), step):
            if data[i : i + step].any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([data[i : i + step].tobytes()], pa.binary())], names=["i", "data"])

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        out = np.frombuffer(group.data.iloc[0], dtype=np.uint8).copy()
        for d in group.data.iloc[1:]:
            out |= np.frombuffer(d, dtype=np.uint8)
        return pd.DataFrame({"i": [group.i.iloc[0]], "data": [out.tobytes()]})

    out = np.zeros(size // 8, dtype=np.uint8)
    for row in frequent.select("key").mapInArrow(own, "i long, data binary").groupBy("i").applyInPandas(joined, "i long, data binary").toLocalIterator():
        out[row["i"] : row["i"] + len(row["data"])] = np.frombuffer(row["data"], dtype=np.uint8)
    return out


def _salts(langs: list[str]) -> np.ndarray:
    parts = [x.encode() for x in langs]
    end = np.cumsum(np.fromiter((len(p) for p in parts), dtype=np.int64, count=len(parts)))
    return mix(xxh64(np.frombuffer(b"".join(parts) + b"\0" * 16, dtype=np.uint8), end - [len(p) for p in parts], end, 1))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[list[str], list, Runs]]:
    """(languages, ids, words) of blocks of a batch (lang, doc_id, text)."""
    langs, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    for first, texts in text_blocks(batch.column(2).to_pylist()):
        some = slice(first, first + len(texts))
        yield langs[some], ids[some], Runs(texts)


def _possible(runs: Runs, salts: np.ndarray, size: int, known: Bits | None, part: int) -> np.ndarray:
    """Starts of the runs of ``size`` words all of whose runs of ``part`` words may be frequent."""
    fits = runs.left >= size
    if known is not None and len(fits):
        whole = np.flatnonzero(runs.left >= part)
        good = np.zeros(len(fits), dtype=bool)
        good[whole[known.may_hold(runs.fingerprints(part, whole, salts))]] = True
        for i in range(size - part + 1):
            fits &= np.concatenate((good[i:], np.zeros(i, dtype=bool)))[: len(fits)]
    return np.flatnonzero(fits)


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, dtype=np.int64)
    return k[at], np.add.reduceat(c, at) if len(k) else c


def counted(rows: DataFrame, sizes: tuple[int, ...], known: np.ndarray | None, part: int) -> DataFrame:
    """(lang, key, n) of all runs of ``sizes`` words in ``rows`` (lang, doc_id, text) that the
    bit table of runs of ``part`` words lets through.  For size 1 there is also a row a
    language with all its words, ``key`` null; where the table is of pairs, a row with n = 0
    for each word of a pair in it."""
    shared = rows.sparkSession.sparkContext.broadcast(known) if known is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = Bits(shared.value) if shared is not None else None
        keys, counts, held, words = [], [], 0, {}

        def batch(k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(n)], names=["lang", "key", "n"])

        for b in batches:
            for langs, _, runs in _blocks(b):
                salts = _salts(langs)
                if 1 in sizes:
                    for lang, n in zip(langs, np.bincount(runs.owner, minlength=len(langs)).tolist(), strict=True):
                        words[lang] = words.get(lang, 0) + n
                for size in sizes:
                    at = _possible(runs, salts, size, filter_, part)
                    k, n = np.unique(runs.fingerprints(size, at, salts), return_counts=True)
                    keys.append(k)
                    counts.append(n)
                    held += len(k)
                if part == 2:
                    at = _possible(runs, salts, 2, filter_, part)
                    k = np.unique(runs.fingerprints(1, np.concatenate((at, at + 1)), salts))
                    keys.append(k)
                    counts.append(np.zeros(len(k), dtype=np.int64))
                    held += len(k)
                if held > 2 * _HELD:
                    k, n = _added(keys, counts)
                    keys, counts, held = [k], [n], len(k)
                    if held > _HELD:
                        yield batch(k, n)
                        keys, counts, held = [], [], 0
        if keys:
            yield batch(*_added(keys, counts))
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())], names=["lang", "key", "n"])

    return rows.mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _texts(runs: Runs, size: int, keys: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, place of the first occurrence, occurrences) of each text among the runs at ``at``."""
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], at[order]
    new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=bool)
    head = np.flatnonzero(new)
    first = at[head][np.cumsum(new) - 1] if len(at) else at
    a, b = runs.start[at], runs.start[first]
    length = runs.end[at + size - 1] - a
    odd = length != runs.end[first + size - 1] - b
    odd |= differs(runs.buf, a, b, np.where(odd, 0, length))
    sums = np.add.reduceat((~odd).astype(np.int64), head) if len(head) else head
    yield from zip(keys[head].tolist(), at[head].tolist(), sums.tolist(), strict=True)
    others: dict[tuple[int, bytes], list[int]] = {}
    for i in np.flatnonzero(odd).tolist():  # other texts of the same fingerprint
        text = runs.buf[runs.start[at[i]] : runs.end[at[i] + size - 1]].tobytes()
        others.setdefault((int(keys[i]), text), []).append(int(at[i]))
    for (key, _), places in others.items():
        yield key, places[0], len(places)


def verified(rows: DataFrame, known: np.ndarray, least: int, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, words, n, doc_id, word) of the runs of 1 to ``longest`` words whose
    fingerprint may be in the bit table and whose text occurs ``least`` times or more;
    doc_id and word point at its first occurrence."""
    shared = rows.sparkSession.sparkContext.broadcast(known)
    made = "lang string, key long, words int, phrase string, n long, doc_id long, word long"
    schema = pa.schema([("lang", pa.string()), ("key", pa.int64()), ("words", pa.int32()), ("phrase", pa.string()), ("n", pa.int64()), ("doc_id", pa.int64()), ("word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Bits(shared.value)
        held: dict[tuple[str, int, bytes], list] = {}

        def full() -> pa.RecordBatch:
            columns = [[], [], [], [], [], [], []]
            for (lang, size, text), (key, n, (has_id, doc, word)) in held.items():
                for c, v in zip(columns, (lang, key, size, text.decode("utf-8", "replace"), n, doc if has_id else None, word if has_id else None), strict=True):
                    c.append(v)
            columns[1] = np.array(columns[1], dtype=U64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for b in batches:
            for langs, ids, runs in _blocks(b):
                salts = _salts(langs)
                for size in range(1, longest + 1):
                    at = np.flatnonzero(runs.left >= size)
                    keys = runs.fingerprints(size, at, salts)
                    some = bits.may_hold(keys)
                    for key, i, n in _texts(runs, size, keys[some], at[some]):
                        doc = ids[runs.owner[i]]
                        place = (doc is not None, doc or 0, int(runs.number[i]))
                        name = (langs[runs.owner[i]], size, runs.buf[runs.start[i] : runs.end[i + size - 1]].tobytes())
                        if own := held.get(name):
                            own[1] += n
                            own[2] = place if place[0] and (not own[2][0] or place < own[2]) else own[2]
                        else:
                            held[name] = [key, n, place]
                if len(held) > _HELD // 4:
                    yield full()
                    held = {}
        if held:
            yield full()

    pointer = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "word")))
    found = rows.mapInArrow(run, made).groupBy("lang", "key", "words", "phrase").agg(F.sum("n").alias("n"), pointer.alias("at"))
    return found.where(F.col("n") >= least).select("lang", "phrase", "words", "n", "at.doc_id", "at.word")


def frequent_phrases(docs: DataFrame, folder: str, least: int = LEAST_COUNT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, n, doc_id, word), (lang, n)): runs of two words or more that occur
    ``least`` times in a language and the words they are made of, and the number of words of
    each language; written tables."""
    rows = docs.select(F.coalesce(F.col("lang"), F.lit(UNDETERMINED)).alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    if longest < 2:
        raise ValueError("a phrase has two words or more")
    found = written(counted(rows, (1,), None, 1).where((F.col("n") >= least) | F.col("lang").isNotNull()), f"{folder}/words")
    totals = found.where("lang is not null").select("lang", "n")
    words = bit_table(found.where("lang is null"))
    pairs = written(counted(rows, (2,), words, 1).where(F.col("n") >= least), f"{folder}/pairs")
    longer = written(counted(rows, tuple(range(3, longest + 1)), bit_table(pairs), 2).where((F.col("n") >= least) | (F.col("n") == 0)), f"{folder}/longer")
    known = bit_table(pairs.select("key").unionByName(longer.select("key")))
    return written(verified(rows, known, least, longest), f"{folder}/phrases"), totals


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(38,0)")


def collocations(phrases: DataFrame, totals: DataFrame, most: int = PER_LANGUAGE, percent: int = 100) -> DataFrame:
    """Each language's first ``most`` phrases of two words or more by score.

    A phrase of n occurrences cut into two parts scores floor(1000 * n * words / (left *
    right)); its lowest cut counts.  Phrases inside a longer frequent one that has
    ``percent`` of their occurrences go: a phrase inside it that is longer by one word
    is then enough to tell, as counts only grow from longer to shorter."""
    candidates = phrases.where("words > 1").withColumnRenamed("n", "a")
    cuts = candidates.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - words)")})
    counts = phrases.select("lang", "phrase", "n")
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    cuts = cuts.join(totals.select("lang", F.col("n")), "lang")
    product = _exact("l") * _exact("r")
    cuts = cuts.withColumn("score", F.call_function("div", F.lit(1000).cast("decimal(38,0)") * _exact("a") * _exact("n"), product))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "n")).alias("cut"))
    shorter = F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)")))
    inside = candidates.where("words > 2").select("lang", shorter.alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = candidates.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
    rows = kept.join(lowest, ["lang", "phrase"]).select("lang", "phrase", "words", "a", "cut.*", "doc_id", "word")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases, totals = frequent_phrases(table(spark, sf_dir, "documents"), scratch(spark, "collocations"))
    return collocations(phrases, totals).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
