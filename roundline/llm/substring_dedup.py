"""Substring dedup: repeated word windows by level-wise doubling.

A window of ``window`` words is repeated if its word sequence starts anywhere
else.  Windows of a first length are grouped over the corpus; those that are
repeated alone are extended to twice that length, and so on up to ``window``.

At each level but the last a window of ``window`` words is stood for by one of
the shorter windows in it, that of least hash (equal word sequences choose
alike), so few positions of each text are grouped.  Tasks group their own
windows first and send one row for each distinct one: a passage that many
documents share gives at most one row a task and flush, whatever its number of
copies.  No group is ever gathered; grouping counts rows by a window function
over those few.

Texts are dealt out once by (id, hash of text); every level reads that exchange
again.  Windows are told apart by 96 bits of two hash families over two hashes of
each word; equal hashes count as equal words.

Null text: no words.  Null id: a row like any other.  Rows that share id and
text are separate documents whose windows repeat each other's; what is known of
them meets as a set of places, whatever their number.  Empty table:
empty result.  Result columns replace input columns of the same names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table
from .textops import U64, WindowHash, Words, column_bytes, mix, text_blocks, word_hashes

#: rows of one task's own grouping at once
FLUSH_ROWS = 1_000_000
#: ``h1`` and the upper half of ``h2_at`` are the window's hash, the lower half is
#: its place; ``run``: 0 asks whether the window is seen elsewhere, else so many
#: places from there on are known to be; a null key wants no answer
_SEEN = "h1 long, h2_at long, key long, tie long, run int"
_HIGH = U64(0xFFFFFFFF00000000)


def levels(window: int, first: int = 24) -> list[int]:
    """Lengths that double up to ``window``; the shortest is over half of ``first``."""
    out = [window]
    while out[0] > first:
        out.insert(0, (out[0] + 1) // 2)
    return out


class _Grouped:
    """A task's own grouping of (hash, document, position) rows."""

    def __init__(self):
        self._parts: list[tuple[np.ndarray, ...]] = []
        self._n = 0

    def add(self, h1: np.ndarray, h2: np.ndarray, key: np.ndarray, tie: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        self._parts.append((h1, h2, key, tie, at))
        self._n += len(h1)
        if self._n >= FLUSH_ROWS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        """Windows that this task has twice are known to be repeated: they leave as
        runs of places, and one row without key stands for them to the others."""
        if not self._n:
            return
        h1, h2, key, tie, at = (np.concatenate(x) for x in zip(*self._parts, strict=True))
        self._parts, self._n = [], 0
        h2 = h2 & _HIGH
        order = np.lexsort((h2, h1))
        h1, h2, key, tie, at = (x[order] for x in (h1, h2, key, tie, at))
        same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        after, before = np.concatenate(([False], same)), np.concatenate((same, [False]))
        ask = ~after
        yield from _rows(h1[ask], h2[ask] | at[ask].astype(U64), key[ask], tie[ask], np.zeros(int(ask.sum()), dtype=np.int32), before[ask])
        known = after | before
        if not known.any():
            return
        key, tie, at = key[known], tie[known], at[known]
        order = np.lexsort((at, tie, key))
        key, tie, at = (x[order] for x in (key, tie, at))
        new = np.ones(len(at), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (tie[1:] != tie[:-1]) | (at[1:] > at[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(at)])) - 1
        key, tie, run, at = key[first], tie[first], at[last] - at[first] + 1, at[first].astype(U64)
        own = mix(key.view(U64) ^ mix(tie.view(U64) + at))
        yield from _rows(own, (mix(own) & _HIGH) | at, key, tie, run, np.zeros(len(run), dtype=bool))


def _rows(h1: np.ndarray, h2_at: np.ndarray, key: np.ndarray, tie: np.ndarray, run: np.ndarray, no_answer: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(h1), 50_000):
        c = slice(lo, lo + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(h1[c].view(np.int64)), pa.array(h2_at[c].view(np.int64)), pa.array(key[c], mask=no_answer[c]), pa.array(tie[c]), pa.array(run[c].astype(np.int32))], names=["h1", "h2_at", "key", "tie", "run"])


def _anchors(hashes: np.ndarray, span: int) -> np.ndarray:
    """Place of the least hash (the first, if several) among each ``span`` in a row."""
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best = np.arange(n)
    low = hashes[:n].copy()
    for k in range(1, span):
        less = hashes[k : k + n] < low
        low = np.where(less, hashes[k : k + n], low)
        best[less] = np.flatnonzero(less) + k
    return best


class _Block:
    """Windows of a block of texts."""

    def __init__(self, texts: list[bytes], window: int):
        self.words = Words(texts)
        self._hash = tuple(WindowHash(word_hashes(self.words, seed), seed) for seed in (0, 1))
        self._window = window
        owner = self.words.owner()
        n = max(0, len(owner) - window + 1)
        self.starts = np.flatnonzero(owner[:n] == owner[window - 1 :]) if n else np.zeros(0, dtype=np.int64)
        self.owner = owner

    def stand_ins(self, length: int) -> np.ndarray:
        """For each of ``starts`` the start of the window of ``length`` that stands for it."""
        if length == self._window:
            return self.starts
        return _anchors(self._hash[0].of(length), self._window - length + 1)[self.starts]

    def hashes(self, length: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(h.of(length)[at] for h in self._hash)


def _alive(block: _Block, length: int, alive: list[list[int] | None]) -> np.ndarray:
    """Which of ``starts`` have a stand-in of ``length`` among the repeated ones of its document."""
    stand = block.stand_ins(length)
    delta = np.zeros(len(block.owner) + 1, dtype=np.int32)
    for i, places in enumerate(alive):
        if places:
            at, n = _spans(places)
            np.add.at(delta, block.words.first[i] + at, 1)
            np.add.at(delta, block.words.first[i] + at + n, -1)
    return np.cumsum(delta)[stand] > 0


def _level(batches: Iterator[pa.RecordBatch], window: int, length: int, before: int | None) -> Iterator[pa.RecordBatch]:
    """Rows of one level from batches with text, key, tie and, after the first level, places."""
    group = _Grouped()
    for batch in batches:
        key, tie = batch.column("__key").to_numpy(), batch.column("__tie").to_numpy()
        for first, texts in text_blocks(column_bytes(batch.column("__text"))):
            block = _Block(texts, window)
            at = block.stand_ins(length)
            if before:
                at = at[_alive(block, before, batch.column("__places")[first : first + len(texts)].to_pylist())]
            at = np.unique(at)
            owner = block.owner[at]
            h1, h2 = block.hashes(length, at)
            yield from group.add(h1, h2, key[first + owner], tie[first + owner], at - block.words.first[owner])
    yield from group.flush()


def _repeated(rows: DataFrame) -> DataFrame:
    """Places per document of the windows that are seen twice, as runs (place
    times 2**32 plus length): (__key, __tie, __places)."""
    n = F.count(F.lit(1)).over(W.partitionBy("h1", "h2"))
    # the upper half of the hash is taken after the exchange, which so carries less
    met = rows.repartition("h1").withColumn("h2", F.shiftright("h2_at", 32)).withColumn("n", n)
    found = met.where("key is not null and (run > 0 or n > 1)")
    place = F.shiftleft(F.col("h2_at").bitwiseAND(F.lit(0xFFFFFFFF)), 32) + F.greatest("run", F.lit(1))
    return found.groupBy(F.col("key").alias("__key"), F.col("tie").alias("__tie")).agg(F.collect_set(place).alias("__places"))


def _spans(places: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(first places, lengths) of runs."""
    packed = np.asarray(places, dtype=np.int64)
    return packed >> 32, packed & 0xFFFFFFFF


def _dealt(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the text again and the key (null id: the smallest long) and
    tie that name a row's text."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    return docs.select("*", key.alias("__key"), F.xxhash64(text_col).alias("__tie"))


def _places(dealt: DataFrame, window: int, text_col: str) -> DataFrame:
    """First words of the repeated windows of each document that has any."""
    found, before = None, None
    for length in levels(window):
        # all columns, so that each level reads the same exchange of the texts
        source = dealt.repartition("__key", "__tie").join(found, ["__key", "__tie"]) if before else dealt.select(text_col, "__key", "__tie")
        at = source.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], length=length, before=before, at=at) -> Iterator[pa.RecordBatch]:
            named = (pa.RecordBatch.from_arrays(b.columns, names=["__text" if i == at else c for i, c in enumerate(b.schema.names)]) for b in batches)
            return _level(named, window, length, before)

        found, before = _repeated(source.mapInArrow(run, _SEEN)), length
    return found


def _covered(n_words: int, places: list[int] | None, window: int) -> np.ndarray:
    delta = np.zeros(n_words + 1, dtype=np.int32)
    if places:
        at, n = _spans(places)
        np.add.at(delta, at, 1)
        np.add.at(delta, at + n - 1 + window, -1)
    return np.cumsum(delta[:-1]) > 0


def cleaned(docs: DataFrame, window: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept``: the words that no
    repeated window covers, joined by one space."""
    own = docs.drop(*({"n_words", "n_removed", "kept"} - {id_col, text_col}))
    names = own.columns
    dealt = _dealt(own, id_col, text_col)
    both = dealt.repartition("__key", "__tie").join(_places(dealt, window, text_col), ["__key", "__tie"], "left")
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_blocks(column_bytes(batch.column(place))):
                part = batch.slice(first, len(texts))
                words = Words(texts)
                size = np.diff(words.first)
                gone = [_covered(n, p, window) for n, p in zip(size, part.column(len(names)).to_pylist(), strict=True)]
                keep = ~np.concatenate(gone) if gone else np.zeros(0, dtype=bool)
                kept = [words.text(i, keep) for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(size, pa.int64()), pa.array([int(g.sum()) for g in gone], pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[*names, "n_words", "n_removed", "kept"])

    schema = own.schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return both.select(*names, "__places").mapInArrow(run, schema)


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cleaned(table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)
    return docs.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
