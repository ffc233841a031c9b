"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters becomes a space, and n-grams of
2 and 3 code points are hashed to ``BUCKETS`` cells.  Training counts the cells
per language over all training rows: tasks count their own rows, one grouping
adds them up, and languages x ``BUCKETS`` sums reach the driver (at most
``MAX_LANGUAGES`` languages, else ValueError).  The log-probability matrix is
broadcast; a task adds up the rows of a document's cells in numpy.  A letter is
what Unicode calls one, in all planes; more than ``MAX_LANGUAGES`` languages raise
ValueError, as the matrix would have no bound.

Null text or one without a letter: ``und``, score 0.  Null language or id: a row
without a language is not learned from; without an id it belongs to the training
part.  Ties go to the language that sorts first.  No training rows: ``und``,
score 0.  Repeated rows count and are scored each.  Other columns are not read;
in ``identify`` the result columns replace input columns of the same names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


BUCKETS = 1 << 15
ORDERS = (2, 3)
MAX_LANGUAGES = 256
UNDETERMINED = "und"
_BLOCK_CHARS, _BLOCK_CELLS = 500_000, 4_000_000


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _segments(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Blocks of (text index, piece of it between spaces); of a long text a piece goes on by the
    longest n-gram less one into the next, and its n-grams are those that begin in its first
    ``_BLOCK_CHARS``, so each n-gram is in one piece."""
    owners, parts, size = [], [], 0
    for i, t in enumerate(texts):
        t = f" {(t or '').lower()} "
        for at in range(0, len(t) - min(ORDERS) + 1, _BLOCK_CHARS):
            part = t[at : at + _BLOCK_CHARS + max(ORDERS) - 1]
            if parts and size + len(part) > _BLOCK_CHARS:
                yield owners, parts
                owners, parts, size = [], [], 0
            owners.append(i)
            parts.append(part)
            size += len(part)
    if parts:
        yield owners, parts


def cells(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, first cell of each part, whether the part has a letter), for all orders one after the other."""
    chars = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4").copy()
    size = np.fromiter((len(p) for p in parts), dtype=np.int64, count=len(parts))
    end = np.cumsum(size)
    letter = _letters()[chars]
    chars[~letter] = 32
    found = np.add.reduceat(letter, end - size) > 0
    return chars, np.concatenate(([0], end)), found


def _hashed(chars: np.ndarray, order: int) -> np.ndarray:
    n = max(0, len(chars) - order + 1)
    h = np.full(n, order, dtype=np.uint32)
    for k in range(order):
        h = h * np.uint32(0x85EBCA6B) + chars[k : k + n]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(17)).astype(np.int32)  # 15 bits


def _inside(at: np.ndarray, n: int, order: int) -> np.ndarray:
    """Which of ``n`` n-grams lie in one part and are its own; parts begin at ``at``."""
    inside = np.ones(n + 1, dtype=bool)
    for k in range(1, order):  # n-grams that span two parts
        inside[np.minimum(at[1:] - k, n)] = False
    for k in range(max(ORDERS) - order):  # those that the next piece has
        inside[at[:-1][np.diff(at) >= _BLOCK_CHARS + order + k] + _BLOCK_CHARS + k] = False
    return inside[:n]


@dataclass
class LanguageModel:
    """``matrix``: log-probability of each cell (rows) in each language; the last row holds the priors."""

    languages: list[str]
    matrix: np.ndarray

    def expected(self) -> np.ndarray:
        """Mean log-probability of an n-gram of each language in that language."""
        logs = self.matrix[:-1].astype(np.float64)
        return (np.exp(logs) * logs).sum(axis=0)

    def posteriors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of probabilities, whether the text has a letter, and by language the
        mean log-probability of the text's n-grams less the expected one)."""
        total = np.tile(self.matrix[-1].astype(np.float64), (len(texts), 1))
        has, grams = np.zeros(len(texts), dtype=bool), np.zeros(len(texts), dtype=np.int64)
        for owners, parts in _segments(texts):
            chars, at, found = cells(parts)
            for order in ORDERS:
                self._add(total, np.array(owners), at, _hashed(chars, order), order)
                np.add.at(grams, owners, np.minimum(np.diff(at) - order + 1, _BLOCK_CHARS))
            np.logical_or.at(has, owners, found)
        typical = (total - self.matrix[-1]) / np.maximum(1, grams)[:, None] - self.expected()
        p = np.exp(total - total.max(axis=1, keepdims=True) if total.size else total)
        return p / p.sum(axis=1, keepdims=True), has, typical


    def _add(self, total: np.ndarray, owners: np.ndarray, at: np.ndarray, h: np.ndarray, order: int) -> None:
        """Adds the rows of the n-grams ``h`` of parts that begin at ``at`` to their owners'; as
        many rows at once as ``_BLOCK_CELLS`` allows for the number of languages."""
        part = np.repeat(np.arange(len(owners)), np.diff(at))[: len(h)]
        inside = _inside(at, len(h), order)
        part, h = part[inside], h[inside]
        step = max(1, _BLOCK_CELLS // max(1, len(self.languages)))
        for lo in range(0, len(h), step):
            own = part[lo : lo + step]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            np.add.at(total, owners[own[first]], np.add.reduceat(self.matrix[h[lo : lo + step]], first, axis=0, dtype=np.float64))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> LanguageModel:
    """Learns from all rows of ``docs`` that have a text and a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in langs:
                if lang not in sums:
                    sums[lang] = np.zeros(BUCKETS + 1, dtype=np.int64)
                sums[lang][-1] += 1
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                for _, parts in _segments(own):
                    chars, at, _ = cells(parts)
                    for order in ORDERS:
                        h = _hashed(chars, order)
                        sums[lang][:-1] += np.bincount(h[_inside(at, len(h), order)], minlength=BUCKETS)
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(s[at])], names=["lang", "cell", "n"])

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(lang_col, text_col)
    sums = rows.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    got = sums.limit(MAX_LANGUAGES * (BUCKETS + 1) + 1).toArrow()
    languages = sorted(got.column("lang").unique().to_pylist())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.zeros((BUCKETS + 1, len(languages)))
    place = {x: i for i, x in enumerate(languages)}
    column = got.column("lang").combine_chunks().dictionary_encode() if got.num_rows else None
    if column is not None:
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        which = np.array([place[x] for x in column.dictionary.to_pylist()])[column.indices.to_numpy()]
        counts[got.column("cell").to_numpy(), which] = got.column("n").to_numpy()
    grams, seen = counts[:-1] + smoothing, counts[-1:]
    with np.errstate(divide="ignore"):
        matrix = np.concatenate((np.log(grams / grams.sum(axis=0)), np.log(seen / max(1, seen.sum()))))
    return LanguageModel(languages, matrix.astype(np.float32))


def predicted(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """Struct (lang, score, typical) of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, typical double")
    def run(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        if not m.languages:
            return pd.DataFrame({"lang": [UNDETERMINED] * len(texts), "score": [0.0] * len(texts), "typical": [0.0] * len(texts)})
        p, has, typical = m.posteriors([t if isinstance(t, str) else None for t in texts])
        best = p.argmax(axis=1) if len(p) else np.zeros(0, dtype=int)
        own = np.arange(len(p)), best
        return pd.DataFrame({"lang": [m.languages[b] if h else UNDETERMINED for b, h in zip(best, has, strict=True)], "score": np.where(has, p[own], 0.0), "typical": typical[own]})

    return run(text)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (posterior of that language) and ``typical``:
    how much the text's n-grams differ from that language's in mean log-probability.
    The posterior of all but very short texts is near 1 for some language; a text in
    none of them, or of random letters, has a ``typical`` of some units below 0."""
    found = docs.withColumn("__lang", predicted(docs.sparkSession, model, F.col(text_col)))
    return found.withColumns({"lang_pred": F.col("__lang.lang"), "score": F.col("__lang.score"), "typical": F.col("__lang.typical")}).drop("__lang")


def held_out(id_col: str = "doc_id") -> Column:
    """The quarter of the rows by checksum of id that nothing is learned from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
