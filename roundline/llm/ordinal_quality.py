"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A rating is a grade 0 .. K-1.  One weight vector over hashed text features is
shared by all grades and ordered thresholds part them:
``P(grade <= k) = sigmoid(threshold_k - score)``.  The model gives the expected
grade and, for selection, the tail probability ``P(grade >= g)``.

Features of a whole text: hashed lower-case words (present or not, scaled by
the root of their number) and hashed bands of a few shape figures (share of
upper case, of punctuation, of distinct words, size of words).

The fit takes at most ``max_rows`` rated documents, those of smallest hash of
id; that bound is what the driver and each broadcast hold, at every input size.
Scoring is map-only over all documents.

Null or empty text: shape features only.  Null id or rating: not used to fit.
Several ratings of a document: the lowest counts.  One grade only: every
document gets it with probability 1.  No rated documents: expected grade null,
tail 1, all accepted.  Repeated rows are scored each.  The result columns replace
input columns of the same names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty
from .textops import LETTER_GAPS, U64, Words, column_bytes, text_blocks, word_hashes

BUCKETS = 1 << 18
MAX_ROWS = 12_000
_SHAPES = 4
_BANDS = 20
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_MARK = LETTER_GAPS.copy()
_MARK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def features(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (first, index, value): ``index[first[i]:first[i+1]]`` are text i's features."""
    words = Words(texts, lower=True, separator=LETTER_GAPS)
    n = len(texts)
    owner = words.owner().astype(np.int64)
    space = buckets - _SHAPES * (_BANDS + 1)
    cell = owner * buckets + (word_hashes(words, seed=1) % U64(space)).astype(np.int64)
    cell = np.unique(cell)
    distinct = np.bincount(cell // buckets, minlength=n)
    size = np.maximum(1, np.fromiter(map(len, texts), dtype=np.int64, count=n))
    n_words = np.maximum(1, np.diff(words.first))
    upper, marks = np.zeros(n), np.zeros(n)
    for i, t in enumerate(texts):
        raw = np.frombuffer(t, dtype=np.uint8)
        upper[i], marks[i] = np.count_nonzero(_UPPER[raw]), np.count_nonzero(_MARK[raw])
    shape = np.stack((upper / size, 2 * marks / size, distinct / n_words, size / n_words / 20))
    band = (np.clip(shape, 0, 1) * _BANDS).astype(np.int64)
    extra = np.arange(n) * buckets + space + np.arange(_SHAPES)[:, None] * (_BANDS + 1) + band
    cell = np.sort(np.concatenate((cell, extra.ravel())))
    rows, index = cell // buckets, cell % buckets
    value = np.where(index < space, 1 / np.sqrt(np.maximum(1, distinct))[rows], 1.0).astype(np.float32)
    return np.searchsorted(rows, np.arange(n + 1)), index.astype(np.int32), value


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    """``grades`` are the ratings in order; K - 1 ascending ``thresholds``."""

    grades: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        first, index, value = features(texts, len(self.weights))
        return np.add.reduceat(self.weights[index] * value, first[:-1]) if len(texts) else np.zeros(0)

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """Rows of P(each grade)."""
        below = _sigmoid(self.thresholds[None, :] - scores[:, None])
        return np.diff(np.concatenate((np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))), axis=1), axis=1)


def fit(first: np.ndarray, index: np.ndarray, value: np.ndarray, grade: np.ndarray, buckets: int = BUCKETS, rounds: int = 150, rate: float = 0.15, ridge: float = 1e-5, min_rows: int = 8) -> OrdinalModel:
    """Full-batch maximum likelihood by adaptive moments; deterministic.  A
    feature of fewer than ``min_rows`` rows keeps the weight 0."""
    grades = np.unique(grade)
    y = np.searchsorted(grades, grade)
    k = len(grades)
    if k < 2:
        return OrdinalModel(grades, np.zeros(buckets, dtype=np.float32), np.zeros(0))
    share = np.cumsum(np.bincount(y, minlength=k))[:-1] / len(y)
    cut = np.log(share / (1 - share))
    # thresholds as the first and the logs of the steps, so that they stay in order
    free = np.concatenate((cut[:1], np.log(np.maximum(np.diff(cut), 1e-3))))
    w = np.zeros(buckets)
    mean, square = np.zeros(buckets + k - 1), np.zeros(buckets + k - 1)
    row = np.repeat(np.arange(len(y)), np.diff(first))
    common = (np.bincount(index, minlength=buckets) >= min(min_rows, len(y)))[index]
    index, value, row = index[common], value[common], row[common]
    for step in range(1, rounds + 1):
        theta = np.cumsum(np.concatenate((free[:1], np.exp(free[1:]))))
        s = np.bincount(row, weights=w[index] * value, minlength=len(y))
        ends = np.concatenate(([-np.inf], theta, [np.inf]))
        hi, lo = _sigmoid(ends[y + 1] - s), _sigmoid(ends[y] - s)
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        d_hi[y == k - 1], d_lo[y == 0] = 0, 0
        d_s = (d_hi - d_lo) / len(y)  # of minus the mean log-likelihood
        d_theta = np.array([d_lo[y == j + 1].sum() - d_hi[y == j].sum() for j in range(k - 1)]) / len(y)
        d_free = np.array([d_theta.sum(), *(np.exp(free[j]) * d_theta[j:].sum() for j in range(1, k - 1))])
        grad = np.concatenate((np.bincount(index, weights=d_s[row] * value, minlength=buckets) + ridge * w, d_free))
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        w -= move[:buckets]
        free -= move[buckets:]
    return OrdinalModel(grades, w.astype(np.float32), np.cumsum(np.concatenate((free[:1], np.exp(free[1:])))))


def train(docs: DataFrame, ratings: DataFrame, max_rows: int = MAX_ROWS, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fits on documents joined with ``ratings`` (id, grade)."""
    rated = ratings.where(F.col(id_col).isNotNull() & F.col("grade").isNotNull()).groupBy(id_col).agg(F.min("grade").alias("grade"))
    sample = rated.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)  # max_rows rows at most are broadcast
    # one text of each rated id, by digest, so that repeated ids change neither the number nor the choice of rows
    met = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("text")).join(F.broadcast(sample.withColumnRenamed(id_col, "__id")), "__id")
    rows = met.groupBy("__id", "grade").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block in text_blocks(column_bytes(batch.column(1))):
                first, index, value = features(block, buckets)
                cut = [slice(a, b) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(block)), pa.array([index[c].tobytes() for c in cut], pa.binary()), pa.array([value[c].tobytes() for c in cut], pa.binary()), batch.column(2).slice(at, len(block))], names=["grade", "index", "value", "place"])

    # at most max_rows rows, as the sample has; in one order, so that sums are the same in any partitioning
    got = rows.select(F.col("grade").cast("int"), "text", F.xxhash64("__id")).mapInArrow(run, "grade int, index binary, value binary, place long").toArrow().sort_by("place")
    index, value = ([np.frombuffer(x, dtype=d) for x in got.column(c).to_pylist()] for c, d in (("index", "<i4"), ("value", "<f4")))
    first = np.concatenate(([0], np.cumsum([len(x) for x in index]))).astype(np.int64)
    whole = lambda parts, d: np.concatenate(parts) if parts else np.zeros(0, dtype=d)
    return fit(first, whole(index, np.int32), whole(value, np.float32), got.column("grade").to_numpy(), buckets)


def score_column(spark: SparkSession, model: OrdinalModel, text: Column) -> Column:
    """Struct (expected grade, probability of each grade) of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("expected double, probability array<double>")
    def run(texts: pd.Series) -> pd.DataFrame:
        m, rows = shared.value, []
        for _, block in text_blocks(texts):
            rows.append(m.probabilities(m.scores(block)))
        p = np.concatenate(rows) if rows else np.zeros((0, len(m.grades)))
        return pd.DataFrame({"expected": p @ m.grades, "probability": list(p)})

    return run(text)


def assess(docs: DataFrame, model: OrdinalModel, at_least: int, accept: float = 0.6, text_col: str = "text") -> DataFrame:
    """``docs`` with ``expected_grade``, ``tail`` = P(grade >= at_least) and ``accepted`` (tail >= accept)."""
    some = docs.drop("expected_grade", "tail", "accepted") if text_col not in ("expected_grade", "tail", "accepted") else docs
    if not len(model.grades):
        return some.withColumns({"expected_grade": F.lit(None).cast("double"), "tail": F.lit(1.0), "accepted": F.lit(True)})
    tails = [i for i, g in enumerate(model.grades) if g >= at_least]
    scored = some.withColumn("__rated", score_column(docs.sparkSession, model, F.col(text_col)))
    tail = sum((F.col("__rated.probability")[i] for i in tails), F.lit(0.0))
    return scored.withColumns({"expected_grade": F.col("__rated.expected"), "tail": F.least(tail, F.lit(1.0)), "accepted": tail >= accept}).drop("__rated")


def graded(labels: DataFrame) -> DataFrame:
    """Grades of the label table: 0 toxic, 1 poor, 2 good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected grade and probability of being good."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, graded(table(spark, sf_dir, "labels")))
    return assess(docs.select("doc_id", "text"), model, at_least=2).select("doc_id", "expected_grade", "tail", "accepted")
