"""Exact top-k by block-at-a-time pruning.

Terms are vector components, scores integer inner products.  Documents are
range-sorted by the signs of a few fixed projections, so near vectors lie
together, and cut into ranges of ``BLOCK_ROWS``: each block has its forward
index (ids and components) and every term's largest and smallest value.  For a
query, the sum over its terms of the larger product bounds any score in the
block.

1. While blocks are made, each query takes the k-th best score among the
   documents of its own partition: a first threshold, whatever its quality.
2. Groups of queries meet groups of block summaries; blocks whose bound is below
   the threshold of every query of the group are left out.
3. Groups of queries meet slices of the blocks that are left: each query takes
   its blocks from the highest bound down and stops when a bound falls below
   its k-th score.  Each meeting gives k rows a query at most, and a window picks the
   best k of those.

Queries against all rows is what is asked for, so rows x query groups is the
work's bound; only summaries and blocks within reach travel.

Vectors null or with a null or non-finite component take no part, nor do rows
without id.  Shorter vectors end in zeros, an empty one is all zeros.  Sums are
exact integers; a component or a score beyond 64 bits, which no long can hold,
counts as the nearest one that does.  Ties go to the smaller id.  Rows that share a query's id are its own
and are left out; repeated rows of other ids are found each.  Fewer than k
candidates: all.  Empty table: empty result.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table, written

BLOCK_ROWS = 256
QUERY_GROUP = 1024
SUMMARIES = 2048
SLICE_BLOCKS = 16
_SIGNS = 12
#: below every score; scores and components lie within plus and minus ``_MOST``
_NONE, _MOST = -(2**63), 2**63 - 1
_HITS = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): integer vectors of the rows that take part."""
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    sound = F.col("x").isNotNull() & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull()).where(F.coalesce(sound, F.lit(False)))
    return rows.select("vec_id", F.transform("x", lambda e: F.greatest(F.floor(F.lit(float(scale)) * e), F.lit(-_MOST))).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims), dtype=np.int64)
    flat = column.flatten().to_numpy()
    out[np.repeat(np.arange(len(column)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exactly: in floating point where that is exact, in
    whole numbers of any size where 64 bits may not do (then cut to ``_MOST``)."""
    top = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] if a.size and b.size else 0
    if top < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if top <= _MOST:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -_MOST, _MOST).astype(np.int64)


def _bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of queries (rows) in blocks (columns)."""
    return _products(np.concatenate((np.maximum(q, 0), np.minimum(q, 0)), axis=1), np.concatenate((hi, lo), axis=1))


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, ~score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def _bytes(rows: np.ndarray, width: int) -> bytes:
    return rows.astype(f"<i{width}").tobytes()


def _ints(column, dims: int, width: int) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype=f"<i{width}").astype(np.int64).reshape(-1, dims) for b in column.to_pylist()]


def _longs(column) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype="<i8") for b in column.to_pylist()]


_BLOCKS = "block long, lo binary, hi binary, ids binary, rows binary, query_rows binary, thresholds binary"


def make_blocks(rows: DataFrame, dims: int, width: int, k: int, is_query: str) -> DataFrame:
    """Blocks of ``rows`` (vec_id, v, ``is_query``), and with each block its queries
    and their first thresholds."""
    signs = np.random.default_rng(5).standard_normal((dims, _SIGNS))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = _matrix(b.column(1), dims) @ signs > 0
            yield pa.RecordBatch.from_arrays([pa.array(bits @ (1 << np.arange(_SIGNS)[::-1])), *b.columns], names=["place", "vec_id", "v", "is_query"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:  # a batch is a bounded run of the sorted partition
            ids, x, asks = b.column(0).to_numpy(), _matrix(b.column(1), dims), b.column(2).to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            threshold = np.full(len(ids), _NONE)
            for at in np.array_split(np.flatnonzero(asks), max(1, int(asks.sum()) // 64)):
                score = np.where(ids[at, None] == ids[None, :], _NONE, _products(x[at], x))
                if score.shape[1] >= k:
                    threshold[at] = np.partition(score, -k, axis=1)[:, -k]
            for lo in range(0, len(ids), BLOCK_ROWS):
                c = slice(lo, lo + BLOCK_ROWS)
                asked = np.flatnonzero(asks[c])
                yield pa.RecordBatch.from_pydict({"block": pa.array([number]), "lo": pa.array([_bytes(x[c].min(0), width)]), "hi": pa.array([_bytes(x[c].max(0), width)]), "ids": pa.array([ids[c].astype("<i8").tobytes()]), "rows": pa.array([_bytes(x[c], width)]), "query_rows": pa.array([asked.astype("<i4").tobytes()]), "thresholds": pa.array([threshold[c][asked].astype("<i8").tobytes()])})
                number += 1

    placed = rows.select("vec_id", "v", F.expr(is_query).alias("is_query")).mapInArrow(place, "place long, vec_id long, v array<long>, is_query boolean")
    return placed.repartitionByRange("place", "vec_id").sortWithinPartitions("place", "vec_id").select("vec_id", "v", "is_query").mapInArrow(build, _BLOCKS)


def query_groups(blocks: DataFrame, dims: int, width: int, folder: str) -> DataFrame:
    """(g, ids, rows, thresholds): the queries of neighbouring blocks, ``QUERY_GROUP`` at most in a row."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, least, n = [], [], [], 0
        number = TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"g": pa.array([number]), "ids": pa.array([np.concatenate(ids).tobytes()]), "rows": pa.array([_bytes(np.concatenate(rows), width)]), "thresholds": pa.array([np.concatenate(least).tobytes()])})

        for b in batches:
            for own, x, at, t in zip(_longs(b.column(0)), _ints(b.column(1), dims, width), (np.frombuffer(q, dtype="<i4") for q in b.column(2).to_pylist()), _longs(b.column(3)), strict=True):
                if n + len(at) > QUERY_GROUP:
                    yield out()
                    ids, rows, least, n, number = [], [], [], 0, number + 1
                ids.append(own[at])
                rows.append(x[at])
                least.append(t)
                n += len(at)
        if n:
            yield out()

    asked = blocks.where(F.length("query_rows") > 0)
    few = asked.select("block", "ids", "rows", "query_rows", "thresholds")
    n = few.agg(F.sum(F.length("query_rows") / 4)).first()[0] or 0
    spread = few.repartitionByRange(max(1, math.ceil(n / QUERY_GROUP)), "block").sortWithinPartitions("block")
    return written(spread.select("ids", "rows", "query_rows", "thresholds").mapInArrow(gather, "g long, ids binary, rows binary, thresholds binary"), f"{folder}/queries")


def _meet(blocks: DataFrame, queries: DataFrame, slices: int):
    """Blocks (with ``g``, ``slice``) and query groups, dealt to every slice, grouped together."""
    to_all = queries.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return blocks.groupBy("g", "slice").cogroup(to_all.groupBy("g", "slice"))


def search(vectors: DataFrame, is_query: str, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of which ``is_query`` (SQL
    over vec_id) holds, the k rows of highest score."""
    spark = vectors.sparkSession
    folder = scratch(spark, "topk")
    rows = quantised(vectors, scale, id_col, vector_col)
    dims, top = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    dims, width = dims or 1, 4 if (top or 0) < 2**31 else 8
    blocks = written(make_blocks(rows, dims, width, k, is_query), f"{folder}/blocks")
    queries = query_groups(blocks, dims, width, folder)
    groups = queries.select(F.col("g").alias("g"))

    def reach(left: pa.Table, right: pa.Table) -> pa.Table:
        keep = np.zeros(left.num_rows, dtype=bool)
        lo, hi = (np.concatenate(_ints(left.column(c), dims, width)) if left.num_rows else np.zeros((0, dims), dtype=np.int64) for c in ("lo", "hi"))
        for q, t in zip(_ints(right.column("rows"), dims, width), _longs(right.column("thresholds")), strict=True):
            keep |= (_bounds(q, lo, hi) >= t[:, None]).any(axis=0)
        return left.select(["g", "block"]).filter(pa.array(keep))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        ids, x = _longs(left.column("ids")), _ints(left.column("rows"), dims, width)
        lo, hi = (np.concatenate(_ints(left.column(c), dims, width)) if left.num_rows else np.zeros((0, dims), dtype=np.int64) for c in ("lo", "hi"))
        for own, q, t in zip(_longs(right.column("ids")), _ints(right.column("rows"), dims, width), _longs(right.column("thresholds")), strict=True):
            bound = _bounds(q, lo, hi)
            order = np.argsort(-bound, axis=1, kind="stable")
            best, found, kth = np.full((len(q), k), _NONE), np.full((len(q), k), _MOST), t.copy()
            active = np.arange(len(q))
            for turn in range(len(ids)):
                which = order[active, turn]
                on = bound[active, which] >= kth[active]
                active, which = active[on], which[on]
                for b in np.unique(which):
                    a = active[which == b]
                    s = np.where(own[a, None] == ids[b][None, :], _NONE, _products(q[a], x[b]))
                    best[a], found[a] = _best(np.concatenate((best[a], s), axis=1), np.concatenate((found[a], np.broadcast_to(ids[b], s.shape)), axis=1), k)
                    kth[a] = np.maximum(kth[a], best[a, -1])
            hit = (best > _NONE) & (best >= t[:, None])
            out.append(pa.table([np.repeat(own, k).reshape(-1, k)[hit], found[hit], best[hit]], names=["query_id", "vec_id", "score"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64())] * 3, names=["query_id", "vec_id", "score"])

    n_blocks = blocks.count()
    of = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    n = max(1, math.ceil(n_blocks / SUMMARIES))
    sums = blocks.select("block", "lo", "hi").withColumn("slice", of(n))
    # every query group meets every slice of summaries: the stated queries against all rows, in blocks
    every = groups.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(sums, "slice")
    near = written(_meet(every, queries, n).applyInArrow(reach, "g long, block long"), f"{folder}/near")
    m = max(1, math.ceil(n_blocks / SLICE_BLOCKS))
    full = near.join(blocks.select("block", "lo", "hi", "ids", "rows"), "block").withColumn("slice", of(m))
    hits = _meet(full, queries, m).applyInArrow(score, _HITS)
    return _ranked(hits, k)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window as W

    place: Column = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")
