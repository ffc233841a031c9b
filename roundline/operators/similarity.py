"""Similarity, clustering and scoring of glyph vectors.

Vectors are arrays of 0 and 1.  Similar pairs come from all pairs of a class, as dense
vectors share places with nearly all others and no filter on places keeps them apart:
blocks of packed vectors meet, and a product of two matrices counts the common ones of
all their pairs.  A task holds two blocks and hands on the similar pairs only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import files
from . import folds

#: prototypes that one broadcast may hold
MOST_PROTOTYPES = 10_000
#: vectors of a block, and rows of a matrix of counts held at once
BLOCK, ROWS = 4096, 512


def binary(vector: Column, threshold: float = 0.0) -> Column:
    return F.transform(vector, lambda x: (x > threshold).cast("int"))


def iou(a: Column, b: Column) -> Column:
    """Common ones over ones in either; 0 if there are none."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0), lambda s, x: s + x)
    either = F.aggregate(F.zip_with(a, b, lambda x, y: F.greatest(x, y)), F.lit(0), lambda s, x: s + x)
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def shifted_iou(a: Column, b: Column) -> Column:
    """Best of the similarity as it is and with ``b`` shifted by one place either way."""
    n = F.size(b)
    left = F.concat(F.slice(b, 2, n - 1), F.array(F.lit(0)))
    right = F.concat(F.array(F.lit(0)), F.slice(b, 1, n - 1))
    return F.greatest(iou(a, b), iou(a, left), iou(a, right))


def shifted(bits: Column, by: int) -> Column:
    """Bits moved ``by`` places to the right (left, if negative), zeros moving in."""
    n, zeros = F.size(bits), F.array_repeat(F.lit(0), abs(by))
    if not by:
        return bits
    return F.concat(zeros, F.slice(bits, 1, n - by)) if by > 0 else F.concat(F.slice(bits, 1 - by, n + by), zeros)


def _blocks(vectors: DataFrame, by: str, key: str) -> DataFrame:
    """(by, width, block, blocks, ids, bits): vectors of a class and length in blocks of about
    ``BLOCK``, packed.  Vectors that are null or hold null are like no other."""
    sound = vectors.where(F.col(by).isNotNull() & F.col("bits").isNotNull() & F.forall("bits", lambda x: x.isNotNull()))
    sound = sound.select(by, F.size("bits").alias("width"), F.col(key).cast("long").alias("id"), F.col("bits").cast("array<tinyint>").alias("bits"))
    sizes = sound.groupBy(by, "width").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # a row a class and length
    rows = sound.join(F.broadcast(sizes), [by, "width"]).withColumn("block", F.pmod(F.xxhash64("id", "bits"), "blocks").cast("int"))
    kind = rows.schema[by].dataType.simpleString()

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        bits = np.packbits(np.array(part.bits.to_list(), dtype=np.uint8).reshape(len(part), -1), axis=1)
        first = part[[by, "width", "block", "blocks"]].iloc[:1]
        return first.assign(ids=[part.id.to_numpy(dtype=np.int64).tobytes()], bits=[bits.tobytes()])

    return rows.groupBy(by, "width", "block").applyInPandas(pack, f"{by} {kind}, width int, block int, blocks int, ids binary, bits binary")


def _moved(x: np.ndarray, by: int) -> np.ndarray:
    """Rows of bits moved ``by`` places to the right (left, if negative), zeros moving in."""
    out = np.zeros_like(x)
    width = x.shape[1]
    if abs(by) < width:
        out[:, max(0, by) : width + min(0, by)] = x[:, max(0, -by) : width - max(0, by)]
    return out


def _best(a: np.ndarray, b: np.ndarray, shifts: tuple[int, ...], of_first: bool) -> np.ndarray:
    """Similarities of all rows of ``a`` and ``b``, the best over shifts of one of them."""
    best = np.zeros((len(a), len(b)))
    for s in shifts:
        x, y = (_moved(a, s), b) if of_first else (a, _moved(b, s))
        both = (x @ y.T).astype(np.float64)
        either = x.sum(axis=1, dtype=np.float64)[:, None] + y.sum(axis=1, dtype=np.float64)[None, :] - both
        np.maximum(best, np.divide(both, either, out=np.zeros_like(both), where=either > 0), out=best)
    return best


def similar_pairs(vectors: DataFrame, least: float, shifts: tuple[int, ...] = (0,), by: str = "label", key: str = "vec_id") -> DataFrame:
    """(by, a, b, iou): pairs a < b of one class whose similarity, the best over shifts
    of b, is ``least`` (over 0) or more."""
    spark = vectors.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = files.written(_blocks(vectors, by, key), "blocks")
    left = blocks.select(by, "width", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), F.col("ids").alias("ids_i"), F.col("bits").alias("bits_i"))
    right = blocks.select(by, "width", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), F.col("ids").alias("ids_j"), F.col("bits").alias("bits_j"))
    keys = [by, "width", "i", "j"]
    met = left.repartition(n, *keys).hint("merge").join(right.repartition(n, *keys), keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                label, width, i, j, *parts = (c[r] for c in batch.columns)
                width, one_block = width.as_py(), i.as_py() == j.as_py()
                ids = [np.frombuffer(p.as_py(), dtype=np.int64) for p in parts[::2]]
                a, b = (np.unpackbits(np.frombuffer(p.as_py(), dtype=np.uint8).reshape(len(x), -1), axis=1)[:, :width].astype(np.float32) for p, x in zip(parts[1::2], ids, strict=True))
                for at in range(0, len(a), ROWS):
                    own = ids[0][at : at + ROWS, None]
                    first = own < ids[1][None, :]  # else ``a`` is the later one, which moves
                    like = _best(a[at : at + ROWS], b, shifts, False)
                    if shifts != (0,) and not one_block:
                        like = np.where(first, like, _best(a[at : at + ROWS], b, shifts, True))
                    # each pair of one block is there in both orders
                    x, y = np.nonzero((like >= least) & (first if one_block else own != ids[1][None, :]))
                    p, q = own[x, 0], ids[1][y]
                    yield pa.RecordBatch.from_arrays([pa.repeat(label, len(x)), pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(like[x, y])], names=[by, "a", "b", "iou"])

    kind = blocks.schema[by].dataType.simpleString()
    return met.select(*keys, "ids_i", "bits_i", "ids_j", "bits_j").mapInArrow(run, f"{by} {kind}, a long, b long, iou double").withColumn("iou", F.round("iou", 9))


def medoids(members: DataFrame, most: int = 60, by: str = "label", key: str = "vec_id") -> DataFrame:
    """Member of each class with the largest mean similarity to the others, among
    its first ``most`` members (the operator's own bound on pairs)."""
    few = members.withColumn("__r", F.row_number().over(W.partitionBy(by).orderBy(key))).where(F.col("__r") <= most)
    a = few.select(by, F.col(key).alias("a"), F.col("bits").alias("x"))
    b = few.select(by, F.col(key).alias("b"), F.col("bits").alias("y"))
    mean = a.join(b, by).where("a <> b").groupBy(by, "a").agg(F.round(F.avg(iou(F.col("x"), F.col("y"))), 9).alias("mean"))
    return mean.groupBy(by).agg(F.min(F.struct((-F.col("mean")).alias("m"), "a")).alias("k")).select(by, F.col("k.a").alias("medoid"), (-F.col("k.m")).alias("mean"))


def claims(vectors: DataFrame, prototypes: DataFrame, least: float = 0.80, margin: float = 0.15) -> DataFrame:
    """Class of the most similar prototype, if it is similar enough and clear of the
    next class: (vec_id, best, score, claimed).

    Prototypes are few for each class by their making; more than MOST_PROTOTYPES raise
    ValueError, as every task holds them."""
    few = prototypes.select("label", "bits").limit(MOST_PROTOTYPES + 1).collect()
    if len(few) > MOST_PROTOTYPES:
        raise ValueError(f"more than {MOST_PROTOTYPES} prototypes")
    names = sorted({r.label for r in few})
    which = np.array([names.index(r.label) for r in few], dtype=np.int64)
    known = np.array([r.bits for r in few], dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, bits = b.column(0), np.array(b.column(1).to_pylist(), dtype=np.float64).reshape(b.num_rows, -1)
            if not b.num_rows or not names:
                continue
            both = bits @ known.T
            either = bits.sum(axis=1)[:, None] + known.sum(axis=1)[None, :] - both
            scores = np.full((len(bits), len(names)), -1.0)
            np.maximum.at(scores.T, which, np.round(np.divide(both, either, out=np.zeros_like(both), where=either > 0), 9).T)
            order = np.argsort(-scores, axis=1, kind="stable")
            best = order[:, 0]
            top = scores[np.arange(len(bits)), best]
            second = scores[np.arange(len(bits)), order[:, 1]] if len(names) > 1 else top - 1
            sure = (top >= least) & (top - second >= margin)
            label = [names[i] for i in best]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(label, pa.int32()), pa.array(top), pa.array([x if ok else None for x, ok in zip(label, sure, strict=True)], pa.int32())], names=["vec_id", "best", "score", "claimed"])

    return vectors.select("vec_id", "bits").mapInArrow(run, "vec_id long, best int, score double, claimed int")


def leader_clusters(vectors: DataFrame, folder: str, least: float = 0.75, by: str = "label", key: str = "vec_id") -> DataFrame:
    """Leader clustering of each class: vectors in order of id join the most similar
    earlier leader that is similar enough (the first of equals), else lead.

    A vector leads if no earlier leader is similar, so leaders are found in rounds
    over the similar pairs: those without an earlier similar vector that is still
    open lead, and what is similar to them follows.  Each round is a written table in
    ``folder``; the result is that of one pass in order."""
    spark = vectors.sparkSession
    write = lambda df, name: (df.write.parquet(f"{folder}/{name}"), spark.read.schema(df.schema).parquet(f"{folder}/{name}"))[1]
    pairs = write(similar_pairs(vectors, least, by=by, key=key), "pairs")
    open_ = vectors.select(by, F.col(key).alias("v"))
    leaders, turn = None, 0
    while True:
        turn += 1
        earlier = pairs.join(open_.select(F.col("v").alias("a")), "a", "left_semi").select(F.col("b").alias("v"))
        lead = write(open_.join(earlier, "v", "left_anti").select(by, "v"), f"leaders-{turn}")
        leaders = lead if leaders is None else leaders.union(lead)
        follow = pairs.join(lead.select(F.col("v").alias("a")), "a", "left_semi").select(F.col("b").alias("v"))
        open_ = write(open_.join(lead.select("v"), "v", "left_anti").join(follow, "v", "left_anti").select(by, "v"), f"open-{turn}")
        if not open_.limit(1).count():
            break
    own = leaders.select(F.col("v").alias(key), F.col("v").alias("leader"))
    led = pairs.join(leaders.select(F.col("v").alias("a")), "a", "left_semi").join(leaders.select(F.col("v").alias("b")), "b", "left_anti")
    best = led.groupBy(F.col("b").alias(key)).agg(F.min_by("a", F.struct((-F.col("iou")).alias("i"), "a")).alias("leader"))
    return own.unionByName(best)


def without_near_repeats(vectors: DataFrame, least: float = 0.92, by: str = "slot", key: str = "vec_id") -> DataFrame:
    """Drops vectors that are nearly the last one kept in their slot, in order; a task
    carries one vector a slot."""

    def step(last, row):
        at, bits = row[0], np.asarray(row[1])
        if last is not None and np.minimum(bits, last).sum() / max(1, np.maximum(bits, last).sum()) >= least:
            return last, []
        return bits, [(at,)]

    return folds.folded(vectors.select(by, key, "bits"), by, [key], step, f"{by} string, {key} long")
