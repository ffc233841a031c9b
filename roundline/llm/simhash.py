"""SimHash near-duplicates with pivot distance tables.

Fingerprints: every bit is the majority of that bit over the XXH64 of all word
shingles.  Two fingerprints link at ``max_bits`` differing bits or fewer.

Pivot tables: the Hamming distances of each distinct fingerprint to ``PIVOTS``
reference fingerprints are computed once, segment by segment, and written with
it; a distance is the sum of its ``max_bits + 2`` segment distances.  Two linked
fingerprints agree on two segments at least, so they have all coordinates of two
segments in common: each pair of segments makes a table of blocks of equal
coordinates, and no link is lost.  (A filter on whole distances alone would meet
all pairs.)  Within a block rows are walked in order of the first distance, so a
row stops at the first partner too far away; by the triangle inequality a pair
whose coordinates differ by more than ``max_bits`` anywhere is discarded, and
only survivors are verified bit by bit.

Blocks beyond ``BLOCK_ROWS`` are blocked again by parts of their other bits, one
of which a linked pair has in common too; what is still larger is cut into chunks
and dealt out as pairs of chunks.  A task hands on a spanning forest of the links
that it finds, never all pairs; ``graph.components`` joins the forests.

Null or wordless text: fingerprint zero, linked like any other.  Null id: has a
component, but is never its smallest id (null, if no member has one).  Repeated
rows: one row each.  Empty table: empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined_to_one, scratch, table, written
from .graph import components
from .textops import U64, Words, column_bytes, mix, text_blocks, xxh64

SEED = 42
SHINGLE = 3
MAX_BITS = 3
PIVOTS = 16
BLOCK_ROWS = 2048
_BUFFER_ROWS = 60_000

#: a byte's bits, lowest first, as eight byte-wide counters
_COUNTERS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8").ravel()


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte ranges of all shingles; ``first[i]:first[i+1]`` are text i's."""
    n = np.diff(words.first)
    made = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    first = np.concatenate(([0], np.cumsum(made)))
    lead = np.repeat(words.first[:-1] - first[:-1], made) + np.arange(first[-1])
    last = lead + np.repeat(np.minimum(n, size) - 1, made)
    return words.start[lead], words.end[last], first


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each range of hashes the bits that are set in over half of them."""
    n = np.diff(first)
    out = np.zeros(len(n), dtype=U64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    # counters hold 255 at most: ranges are cut into runs of that length
    runs = (n[some] + 254) // 255
    run_first = np.concatenate(([0], np.cumsum(runs)))
    cut = np.repeat(first[:-1][some], runs) + 255 * (np.arange(run_first[-1]) - np.repeat(run_first[:-1], runs))
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for j in range(8):
        sums = np.add.reduceat(_COUNTERS[octets[:, j]], cut).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(sums, run_first[:-1], axis=0, dtype=np.int64)
        bits = np.packbits(2 * counts > n[some, None], axis=1, bitorder="little").ravel()
        out[some] |= bits.astype(U64) << U64(8 * j)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): signed 64-bit SimHash of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_blocks(column_bytes(batch.column(1))):
                words = Words(texts, lower=True)
                start, end, first = shingles(words, shingle)
                fp = majority(xxh64(words.buf, start, end, SEED), first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, fp long")


def references(n: int) -> np.ndarray:
    """The pivots: fixed fingerprints."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def segments(count: int) -> list[int]:
    """Masks of ``count`` segments of about equal width that make up 64 bits."""
    cut = [64 * i // count for i in range(count + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def pivot_table(fp: np.ndarray, pivots: np.ndarray, masks: list[int]) -> np.ndarray:
    """Distances (row, segment, pivot): bits of the segment in which both differ."""
    apart = fp[:, None, None] ^ pivots[None, None, :]
    return np.bitwise_count(apart & np.array(masks, dtype=U64)[None, :, None]).astype(np.uint8)


def with_pivots(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``fp`` of ``classes`` with ``table`` (its distance to each pivot, a byte each) and
    ``blocks`` (for each pair of segments one number of its coordinates there)."""
    masks = segments(max_bits + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = references(PIVOTS)
        odd = mix(np.arange(1, PIVOTS + 1, dtype=U64)) | U64(1)
        for b in batches:
            parts = pivot_table(b.column(0).to_numpy().view(U64), pivots, masks)
            sums = (parts.astype(U64) * odd).sum(axis=2, dtype=U64)  # one number of a segment's coordinates
            keys = np.stack([mix(sums[:, i] ^ mix(sums[:, j])) for i, j in combinations(range(len(masks)), 2)], axis=1) if len(parts) else np.zeros((0, 1), dtype=U64)
            table_ = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PIVOTS), len(parts), [None, pa.py_buffer(parts.sum(axis=1, dtype=np.uint8).tobytes())]).cast(pa.binary())
            at = np.arange(len(parts) + 1, dtype=np.int32) * keys.shape[1]
            yield pa.RecordBatch.from_arrays([b.column(0), table_, pa.ListArray.from_arrays(pa.array(at), pa.array(keys.view(np.int64).ravel()))], names=["fp", "table", "blocks"])

    return classes.select("fp").mapInArrow(run, "fp long, table binary, blocks array<long>")


def _forest(fp: np.ndarray, tables: np.ndarray, group: np.ndarray, chunk: np.ndarray, cross: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups as a spanning forest of fingerprints; ``tables`` are the
    distances to the pivots.  ``cross``: only rows of different chunks."""
    tables = tables.astype(np.int8)
    order = np.lexsort((tables[:, 0], group))
    fp, group, chunk, cross, tables = fp[order], group[order], chunk[order], cross[order], tables[order]
    root = np.arange(len(fp))
    active, step = np.arange(len(fp)), 0
    while len(active):
        step += 1
        active = active[active + step < len(fp)]
        other = active + step
        near = (group[other] == group[active]) & (tables[other, 0] - tables[active, 0] <= max_bits)
        active, other = active[near], other[near]
        i, j = active, other
        open_ = ~cross[i] | (chunk[i] != chunk[j])
        i, j = i[open_], j[open_]
        within = np.abs(tables[i] - tables[j]).max(axis=1, initial=0) <= max_bits
        i, j = i[within], j[within]
        same = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
        i, j = root[i[same]], root[j[same]]
        while len(i):  # hook larger roots to smaller ones, then shorten all paths
            apart = i != j
            i, j = i[apart], j[apart]
            np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
            while not np.array_equal(root, short := root[root]):
                root = short
            i, j = root[i], root[j]
    joined = np.flatnonzero(root != np.arange(len(root)))
    return fp[joined], fp[root[joined]]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _halved(blocks: DataFrame, large: DataFrame, max_bits: int) -> DataFrame:
    """Rows of large blocks in smaller ones: the bits outside the block's two segments
    are parted in ``max_bits + 1``, and a linked pair agrees on one part at least."""
    masks = segments(max_bits + 2)
    rest = []
    for i, j in combinations(range(len(masks)), 2):
        bits = [b for b in range(64) if not (masks[i] | masks[j]) >> b & 1]
        cut = [len(bits) * k // (max_bits + 1) for k in range(max_bits + 2)]
        rest.append([_signed(sum(1 << b for b in bits[x:y])) for x, y in zip(cut[:-1], cut[1:], strict=True)])
    mask = F.array(*(F.array(*(F.lit(m).cast("long") for m in own)) for own in rest))[F.col("kind")]
    parts = F.transform(mask, lambda m: F.col("fp").bitwiseAND(m))
    sub = blocks.join(large.select("kind", "part"), ["kind", "part"]).select("kind", "part", "fp", "table", F.posexplode(parts).alias("sub", "bits"))
    return sub.select((F.lit(1000) + F.col("kind") * 100 + F.col("sub")).alias("kind"), F.xxhash64("part", "bits").alias("part"), "fp", "table")


def links(classes: DataFrame, folder: str, max_bits: int = MAX_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints ``fp`` of ``classes`` that
    connect the same fingerprints as all links do.  ``folder`` takes the pivot tables."""
    tables = written(with_pivots(classes, max_bits), f"{folder}/pivots")
    blocks = tables.select("fp", "table", F.posexplode("blocks").alias("kind", "part"))
    size = lambda rows: rows.groupBy("kind", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows)
    large = written(size(blocks), f"{folder}/large")
    rows = blocks
    if large.limit(1).count():  # at most one in block_rows of the blocks' rows
        rows = blocks.join(large, ["kind", "part"], "left_anti").unionByName(_halved(blocks, large, max_bits))
        large = written(size(rows), f"{folder}/larger")
    sized = rows.join(large, ["kind", "part"], "left").withColumn("chunks", F.ceil(F.coalesce("n", F.lit(1)) / block_rows).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    met = sized.withColumn("chunk", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pairs = met.select("kind", "part", F.least("chunk", "with").alias("lo"), F.greatest("chunk", "with").alias("hi"), "chunk", "fp", "table")
    order = ["kind", "part", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
            kind, part, lo, hi, chunk, fp = (t.column(i).to_numpy() for i in range(6))
            new = np.concatenate(([True], (kind[1:] != kind[:-1]) | (part[1:] != part[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))) if len(fp) else np.zeros(0, dtype=bool)
            end = len(fp) if last else int(np.flatnonzero(new)[-1])
            table_ = np.frombuffer(b"".join(t.column(6).slice(0, end).to_pylist()), dtype=np.uint8).reshape(-1, PIVOTS)
            a, b = _forest(fp[:end].view(U64), table_, np.cumsum(new[:end]), chunk[:end], (lo != hi)[:end], max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]), t.slice(end)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= _BUFFER_ROWS:
                out, rest = done(pa.Table.from_batches(held), False)
                held = rest.to_batches()
                yield out
        if held:
            yield done(pa.Table.from_batches(held), True)[0]

    return pairs.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document (doc_id, fp, component_id): the smallest id that links reach."""
    folder = scratch(docs.sparkSession, "simhash")
    prints = written(fingerprints(docs, shingle, id_col, text_col), f"{folder}/fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), f"{folder}/classes")
    stars = components(links(classes, folder, max_bits), folder)
    rooted = classes.join(stars.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(rooted.join(smallest, "root").select("fp", "n", "component_id"), f"{folder}/named")
    return joined_to_one(prints, named, "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
