"""Packing of documents in the order of a space-filling curve.

The words of a document are hashed to a bag of ``BINS`` counts, which a fixed
random matrix projects to ``DIMS`` numbers; their cell's place on the Hilbert
curve is the document's key.  Documents are range-sorted by that key over the
cluster, so neighbours in a sequence are alike, and each sorted partition packs
its own: ids are laid end to end and cut every ``width`` ids.  What is left at a
partition's end is cut into sequences of powers of two, which need no padding.

The ranges' bounds come from the keys of a sample of ``SAMPLE`` rows a range (at
most ``MOST_SAMPLED`` in all, as in Spark's own range sort), so each text is
projected once, on its way into the one shuffle of the texts; the sample only
sets how even the ranges are.  The order goes on by id and hash of text, so many
equal keys are split over partitions, whose number follows the bytes of text.
A task holds one batch of texts and the pieces of one open sequence; the driver
one bound a range.

Null or empty text: its end id only, at the curve's start.  Repeated rows are
packed each.  Null doc_id: kept, as null.  Empty table: no pieces.  Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import parts_for, table, text_or_empty
from .textops import U64, Words, column_bytes, text_blocks, word_hashes

WIDTH = 2048
BINS = 4096
DIMS = 3
BITS = 10
#: bytes of text of one range, rows sampled for each, and in all
RANGE_BYTES, SAMPLE, MOST_SAMPLED = 1 << 29, 100, 1_000_000
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def projection(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BINS, DIMS)).astype(np.float32)


def project(texts: list[bytes], matrix: np.ndarray) -> np.ndarray:
    """Mean of the matrix rows of each text's hashed words; no words: zeros."""
    words = Words(texts, lower=True)
    out = np.zeros((len(texts), matrix.shape[1]))
    n = np.diff(words.first)
    some = np.flatnonzero(n)
    if len(some):
        rows = matrix[(word_hashes(words) % U64(len(matrix))).astype(np.int64)]
        out[some] = np.add.reduceat(rows, words.first[some], axis=0, dtype=np.float64) / n[some, None]
    return out


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer cells (rows) of ``bits`` bits a dimension."""
    x = cells.astype(np.int64).T.copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo the rotations from the highest bit down
        p = q - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            t = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def places(texts, matrix: np.ndarray, spread: float = 0.5) -> np.ndarray:
    """Place on the curve of each text; ``spread`` is the half width of the cube."""
    out = []
    for _, block in text_blocks(texts):
        cells = (project(block, matrix) / spread + 1) / 2 * (1 << BITS)
        out.append(hilbert(np.clip(cells, 0, (1 << BITS) - 1), BITS))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def ranges(bounds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How many of ``bounds`` (columns place, id, tie; ascending) each row is not smaller than."""
    both = np.concatenate((bounds, rows))
    is_row = np.arange(len(both)) >= len(bounds)
    order = np.lexsort((is_row, both[:, 2], both[:, 1], both[:, 0]))
    out = np.empty(len(both), dtype=np.int64)
    out[order] = np.cumsum(~is_row[order])
    return out[len(bounds) :]


def placed(docs: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, text) range-sorted along the curve, by id and hash of text where places are equal."""
    spark = docs.sparkSession
    own = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("tie"))
    size, n = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    parts = parts_for(spark, size, RANGE_BYTES)
    share = min(MOST_SAMPLED, SAMPLE * parts) / max(1, n)

    def keyed(batches: Iterator[pa.RecordBatch], bounds: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        matrix = projection(seed)
        for b in batches:
            place = places(column_bytes(b.column(1)), matrix)
            key = np.stack((place, b.column(2).to_numpy(), b.column(3).to_numpy()), axis=1)
            if bounds is None:
                yield pa.RecordBatch.from_arrays([pa.array(key[:, i]) for i in range(3)], names=["place", "id", "tie"])
            else:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place), pa.array(ranges(bounds, key).astype(np.int32))], names=[*b.schema.names, "place", "range"])

    some = own.sample(share, seed) if share < 1 else own
    got = some.mapInArrow(lambda x: keyed(x, None), "place long, id long, tie long").toArrow()
    keys = np.stack([c.to_numpy() for c in got.columns], axis=1) if got.num_rows else np.zeros((0, 3), dtype=np.int64)
    keys = keys[np.lexsort((keys[:, 2], keys[:, 1], keys[:, 0]))]
    bounds = keys[np.unique(np.arange(1, parts) * len(keys) // parts)] if len(keys) else keys
    dealt = own.mapInArrow(lambda x: keyed(x, bounds), "doc_id long, text string, id long, tie long, place long, range int").repartitionById(parts, "range")
    return dealt.sortWithinPartitions("place", "id", "tie").select("doc_id", "text")


class _Packer:
    """Lays documents end to end; gives rows of closed sequences."""

    def __init__(self, width: int, first_sequence: int):
        self._width, self._next, self._open, self._fill = width, first_sequence, [], 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n, at = len(ids) // 4, 0
        while at < n:
            k = min(n - at, self._width - self._fill)
            self._open.append((doc_id, at, k, n, self._fill, ids[4 * at : 4 * (at + k)]))
            at += k
            self._fill += k
            if self._fill == self._width:
                self._close()

    def _close(self) -> None:
        self.rows += [(d, at, k, n, self._next, o, ids) for d, at, k, n, o, ids in self._open]
        self._next, self._open, self._fill = self._next + 1, [], 0

    def finish(self) -> None:
        """The open sequence as sequences of falling powers of two."""
        left, size = self._open, self._fill
        self._open, self._fill = [], 0
        room = 0
        for d, at, k, n, _, ids in left:
            while k:
                room = room or 1 << (size.bit_length() - 1)
                take = min(k, room - self._fill)
                self._open.append((d, at, take, n, self._fill, ids[: 4 * take]))
                ids, at, k = ids[4 * take :], at + take, k - take
                self._fill += take
                if self._fill == room:
                    size, room = size - room, 0
                    self._close()


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: a document's ids from ``start``, laid at ``offset`` of a sequence.

    Each id lies in one piece; sequences have ``width`` ids or a smaller power
    of two.  ``sequence_id`` ascends along the curve; numbers may be left out."""
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, packer = tokens.word_table(tokenizer), _Packer(width, TaskContext.get().partitionId() << 40)

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [[]] * 7
            packer.rows = []
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for d, ids in zip(part.column(0).to_pylist(), table_.ids(part.column(1).to_pylist()), strict=True):
                    packer.add(d, ids + tail)
                yield rows()
        packer.finish()
        yield rows()

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return placed(own).mapInArrow(run, SCHEMA)


def op5_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
