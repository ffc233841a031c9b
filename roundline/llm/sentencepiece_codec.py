"""SentencePiece encoding and decoding with a distinct-chunk table.

Pieces of the model never cross a white-space marker, so a text is cut into marked words.

1. Tasks count their own distinct words and one shuffle adds them up.
2. Words that several tasks have, the ``TABLE_CHUNKS`` most frequent at most, are segmented
   once each, spread over the cluster, and make the table, which is broadcast (a bounded
   number of words of ``LONG_CHUNK`` characters at most).
3. A second pass joins the ids back by position.  A word that is not in the table, mostly one
   that a single task has, is segmented there, and remembered as far as ``OWN_CHUNKS`` allow.

Words of any number and length give the same ids; the table's size is a matter of time.

Null or empty text: only the end id, decoded text empty.  Repeated rows: one
result row each.  Null ids pass through.  Empty table: empty result.  Other
columns of the input are not read, so clashing names cannot matter.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import partitions, table, tidy

#: words of the broadcast table, words that a worker adds of its own, and distinct words that a task counts at once
TABLE_CHUNKS, OWN_CHUNKS, _COUNTED = 200_000, 100_000, 200_000

SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def chunk_table(docs: DataFrame, model: str, text_col: str = "text", most: int = TABLE_CHUNKS) -> pa.Table:
    """(chunk, ids) of the most frequent marked words that several tasks have, each segmented once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, held = tokens.piece_table(model).cut, Counter()

        def counts() -> pa.RecordBatch:
            some = [c for c in held if len(c) <= tokens.LONG_CHUNK]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([held[c] for c in some], pa.int64())], names=["chunk", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(0).slice(at, 256).to_pylist():
                    held.update(cut(text))
                if len(held) > _COUNTED:
                    yield counts()
                    held.clear()
        yield counts()

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokens.piece_table(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(known.encoded(b.column(0).to_pylist()), pa.binary())], names=["chunk", "ids"])

    sums = docs.select(text_col).mapInArrow(tidy(count), "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"), F.count("*").alias("parts"))
    top = sums.where("parts > 1").orderBy(F.desc("n"), "chunk").limit(most).select("chunk")
    return top.repartition(partitions(docs.sparkSession), "chunk").mapInArrow(tidy(segment), "chunk string, ids binary").toArrow()


#: the worker's table for the last run: (name of the run, table)
_OWN: dict[str, tuple[str, tokens.ChunkTable]] = {}


def _table_of(model: str, run: str, shared: Broadcast) -> tokens.ChunkTable:
    if _OWN.get(model, (None,))[0] != run:
        _OWN.pop(model, None)
        known = dict(zip(shared.value.column(0).to_pylist(), shared.value.column(1).to_pylist(), strict=True))
        _OWN[model] = (run, tokens.piece_table(model).with_known(known, OWN_CHUNKS))
    return _OWN[model][1]


def _coded(batches: Iterator[pa.RecordBatch], model: str, end_id: int, run: str, shared: Broadcast):
    table_, sp = _table_of(model, run, shared), tokens.piece_processor(model)
    tail = np.array([end_id], dtype="<u4").tobytes()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            ids = [i + tail for i in table_.ids(part.column(1).to_pylist())]
            lists = [np.frombuffer(i, dtype="<u4").tolist() for i in ids]
            yield part.column(0), ids, lists, [sp.decode(i) for i in lists]


def encode_decode(docs: DataFrame, model: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ids (little-endian unsigned 32-bit, with the end id) and
    the text that the library decodes from them."""
    shared, name = docs.sparkSession.sparkContext.broadcast(chunk_table(docs, model, text_col)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, lists, texts in _coded(batches, model, end_id, name, shared):
            yield pa.RecordBatch.from_arrays([keys.cast(pa.int64()), pa.array(map(len, lists), pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA)


def digests(coded: DataFrame) -> DataFrame:
    """The contract's digest columns of ``encode_decode``'s rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [hashlib.sha256(" ".join(map(str, np.frombuffer(i, dtype="<u4").tolist())).encode()).hexdigest() for i in b.column("ids").to_pylist()]
            texts = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in b.column("decoded").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), pa.array(ids), pa.array(texts)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return coded.mapInArrow(run, DIGEST_SCHEMA)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))
