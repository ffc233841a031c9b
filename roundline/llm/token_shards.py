"""Token ids in raw shard files with a minimal perfect hash index.

``write_shards`` sorts documents by key across the cluster and writes each
sorted partition's ids, little-endian unsigned and nothing else, to one shard file:
16-bit ids where the vocabulary fits, else 32-bit.  ``write_index`` deals the keys by
hash over index files; each holds a minimal perfect hash and, slot by slot, the
stored fingerprint, shard, offset and length.  Documents that share a key are told
apart by their number in the order of the shards, and the slot of the first tells
how many there are.  ``find`` and ``read_back`` give access by key: two hashes of
key and number name the index file and the slot, the fingerprint tells absent
keys, and one ranged read gives the ids.

Tasks write under a name of their own and rename, so retried tasks leave whole
files.  The number of shards follows the bytes of text, that of index files the
documents.  A driver holds one row per shard file.

Null text: only the end id.  Null key: sorts first and is found like any other.
Documents that share a key are each found, in order of hash of text; their numbers
are dealt out from blocks, so one key may have a third of all rows.  Empty table:
no shard, empty results.  Other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import perfect_hash, tokens
from .common import FileWriter, open_fs, parts_for, scratch, table, text_or_empty, write_file, written
from .textops import U64, mix

#: keys of one index file, at most about twice as many
KEYS_PER_INDEX = 65_536
#: bytes of text of one shard
SHARD_BYTES = 1 << 30
_ENTRY = "key long, nth long, shard int, offset long, n_tokens long"
_BLOCK = 65_536


def _hashes() -> dict[str, Column]:
    return {"hash_a": F.xxhash64("key", "nth"), "hash_b": F.xxhash64(F.lit("second"), "key", "nth")}


def shard_path(folder: str, shard: int, width: int) -> str:
    return f"{folder}/shard-{shard:06d}.u{8 * width}"


def index_path(folder: str, part: int) -> str:
    return f"{folder}/index-{part:06d}.mph"


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shard files with ids of ``width`` bytes; returns the written
    entries (key, number among the key's documents, shard, offset and length in
    ids), in shard files that ascend with the key."""
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, shard, out, at = tokens.word_table(tokenizer), TaskContext.get().partitionId(), None, 0
        last, count = None, 0
        for batch in batches:
            out = out or FileWriter(shard_path(folder, shard, width))
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                keys, nth = part.column(0).to_pylist(), []
                for k in keys:
                    count = count + 1 if k == last and (nth or at) else 0
                    last = k
                    nth.append(count)
                ids = table_.ids(part.column(1).to_pylist())
                n = np.fromiter((len(i) // 4 + 1 for i in ids), dtype=np.int64, count=len(ids))
                whole = np.frombuffer(tail.join(ids) + tail, dtype="<u4")
                out.write(whole.astype(f"<u{width}").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nth, pa.int64()), pa.array(np.full(len(n), shard, dtype=np.int32)), pa.array(at + np.cumsum(n) - n), pa.array(n)], names=["key", "nth", "shard", "offset", "n_tokens"])
                at += int(n.sum())
        if out:
            out.close()

    own = docs.select(F.col(id_col).cast("long").alias("key"), text_or_empty(text_col).alias("text"))
    shards = parts_for(docs.sparkSession, own.agg(F.sum(F.octet_length("text"))).first()[0], SHARD_BYTES)
    by_key = own.withColumn("tie", F.xxhash64("text")).repartitionByRange(shards, "key", "tie").sortWithinPartitions("key", "tie")
    return _numbered(written(by_key.select("key", "text").mapInArrow(run, _ENTRY), f"{folder}/entries"))


def _numbered(entries: DataFrame) -> DataFrame:
    """Entries whose numbers go on where a key goes on in the next shard; one row a
    shard comes to the driver."""
    here = F.struct("key", "nth")
    ends = entries.groupBy("shard").agg(F.min_by(here, "offset").alias("first"), F.max_by(here, "offset").alias("last")).orderBy("shard").collect()
    before, more = None, []
    for r in ends:
        base = before[1] + 1 if before and before[0] == r["first"]["key"] else 0
        if base:
            more.append((r["shard"], r["first"]["key"], base))
        before = (r["last"]["key"], r["last"]["nth"] + (base if r["last"]["key"] == r["first"]["key"] else 0))
    if not more:
        return entries
    added = F.broadcast(entries.sparkSession.createDataFrame(more, "at int, start long, base long"))
    both = entries.join(added, (F.col("shard") == F.col("at")) & F.col("key").eqNullSafe(F.col("start")), "left")
    return both.select("key", (F.col("nth") + F.coalesce("base", F.lit(0))).alias("nth"), "shard", "offset", "n_tokens")


def index_parts(entries: DataFrame) -> int:
    return parts_for(entries.sparkSession, entries.count(), KEYS_PER_INDEX)


def write_index(entries: DataFrame, folder: str, parts: int) -> DataFrame:
    """Writes the index files; returns their written list (part, keys)."""
    slots = ("shard", "offset", "n_tokens", "copies")

    def build(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        a, b = (t.column(c).to_numpy().view(U64) for c in ("hash_a", "hash_b"))
        perfect = perfect_hash.PerfectHash.build(a, b)
        order = np.empty(len(a), dtype=np.int64)
        order[perfect.slots(a, b)] = np.arange(len(a))
        columns = {"fingerprint": mix(b)[order]} | {c: t.column(c).to_numpy()[order] for c in slots}
        write_file(index_path(folder, part), perfect_hash.dump(perfect, columns))
        return pa.table({"part": pa.array([part], pa.int32()), "n_keys": pa.array([len(a)], pa.int64())})

    first = entries.groupBy("key").agg(F.min(F.struct("shard", "offset", "n_tokens")).alias("at"), F.count(F.lit(1)).alias("copies"))
    first = first.select("key", F.lit(0).cast("long").alias("nth"), "at.*", "copies")
    keyed = first.unionByName(entries.where("nth > 0").withColumn("copies", F.lit(0).cast("long"))).withColumns(_hashes())
    rows = keyed.select("hash_a", "hash_b", *slots, F.pmod("hash_a", F.lit(parts)).cast("int").alias("part"))
    return written(rows.groupBy("part").applyInArrow(build, "part int, n_keys long"), f"{folder}/parts")


def _looked_up(numbered: DataFrame, folder: str, parts: int) -> DataFrame:
    """Slots of the documents (key, nth) that the index holds."""
    names = ["key", "nth", "shard", "offset", "n_tokens", "copies"]

    def look(t: pa.Table) -> pa.Table:
        fs, at = open_fs(index_path(folder, t.column("part")[0].as_py()))
        if fs.get_file_info(at).type == 0:
            return pa.table([t.column("key").slice(0, 0), t.column("nth").slice(0, 0), pa.array([], pa.int32()), *[pa.array([], pa.int64())] * 3], names=names)
        with fs.open_input_stream(at) as f:
            perfect, columns = perfect_hash.load(f.read())
        a, b = (t.column(c).to_numpy().view(U64) for c in ("hash_a", "hash_b"))
        slot = perfect.slots(a, b)
        held = (slot >= 0) & (columns["fingerprint"][slot] == mix(b))
        return pa.table([*(t.column(c).filter(pa.array(held)) for c in names[:2]), *(pa.array(columns[c][slot[held]]) for c in names[2:])], names=names)

    keyed = numbered.withColumns(_hashes())
    return keyed.withColumn("part", F.pmod("hash_a", F.lit(parts)).cast("int")).groupBy("part").applyInArrow(look, f"{_ENTRY}, copies long")


def find(keys: DataFrame, folder: str, parts: int, key_col: str = "key") -> DataFrame:
    """(key, nth, shard, offset, n_tokens) of all documents of each key, from distinct
    ``keys``; keys that the index does not hold have no row (but for one chance in
    2**64)."""
    numbered = keys.select(F.col(key_col).cast("long").alias("key"), F.lit(0).cast("long").alias("nth"))
    first = written(_looked_up(numbered, folder, parts), f"{folder}/found-{uuid.uuid4().hex[:8]}")
    several = first.where("copies > 1")
    if not several.limit(1).count():
        return first.drop("copies")
    last = F.col("copies") - 1
    blocks = several.select("key", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / _BLOCK))).alias("block")).repartition("key", "block")
    low = F.col("block") * _BLOCK
    rest = blocks.select("key", F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), low), F.least(last, low + _BLOCK - 1))).alias("nth"))
    return first.unionByName(_looked_up(rest, folder, parts)).drop("copies")


def shard_starts(entries: DataFrame) -> dict[int, int]:
    """Ids of all shards before each shard: one row per shard file comes to the driver."""
    out, at = {}, 0
    for shard, n in sorted(entries.groupBy("shard").agg(F.sum("n_tokens")).collect()):
        out[shard] = at
        at += n
    return out


def read_back(found: DataFrame, folder: str, width: int, starts: dict[int, int]) -> DataFrame:
    """The ids of each found row: (key, start, n_tokens, ids), unsigned 32-bit."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        shard = t.column("shard")[0].as_py()
        t = t.sort_by("offset")
        fs, at = open_fs(shard_path(folder, shard, width))
        keys, offsets, n = t.column("key").combine_chunks(), t.column("offset").to_pylist(), t.column("n_tokens").to_pylist()
        with fs.open_input_file(at) as f:
            for lo in range(0, len(keys), 256):
                some = slice(lo, lo + 256)
                ids = [np.frombuffer(f.read_at(width * k, width * o), dtype=f"<u{width}").astype("<u4").tobytes() for o, k in zip(offsets[some], n[some], strict=True)]
                yield pa.RecordBatch.from_arrays([keys[some], pa.array([starts[shard] + o for o in offsets[some]], pa.int64()), pa.array(n[some], pa.int64()), pa.array(ids, pa.binary())], names=["key", "start", "n_tokens", "ids"])

    return found.groupBy("shard").applyInArrow(read, "key long, start long, n_tokens long, ids binary")


def id_width(vocabulary: int) -> int:
    """Bytes of an id of a vocabulary of that size."""
    return 2 if vocabulary <= 1 << 16 else 4


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written and found again by key."""
    import public_tokenizers

    docs, folder = table(spark, sf_dir, "documents"), scratch(spark, "token-shards")
    width = id_width(49_408)
    entries = write_shards(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2, width=width)
    parts = index_parts(entries)
    write_index(entries, folder, parts)
    found = find(docs.select("doc_id").distinct(), folder, parts, "doc_id")
    back = read_back(found, folder, width, shard_starts(entries))
    return back.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
