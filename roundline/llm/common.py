"""Tables, scratch folders and files that the operators share."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors
    share.  Without that setting a local session takes a folder of its machine,
    and a cluster is refused (ValueError): its executors would not see the files.
    Folders are left for the cluster's own clean-up."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.conf.get("spark.master", "local").partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a written table: its lineage ends here and no row is computed twice."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(spark: SparkSession, amount: int | None, most: int) -> int:
    """Number of partitions that hold ``most`` each (bytes or rows), the session's own at least."""
    return max(partitions(spark), math.ceil((amount or 0) / most))


#: rows of one key from which a join takes the key's row by broadcast, and the
#: share of all rows that such a key has at least: no more keys than the inverse
HOT_ROWS, HOT_SHARE = 100_000, 1e-5


def joined_to_one(rows: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``one``, a row for each ``key`` with the number
    ``n`` of its rows; inner join.

    A key with a large share of the rows would fill one task: such keys, at most
    ``1 / HOT_SHARE`` rows, are broadcast, and their rows stay where they are.
    ``one`` should be a written table, it is read twice."""
    total, top = one.agg(F.sum("n"), F.max("n")).first()
    least = max(HOT_ROWS, math.ceil((total or 0) * HOT_SHARE))
    if not top or top < least:
        return rows.join(one, key)
    hot = F.broadcast(one.where(F.col("n") >= least))
    rest = rows.join(F.broadcast(one.where(F.col("n") >= least).select(key)), key, "left_anti").join(one.where(F.col("n") < least), key)
    return rows.join(hot, key).unionByName(rest)


def tidy(run: Callable[[Iterator[Any]], Iterator[Any]]) -> Callable[[Iterator[Any]], Iterator[Any]]:
    """``run``, which at its end returns freed memory to the machine: Python workers are reused
    by later stages, and would hold on to what their largest task took."""

    def tidied(batches: Iterator[Any]) -> Iterator[Any]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
        if trim:
            trim(0)

    return tidied


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def open_fs(path: str) -> tuple[Any, str]:
    """Arrow file system and path; works in tasks for any store that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def write_file(path: str, parts: Iterable[bytes]) -> int:
    """Writes a file under another name first, so that a retried or doubled task
    leaves one whole file; returns its size."""
    fs, at = open_fs(path)
    folder = at.rpartition("/")[0]
    fs.create_dir(folder, recursive=True)
    own, size = f"{at}.{uuid.uuid4().hex}", 0
    with fs.open_output_stream(own) as out:
        for p in parts:
            out.write(p)
            size += len(p)
    fs.move(own, at)
    return size


class FileWriter:
    """``write_file`` for callers that produce the parts one by one."""

    def __init__(self, path: str):
        self._fs, self._at = open_fs(path)
        self._fs.create_dir(self._at.rpartition("/")[0], recursive=True)
        self._own = f"{self._at}.{uuid.uuid4().hex}"
        self._out = self._fs.open_output_stream(self._own)
        self.size = 0

    def write(self, data: bytes) -> None:
        self._out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self._out.close()
        self._fs.move(self._own, self._at)
