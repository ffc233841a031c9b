"""Signal documents as a Spark data source: one JSON file a recording.

``spark.read.format("signals").load(folder)`` gives a row a reading of documents of version 1
(rows of four) and 2 (rows of six), with the document's own values; a file that is no sound
document gives one row that tells its ``damage``, so that one bad file neither stops a job
nor goes unseen.  Files are dealt to tasks by bytes.

``write_signals`` writes version 2, a file a recording under its name: tasks write into a
folder of their own, and only the files of tasks that Spark took as done are moved in place.
An existing folder with documents is refused unless the mode is overwrite; a recording that
comes from two tasks is an error.  Null times, counters and codes stay null; an empty table
writes no file.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .files import CODES

SCHEMA = "file string, stem string, version int, scan_fps double, duration double, i bigint, t double, k bigint, conf double, method string, d bigint, a bigint, damage string"
VERSION, SCAN_FPS = 2, 4.0
#: bytes of documents that a task reads
TASK_BYTES = 32 << 20


def _filesystem(path: str) -> tuple[Any, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def _documents(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the JSON files under a folder, in order of name; none if it is missing."""
    from pyarrow import fs

    store, at = _filesystem(path)
    found = store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.base_name.endswith(".json") and "/_" not in f.path[len(at) :])


def _number(v: Any, kind: type) -> Any:
    if v is None or isinstance(v, bool) or (isinstance(v, float) and not math.isfinite(v)):
        return None
    return kind(v)


def parsed(name: str, text: bytes) -> list[tuple]:
    """Rows of SCHEMA of one document; of a damaged one a single row."""
    damaged = lambda why: [(name, *[None] * 11, why)]
    try:
        d = json.loads(text)
        head = (name, str(d["stem"]), int(d.get("version", 1)), _number(d.get("scan_fps", SCAN_FPS), float), _number(d["duration"], float))
        rows = []
        for i, r in enumerate(d["reads"]):
            t, k, conf, code, *rest = r
            more = [*rest, None, None][:2]
            rows.append((*head, i, _number(t, float), _number(k, int), _number(conf, float), CODES.get(code, code), *(_number(x, int) for x in more), None))
    except (UnicodeDecodeError, json.JSONDecodeError) as e:
        return damaged(f"not JSON: {e}"[:200])
    except (KeyError, TypeError, ValueError, AttributeError) as e:
        return damaged(f"not a signal document: {type(e).__name__} {e}"[:200])
    return rows or [(*head, *[None] * 8)]


@dataclass
class _Files(InputPartition):
    paths: list[str]


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self._path = path

    def partitions(self) -> list[_Files]:
        out, size = [_Files([])], 0
        for path, n in _documents(self._path):
            if out[-1].paths and size + n > TASK_BYTES:
                out.append(_Files([]))
                size = 0
            out[-1].paths.append(path)
            size += n
        return out

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "bigint": pa.int64()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in SCHEMA.split(", "))])
        store = _filesystem(self._path)[0]
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                rows = parsed(path.rpartition("/")[2], f.read())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


@dataclass
class _Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    """Rows (stem, t, k, conf, method, d, a) sorted by recording and time."""

    def __init__(self, path: str, columns: list[str], overwrite: bool):
        self._path, self._columns, self._overwrite = path, columns, overwrite
        self._own = f"_writing-{uuid.uuid4().hex}"
        if not overwrite and _documents(path):
            raise FileExistsError(f"{path} holds documents; use mode overwrite to replace them")

    def write(self, iterator: Iterator[Row]) -> _Written:
        store, at = _filesystem(self._path)
        folder = f"{at}/{self._own}/{uuid.uuid4().hex}"
        codes = {v: k for k, v in CODES.items()}
        names: list[tuple[str, str]] = []
        stem, reads = None, []

        def finish() -> None:
            if not reads:
                return
            name = f"{quote(stem, safe=' ()[]')}.json"
            duration = max((r[0] for r in reads if r[0] is not None), default=0.0)
            store.create_dir(folder, recursive=True)
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write(json.dumps({"version": VERSION, "stem": stem, "scan_fps": SCAN_FPS, "duration": duration, "reads": reads}, ensure_ascii=False).encode())
            names.append((name, f"{folder}/{name}"))

        rounded = lambda v: None if v is None else round(v, 3)
        for row in iterator:
            r = dict(zip(self._columns, row, strict=True))
            if r["stem"] != stem:
                finish()
                stem, reads = r["stem"], []
            reads.append([rounded(r["t"]), r["k"], rounded(r["conf"]), codes.get(r["method"], "?"), r["d"], r["a"]])
        finish()
        return _Written(names)

    def commit(self, messages: list[_Written | None]) -> None:
        store, at = _filesystem(self._path)
        names = [n for m in messages if m for n in m.names]
        if len({n for n, _ in names}) < len(names):
            self.abort(messages)
            raise ValueError("a recording was written by two tasks; deal rows by recording")
        old = {p for p, _ in _documents(self._path)}
        store.create_dir(at, recursive=True)
        for name, own in names:
            store.move(own, f"{at}/{name}")
        if self._overwrite:
            for p in old - {f"{at}/{n}" for n, _ in names}:
                store.delete_file(p)
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        store, at = _filesystem(self._path)
        own = f"{at}/{self._own}"
        if store.get_file_info(own).type == fs.FileType.Directory:
            store.delete_dir(own)


class SignalSource(DataSource):
    """``format("signals")``: option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "signals"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema.names, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SignalSource)


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("signals").load(path)


def write_signals(reads: DataFrame, path: str, overwrite: bool = False) -> None:
    """Readings (stem, rn, t, k, conf, method, d, a) as documents of version 2."""
    register(reads.sparkSession)
    rows = reads.where("stem is not null").repartition("stem").sortWithinPartitions("stem", "t", "rn").select("stem", "t", "k", "conf", "method", "d", "a")
    rows.write.format("signals").mode("overwrite" if overwrite else "append").save(path)
