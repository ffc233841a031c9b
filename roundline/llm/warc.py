"""WARC archives: writer with deduplicated payloads, and a salvage reader.

``write_archives`` stores one record a row, each its own gzip member: the row
with the smallest id among equal payloads is a ``response`` with the payload,
the others are ``revisit`` records that name it.

``read_archives`` checks every member (gzip checksum, version line, length,
block digest).  After a failed check it searches for the next gzip member that
holds a record, or in uncompressed parts for the next version line, goes on
from there, and logs the bytes between as a quarantined gap.  It reads in
pieces; a task holds one record and ``CHUNK`` bytes.

Tasks write under a name of their own and rename; a retried task leaves whole
files.  Payloads are matched by 160-bit digest; bucket minima are partial sums
and only (id, digest) rows are joined, frequent digests by broadcast; the payloads
move once, by id, digest and url.  The number of archives follows their bytes.

Null payload: empty.  Null id: a record without id, which never is the one that
others refer to unless all ids are null (then each is a response).  Rows that
share the smallest id and the payload are all responses.  Payloads shorter than
``min_revisit`` are all responses.  Empty table: no archives, empty results.
Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FileWriter, joined_to_one, open_fs, parts_for, scratch, table, text_or_empty, written

CHUNK = 1 << 20
#: payload bytes of one archive
ARCHIVE_BYTES = 1 << 30
_PIECE = 1 << 14
_VERSION = b"WARC/1.0\r\n"
_MEMBER = b"\x1f\x8b\x08"
_ARCHIVE = "part int, path string, records long, bytes long"
_FOUND = "path string, at long, size long, gap boolean, reason string, record_type string, page_id long, refers_to long, payload_bytes long, payload_digest string, uri string, payload binary"


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _urn(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def record(page_id: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit (``refers_to``) has no block but tells the payload's size and digest."""
    body = b"" if refers_to is not None else payload
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Record-ID: {_urn(page_id) if page_id is not None else '<urn:page:>'}",
        f"WARC-Target-URI: {(uri or '').translate({10: '%0A', 13: '%0D'})}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(body).hexdigest()) if refers_to is not None else digest}",
        *([f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"] if refers_to is not None else []),
        "Content-Type: application/octet-stream",
        f"Content-Length: {len(body)}",
    ]
    return _VERSION + "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, min_revisit: int = 0, level: int = 4, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives of about ``archive_bytes`` of payload, one a partition; returns
    their written list (part, path, records, bytes)."""
    spark = pages.sparkSession
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).cast("string").alias("uri"), text_or_empty(payload_col).alias("payload"))
    # keys without nulls; the url's hash only spreads rows that share id and payload
    key = {"digest": F.unhex(F.sha1(F.col("payload").cast("binary"))), "id": F.coalesce("page_id", F.lit(0).cast("long")), "none": F.col("page_id").isNull(), "spread": F.xxhash64("uri")}
    dealt = own.withColumns(key)
    light = written(dealt.select("page_id", *key, F.octet_length("payload").alias("size")), f"{folder}/light")
    large = light.where(F.col("size") >= min_revisit)
    first = written(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")), f"{folder}/first")
    again = joined_to_one(large, first, "digest").where(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")))
    refers = again.select(*key, "first").distinct()
    files = parts_for(spark, light.agg(F.sum("size")).first()[0], archive_bytes)
    rows = dealt.repartition(files, *key).join(refers, list(key), "left").select("page_id", "uri", "payload", "digest", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}.warc.gz"
        out, n = None, 0
        for b in batches:
            out = out or FileWriter(path)
            for page, uri, payload, digest, first in zip(*(c.to_pylist() for c in (b.column(0), b.column(1), b.column(2).cast(pa.large_binary()), b.column(3), b.column(4))), strict=True):
                made = record(page, uri, payload, base64.b32encode(digest).decode(), first)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(packer.compress(made) + packer.flush())
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([n], pa.int64()), pa.array([out.size], pa.int64())], names=["part", "path", "records", "bytes"])

    return written(rows.mapInArrow(run, _ARCHIVE), f"{folder}/archives")


class _Window:
    """A file read in pieces: ``data`` from ``pos`` on, which is byte ``at`` of the file."""

    def __init__(self, file, size: int):
        self._file, self.size, self.at, self.data, self.pos = file, size, 0, b"", 0

    @property
    def held(self) -> int:
        return len(self.data) - self.pos

    def fill(self, n: int) -> bool:
        """Makes ``n`` bytes available if the file has them."""
        while self.held < n and self.at + self.held < self.size:
            more = self._file.read(max(CHUNK, n - self.held))
            if not more:
                break
            self.data, self.pos = self.data[self.pos :] + more, 0
        return self.held >= n

    def starts(self, prefix: bytes) -> bool:
        return self.fill(len(prefix)) and self.data.startswith(prefix, self.pos)

    def find(self, what: bytes, after: int = 0) -> int:
        """Place of ``what`` from the window's start on, -1 if it is not held."""
        return max(-1, self.data.find(what, self.pos + after) - self.pos)

    def part(self, a: int, b: int) -> bytes:
        return self.data[self.pos + a : self.pos + b]

    def skip(self, n: int) -> None:
        self.pos += n
        self.at += n


class Damaged(Exception):
    pass


def _member(window: _Window) -> tuple[bytes, int]:
    """The content of the gzip member at the window's start and its length in the file."""
    unpack, used, out = zlib.decompressobj(31), 0, []
    while not unpack.eof:
        if used == window.held and not window.fill(used + 1):
            raise Damaged("member ends early")
        piece = window.part(used, used + _PIECE)
        try:
            out.append(unpack.decompress(piece))
        except zlib.error as e:
            raise Damaged(f"member: {e}") from None
        used += len(piece) - len(unpack.unused_data)
    return b"".join(out), used


def parse(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, length) of the record at the start of ``data``; raises Damaged."""
    if not data.startswith(b"WARC/"):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise Damaged("header ends early")
    head = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("header line without a colon")
        head[name.lower()] = value.strip()
    if not head.get("content-length", "").isdigit():
        raise Damaged("no length")
    stop = end + 4 + int(head["content-length"])
    if len(data) < stop + 4 or data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("block ends early")
    block = data[end + 4 : stop]
    told = head.get("warc-block-digest", "").removeprefix("sha1:")
    if told and told != base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise Damaged("block digest differs")
    return head, block, stop + 4


def _plain(window: _Window) -> tuple[dict[str, str], bytes, int]:
    """The uncompressed record at the window's start."""
    while (end := window.find(b"\r\n\r\n")) < 0 and window.held < CHUNK and window.fill(window.held + 1):
        pass
    length = [x for x in window.part(0, max(end, 0)).lower().split(b"\r\n") if x.startswith(b"content-length:")]
    told = length[0].partition(b":")[2].strip() if length else b""
    if not told.isdigit() or not window.fill(whole := end + 8 + int(told)):
        raise Damaged("record ends early or has no length")
    return parse(window.part(0, whole))


def records(file, size: int) -> Iterator[tuple[int, int, str | None, dict[str, str], bytes]]:
    """(place, bytes, None, headers, block) of each sound record, and
    (place, bytes, reason, {}, b"") of each gap, in the file's order."""
    window = _Window(file, size)
    gap, why = None, ""
    while window.fill(1):
        try:
            if window.starts(_MEMBER):
                content, used = _member(window)
                head, block, n = parse(content)
                if n != len(content):
                    raise Damaged("more than a record in the member")
            elif window.starts(b"WARC/"):
                head, block, used = _plain(window)
            else:
                raise Damaged("neither member nor version line")
        except Damaged as e:
            if gap is None:
                gap, why = window.at, str(e)
            step = 1
            while True:  # to the next place that may begin a record
                places = [p for p in (window.find(_MEMBER, step), window.find(b"WARC/1.", step)) if p >= 0]
                if places:
                    window.skip(min(places))
                    break
                window.skip(max(0, window.held - 6))  # a mark may lie across two pieces
                if not window.fill(window.held + 1):
                    window.skip(window.held)
                    break
                step = 0
            continue
        if gap is not None:
            yield gap, window.at - gap, why, {}, b""
            gap = None
        yield window.at, used, None, head, block
        window.skip(used)
    if gap is not None:
        yield gap, window.at - gap, why, {}, b""


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and gaps (``gap``, with ``reason``) of the files in column ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("gap", pa.bool_()), ("reason", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("uri", pa.string()), ("payload", pa.binary())])
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = open_fs(path)
                rows, held = [], 0
                # the members are unpacked here, one by one: Arrow would do it by the file's name
                with fs.open_input_stream(at, compression=None) as f:
                    for place, n, why, head, block in records(f, fs.get_file_info(at).size):
                        kind = head.get("warc-type")
                        size, digest = len(block), head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        if kind == "revisit":
                            size = int(head.get("x-payload-length", 0))
                        elif why is None:
                            digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
                        rows.append((path, place, n, why is not None, why, kind, _page(head.get("warc-record-id")), _page(head.get("warc-refers-to")), None if why else size, digest, head.get("warc-target-uri"), block if payloads and kind != "revisit" and why is None else None))
                        held += len(block) if payloads else 0
                        if len(rows) >= 2000 or held > CHUNK:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    last = archives.agg(F.max("part")).first()[0] or 0
    return archives.select("path", "part").repartitionById(last + 1, "part").select("path").mapInArrow(run, _FOUND)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back; fails if a record is missing or damaged."""
    folder = scratch(spark, "warc")
    archives = write_archives(table(spark, sf_dir, "pages"), folder)
    found = written(read_archives(archives, payloads=False), f"{folder}/found")
    sound, gaps = found.agg(F.count_if(~F.col("gap")), F.count_if("gap")).first()
    made = archives.agg(F.sum("records")).first()[0] or 0
    if gaps or sound != made:
        raise RuntimeError(f"{made} records were written, {sound} are read back with {gaps} gaps")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
