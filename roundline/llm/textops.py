"""Vectorised word and hash helpers that run inside Spark tasks.

A batch of texts becomes one byte buffer in which the words of a document are
separated by exactly one space; word and shingle hashes are then computed with
numpy over the whole batch.  Nothing here keeps state between batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: bytes of text that a helper works on at once; a longer single text is its own block
BLOCK_BYTES = 1_000_000
#: strings longer than this are hashed one by one by the xxhash library
LONG_BYTES = 2048

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: also cuts at ASCII punctuation
LETTER_GAPS = np.ones(128, dtype=bool)
LETTER_GAPS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
LETTER_GAPS = np.concatenate((LETTER_GAPS, np.zeros(128, dtype=bool)))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a block of texts.

    ``buf`` holds the words of all texts, each followed by one space and then
    padding; ``start``/``end`` are byte positions in it; the words of text ``i``
    are ``first[i]:first[i + 1]``.
    """

    def __init__(self, texts: list[bytes], lower: bool = False, separator: np.ndarray = _SEPARATOR):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        if lower:
            raw = _LOWER[raw]
        gap = separator[raw]
        before = np.empty_like(gap)
        before[0] = True
        before[1:] = gap[:-1]
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        text_at = np.concatenate(([0], np.cumsum(lengths)))
        begins = np.flatnonzero(~gap & before)
        ends = np.flatnonzero(gap & ~before)
        kept = raw[~gap | ~before]
        self.buf = np.concatenate((kept, np.zeros(64, dtype=np.uint8)))
        size = ends - begins
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        self.buf[self.end] = 0x20
        self.first = np.searchsorted(begins, text_at)

    def __len__(self) -> int:
        return len(self.start)

    def owner(self) -> np.ndarray:
        """Index of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, i: int, keep: np.ndarray | None = None) -> bytes:
        """Words of text ``i`` joined by one space; ``keep`` masks all words of the block."""
        a, b = self.first[i], self.first[i + 1]
        if a == b:
            return b""
        if keep is None or keep[a:b].all():
            return self.buf[self.start[a] : self.end[b - 1]].tobytes()
        at = np.flatnonzero(keep[a:b]) + a
        if not len(at):
            return b""
        lo, hi = self.start[a], self.end[b - 1] + 1
        delta = np.zeros(hi - lo + 1, dtype=np.int8)
        delta[self.start[at] - lo] += 1
        delta[self.end[at] + 1 - lo] -= 1
        return self.buf[lo:hi][np.cumsum(delta[:-1]).astype(bool)].tobytes()[:-1]


def _lanes(buf: np.ndarray) -> np.ndarray:
    """Every unaligned little-endian 8-byte word of ``buf``."""
    return np.ndarray(shape=(len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))


_P1, _P2, _P3, _P4, _P5 = (U64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of ``buf[start:end]`` for many ranges; ``buf`` needs 8 bytes of padding."""
    n = (end - start).astype(np.int64)
    out = np.empty(len(n), dtype=U64)
    if not len(n):
        return out
    long = np.flatnonzero(n > LONG_BYTES)
    if len(long):
        view = memoryview(np.ascontiguousarray(buf))
        for i in long:
            out[i] = xxhash.xxh64_intdigest(view[int(start[i]) : int(end[i])], seed)
    order = np.argsort(n, kind="stable")
    order = order[: len(n) - len(long)]
    if not len(order):
        return out
    n, at = n[order], start[order].astype(np.int64)
    lanes = _lanes(buf)
    s = U64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(n), s + _P5, dtype=U64)
        wide = int(np.searchsorted(n, 32))  # sorted by length: the rest has whole 32-byte stripes
        if wide < len(n):
            acc = [np.full(len(n) - wide, v, dtype=U64) for v in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            stripes = n[wide:] // 32
            for k in range(int(stripes[-1])):
                lo = int(np.searchsorted(stripes, k, side="right"))
                p = at[wide + lo :] + 32 * k
                for j in range(4):
                    acc[j][lo:] = _round(acc[j][lo:], lanes[p + 8 * j])
            x = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for a in acc:
                x = (x ^ _round(np.zeros_like(a), a)) * _P1 + _P4
            h[wide:] = x
        h += n.astype(U64)
        at = at + (n // 32) * 32
        rest = n % 32
        for _ in range(3):
            m = np.flatnonzero(rest >= 8)
            if not len(m):
                break
            h[m] = _rotl(h[m] ^ _round(np.zeros(len(m), dtype=U64), lanes[at[m]]), 27) * _P1 + _P4
            at[m] += 8
            rest[m] -= 8
        m = np.flatnonzero(rest >= 4)
        if len(m):
            h[m] = _rotl(h[m] ^ ((lanes[at[m]] & U64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
            at[m] += 4
            rest[m] -= 4
        for _ in range(3):
            m = np.flatnonzero(rest > 0)
            if not len(m):
                break
            h[m] = _rotl(h[m] ^ (buf[at[m]].astype(U64) * _P5), 11) * _P1
            at[m] += 1
            rest[m] -= 1
        h ^= h >> U64(33)
        h *= _P2
        h ^= h >> U64(29)
        h *= _P3
        h ^= h >> U64(32)
    out[order] = h
    return out


def differs(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes at ``a`` differ from those at ``b``; ``buf`` is padded."""
    lanes = _lanes(buf)
    out = np.zeros(len(a), dtype=bool)
    todo = np.flatnonzero(size > 0)
    done = 0
    while len(todo):
        x = lanes[a[todo] + done] ^ lanes[b[todo] + done]
        rest = size[todo] - done
        short = rest < 8
        x[short] &= (U64(1) << (rest[short] * 8).astype(U64)) - U64(1)
        out[todo] = x != 0
        done += 8
        todo = todo[(x == 0) & (rest > 8)]
    return out


def word_hashes(words: Words, seed: int = 0) -> np.ndarray:
    """XXH64 of every word of a block."""
    return xxh64(words.buf, words.start, words.end, seed)


_BASES = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class WindowHash:
    """Hashes of windows of consecutive words from doubling: a window of ``2w``
    words is combined from its two halves, other lengths from powers of two.
    ``which`` selects one of two independent families."""

    def __init__(self, hashes: np.ndarray, which: int = 0):
        self._base = _BASES[which]
        self._levels = {1: mix(hashes + self._base)}
        self._n = len(hashes)

    def of(self, width: int) -> np.ndarray:
        """Hash of the window that starts at each of the first ``n - width + 1`` words."""
        if width in self._levels:
            return self._levels[width]
        half = width // 2
        a, b = self.of(half), self.of(width - half)
        n = max(0, self._n - width + 1)
        with np.errstate(over="ignore"):
            out = mix(a[:n] * (self._base | U64(1)) + b[half : half + n] + U64(width))
        self._levels[width] = out
        return out


def text_blocks(texts: Iterable[str | None], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, UTF-8 texts) of blocks of about ``limit`` bytes; null is empty."""
    block: list[bytes] = []
    size = first = 0
    for i, t in enumerate(texts):
        data = b"" if t is None else t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass")
        if block and size + len(data) > limit:
            yield first, block
            block, size, first = [], 0, i
        block.append(data)
        size += len(data) + 1
    if block:
        yield first, block


def column_bytes(column: pa.Array, rows: int = 512) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, some ``rows`` at a time; null is empty."""
    for at in range(0, len(column), rows):
        yield from (v or b"" for v in column.slice(at, rows).cast(pa.large_binary()).to_pylist())
