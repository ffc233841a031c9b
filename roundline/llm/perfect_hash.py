"""A minimal perfect hash in numpy: cascading bit arrays.

At each level a key sets one bit; keys that met another go on to the next
level.  A key's slot is the number of set bits before its own, over all levels,
so n keys fill the slots 0 to n - 1.  About 3 bits a key, a few probes a lookup.
Keys are pairs of independent 64-bit hashes and must be distinct.
"""

from __future__ import annotations

import json

import numpy as np

from .textops import U64, mix

GAMMA = 2
LEVELS = 40
_MAGIC = b"MPHIDX01"


def _bit(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(a + b * U64(2 * level + 1)) % U64(size)).astype(np.int64)


class PerfectHash:
    def __init__(self, levels: list[np.ndarray]):
        self._levels = levels
        self._words = np.concatenate(levels) if levels else np.zeros(0, dtype=U64)
        ones = np.bitwise_count(self._words).astype(np.int64)
        self._rank = np.concatenate(([0], np.cumsum(ones)))
        self._at = np.concatenate(([0], np.cumsum([len(x) for x in levels]))).astype(np.int64)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        levels = []
        while len(a):
            if len(levels) == LEVELS:
                raise ValueError("the keys are not distinct")
            size = max(64, (GAMMA * len(a) + 63) // 64 * 64)
            at = _bit(a, b, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8").astype(U64))
            rest = ~alone[at]
            a, b = a[rest], b[rest]
        return cls(levels)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each key; a key that was not built in gets -1 or any slot."""
        out = np.full(len(a), -1, dtype=np.int64)
        left = np.arange(len(a))
        for level, words in enumerate(self._levels):
            if not len(left):
                break
            at = _bit(a[left], b[left], level, len(words) * 64)
            word = self._at[level] + at // 64
            bit = (at % 64).astype(U64)
            own = self._words[word]
            hit = (own >> bit) & U64(1) == 1
            below = np.bitwise_count(own & ((U64(1) << bit) - U64(1)))
            out[left[hit]] = (self._rank[word] + below)[hit]
            left = left[~hit]
        return out

    def arrays(self) -> list[np.ndarray]:
        return self._levels


def dump(perfect: PerfectHash, columns: dict[str, np.ndarray]) -> list[bytes]:
    """An index file: a JSON line of lengths and types, the levels, the slots' columns."""
    levels = perfect.arrays()
    head = json.dumps({"levels": [len(x) for x in levels], "columns": {k: [v.dtype.str, len(v)] for k, v in columns.items()}}).encode()
    return [_MAGIC, len(head).to_bytes(4, "little"), head, *(x.astype("<u8").tobytes() for x in levels), *(v.tobytes() for v in columns.values())]


def load(data: bytes) -> tuple[PerfectHash, dict[str, np.ndarray]]:
    if data[:8] != _MAGIC:
        raise ValueError("not an index file")
    at = 12 + int.from_bytes(data[8:12], "little")
    head = json.loads(data[12:at])
    levels, columns = [], {}
    for n in head["levels"]:
        levels.append(np.frombuffer(data, dtype="<u8", count=n, offset=at).astype(U64))
        at += 8 * n
    for k, (kind, n) in head["columns"].items():
        columns[k] = np.frombuffer(data, dtype=kind, count=n, offset=at)
        at += n * np.dtype(kind).itemsize
    return PerfectHash(levels), columns
