"""Token ids of whole texts by a table of distinct chunks.

A text is cut where no token can cross; each distinct chunk is encoded once by
the tokenizer's own library and the ids are joined back by position.  The table
lives in the Python worker and holds at most ``capacity`` chunks; chunks beyond
it are encoded again in each batch, so memory is bounded and results are equal.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable

import numpy as np

#: distinct chunks that one Python worker remembers
CAPACITY = 400_000
#: chunks longer than this are never remembered
LONG_CHUNK = 64

_TABLES: dict[tuple[str, str], ChunkTable] = {}


class ChunkTable:
    """``chunks`` cuts a text, ``encode`` gives the ids of many chunks."""

    def __init__(self, chunks: Callable[[str], list[str]], encode: Callable[[list[str]], Iterable[list[int]]], capacity: int = CAPACITY):
        self._chunks, self._encode, self._capacity = chunks, encode, capacity
        self._known: dict[str, bytes] = {}

    def cut(self, text: str | None) -> list[str]:
        return self._chunks(text) if text else []

    def encoded(self, chunks: list[str]) -> list[bytes]:
        return [np.asarray(i, dtype="<u4").tobytes() for i in self._encode(chunks)]

    def with_known(self, known: dict[str, bytes], more: int) -> ChunkTable:
        """A table that begins with the ids of ``known`` chunks and remembers ``more`` others."""
        out = ChunkTable(self._chunks, self._encode, len(known) + more)
        out._known = dict(known)
        return out

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null is empty."""
        cut = [self._chunks(t) if t else [] for t in texts]
        known = self._known
        new = list(set().union(*cut).difference(known)) if cut else []
        if new:
            known.update((c, np.asarray(i, dtype="<u4").tobytes()) for c, i in zip(new, self._encode(new), strict=True))
        look = known.__getitem__
        out = [b"".join(map(look, c)) for c in cut]
        full = len(known) > self._capacity
        for c in new:  # never those that were there before
            if full or len(c) > LONG_CHUNK:
                del known[c]
        return out


#: texts of these characters alone are their own NFC form and have the same lower
#: case everywhere, so their pre-tokens can be cut here
_PLAIN = re.compile("[\\x00-\\x7fÀ-ÖØ-öø-ÿ]*")
_LETTERS, _SPACES = "a-zß-öø-ÿ", " \\t\\n\\r\\f\\v"
#: the pre-tokenizer's pattern over plain lower-case text (fixed value of the tokenizer file)
_PRE_TOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_SPACES}{_LETTERS}0-9]+")
#: with this begin the strings of the file's special tokens
_SPECIAL = "<|"
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _pre_tokens(text: str) -> list[str]:
    """Pre-tokens of plain text; of other text what lies between ASCII white
    space, which the pre-tokenizer drops and no token crosses.  A text that may
    hold a special token's string is left whole to the library."""
    if _SPECIAL in text:
        return [text]
    if text.isascii() or _PLAIN.fullmatch(text):
        return _PRE_TOKENS.findall(text.lower())
    for c in "\n\t\r\f\v":
        if c in text:
            text = text.replace(c, " ")
    return text.split(" ")


def word_table(path: str) -> ChunkTable:
    """For a tokenizers file of the lower-case word kind.

    Raises ValueError for a file with another normalizer, pre-tokenizer or other
    special tokens.  As by the library's default, special tokens' strings in a
    text become these tokens."""
    if ("word", path) not in _TABLES:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        made = json.loads(tok.to_str())
        if not all(t["content"].startswith(_SPECIAL) and not t["normalized"] for t in made["added_tokens"]) or [n["type"] for n in made["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"] or made["pre_tokenizer"]["pretokenizers"][0]["pattern"] != {"Regex": _PATTERN}:
            raise ValueError(f"{path}: not a lower-case word tokenizer")

        def encode(chunks: list[str]) -> list[list[int]]:
            # one call for many chunks: an id belongs to the chunk that its offset falls in
            out = []
            for at in range(0, len(chunks), 512):
                some = chunks[at : at + 512]
                e = tok.encode(" ".join(some), add_special_tokens=False)
                ends = np.cumsum([len(c) + 1 for c in some])
                owner = np.searchsorted(ends, [a for a, _ in e.offsets], side="right")
                out += np.split(np.array(e.ids, dtype="<u4"), np.searchsorted(owner, np.arange(1, len(some))))
            return out

        _TABLES["word", path] = ChunkTable(_pre_tokens, encode)
    return _TABLES["word", path]


_MARKED = re.compile(" [ ]*[^ ]*")


def _marked_chunks(text: str) -> list[str]:
    """Words with the spaces before them, without the first space of each, which
    the library puts back as its dummy prefix."""
    text = text.replace("▁", " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [c[1:] for c in _MARKED.findall(f" {text}")]


def piece_processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def crossing_pieces(processor) -> list[str]:
    """Pieces in which a white-space marker follows another character."""
    return [p for p in map(processor.id_to_piece, range(processor.get_piece_size())) if "▁" in p.lstrip("▁")]


def piece_table(path: str) -> ChunkTable:
    """For a sentencepiece model.  Where a piece could cross a white-space
    marker, or the model folds white space, whole texts are the chunks."""
    if ("piece", path) not in _TABLES:
        sp = piece_processor(path)
        plain = not crossing_pieces(sp) and sp.normalize(" a  b\n") == "▁▁a▁▁b\n"
        lone = [sp.piece_to_id("▁")]  # a marker alone, to which the library's prefix is not added
        _TABLES["piece", path] = ChunkTable(_marked_chunks if plain else lambda t: [t], lambda c: (i if w else lone for w, i in zip(c, sp.encode(c, num_threads=1), strict=True)))
    return _TABLES["piece", path]
