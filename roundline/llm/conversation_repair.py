"""Faults of conversations and their cheapest repair, with the least audit of edits.

A repaired conversation has the roles ``(system?(user assistant)+)?``.  Rows are kept
(K, free), given another role (R, 1) or deleted (D, 2), and empty turns are inserted
(I, 5); blank and repeated rows must go, and a truncated row that stays costs 5.
Among the cheapest audits (the letters in order) that of least ASCII order counts.

Rows are dealt by conversation and sorted by turn once.  A task walks them with a
dynamic programme over four states: nothing yet, after a system, a user and an
assistant turn.  A state's audit is a node in a tree of shared prefixes with
binary-lifting ancestors and a rolling hash: of two audits of equal cost, a search for
the longest common prefix finds the first letter that differs, and the prefixes are then
compared letter by letter up to their shared node, so that a collision of hashes never
decides.  Letters fix cost and states, so equal costs over the same rows are never a
prefix of one another and the least audit of a state goes on to the least audit of all.

Edits on which all states agree are written out while the conversation is walked: a
state that can no longer win is dropped, and a task holds the rows since the last edit
on which states still differ, so a conversation of any length streams through
(only one whose every row is as cheap to delete as to keep is held).

Null role and text: one space, thus blank.  Null conv_id: one conversation.  Null turns
come first and count in no gap.  Rows of equal turn are ordered by role, then text;
repeated rows are duplicates.  Roles that begin with none of s, u and a can only be
changed or deleted.  A conversation all of whose rows are gone: zeros, empty audit, hash
of the empty string.  Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import table

START, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANK = " \t\n\x0b\x0c\r"
NO_FAULT, IS_BLANK, IS_DUPLICATE, IS_TRUNCATED = range(4)
_BY_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_PAIRS = {("s", "u"), ("u", "a"), ("a", "u")}
#: nodes from which on decided edits are written out
_NODES = 4096


class EditTree:
    """Strings that share their prefixes; node 0 is the empty one."""

    def __init__(self, modulus: int = (1 << 61) - 1, base: int = 0x1F3D5B79):
        self._modulus, self._base = modulus, base
        self.letters, self.depths, self._hashes = [""], [0], [0]
        self._lifts: list[list[int]] = [[]]
        self._same: dict[int, int] = {}

    def __len__(self) -> int:
        return len(self.letters)

    def extended(self, node: int, letter: str) -> int:
        """A new node: the string of ``node`` and one letter more."""
        lifts, j = [node], 0
        while j < len(self._lifts[lifts[j]]):
            lifts.append(self._lifts[lifts[j]][j])
            j += 1
        self.letters.append(letter)
        self.depths.append(self.depths[node] + 1)
        self._hashes.append((self._hashes[node] * self._base + ord(letter)) % self._modulus)
        self._lifts.append(lifts)
        return len(self.letters) - 1

    def parent(self, node: int) -> int:
        return self._lifts[node][0]

    def prefix(self, node: int, depth: int) -> int:
        """The ancestor of ``depth`` letters."""
        over, j = self.depths[node] - depth, 0
        while over:
            if over & 1:
                node = self._lifts[node][j]
            over, j = over >> 1, j + 1
        return node

    def text(self, node: int, above: int = 0) -> str:
        """The letters of ``node`` after its ancestor ``above``."""
        out = []
        while node != above:
            out.append(self.letters[node])
            node = self.parent(node)
        return "".join(reversed(out))

    def _root(self, node: int) -> int:
        while node in self._same:
            node = self._same[node]
        return node

    def equal(self, a: int, b: int) -> bool:
        """Whether two nodes of equal depth have the same string, letter by letter; what
        was found equal before is not walked again."""
        walked = []
        while (a := self._root(a)) != (b := self._root(b)):
            if self.letters[a] != self.letters[b]:
                return False
            walked.append((a, b))
            a, b = self.parent(a), self.parent(b)
        self._same.update(walked)
        return True

    def before(self, a: int, b: int) -> bool:
        """Whether the string of ``a`` is less than that of ``b``."""
        depth = min(self.depths[a], self.depths[b])
        x, y = self.prefix(a, depth), self.prefix(b, depth)
        if self._hashes[x] == self._hashes[y]:
            return self.depths[a] < self.depths[b] if self.equal(x, y) else self.text(a) < self.text(b)
        for j in range(len(self._lifts[x]) - 1, -1, -1):
            if j < len(self._lifts[x]) and self._hashes[self._lifts[x][j]] != self._hashes[self._lifts[y][j]]:
                x, y = self._lifts[x][j], self._lifts[y][j]
        if not self.equal(self.parent(x), self.parent(y)):  # a collision
            return self.text(a) < self.text(b)
        return self.letters[x] < self.letters[y]


@dataclass
class Conversation:
    """One conversation, row by row in order of turns."""

    tree: EditTree = field(default_factory=EditTree)
    rows: int = 0
    distinct: int = 0
    first: int | None = None
    last: int | None = None
    faults: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    illegal: int = 0

    def __post_init__(self) -> None:
        self._live: list[tuple[int, int] | None] = [(0, 0), None, None, None]
        self._inserts()
        self._pending: deque[tuple[str, str]] = deque()
        self._initial: str | None = None
        self._limit = _NODES
        self._audit: list[str] = []
        self._state = START
        self._hash = hashlib.sha256()
        self._lines = 0

    def _offer(self, to: list, state: int, cost: int, node: int, letter: str) -> None:
        known = to[state]
        if known is None or cost < known[0]:
            to[state] = (cost, self.tree.extended(node, letter))
        elif cost == known[0]:
            made = self.tree.extended(node, letter)
            if self.tree.before(made, known[1]):
                to[state] = (cost, made)

    def _inserts(self) -> None:
        live = self._live
        for state, target in ((START, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT)):
            if live[state] is not None:
                self._offer(live, target, live[state][0] + INSERT, live[state][1], "I")

    def _drop(self) -> None:
        """Drops states that cannot win: whatever follows the empty state follows the
        assistant's too, a kept system turn deleted; what follows system follows assistant."""
        start, system, _, assistant = self._live
        if assistant and start and assistant[0] + DELETE < start[0]:
            self._live[START] = None
        if assistant and system and assistant[0] < system[0]:
            self._live[SYSTEM] = None

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        """The next row; ``again``: its role and text came before."""
        if turn is not None:
            self.distinct += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        initial, bare = role[:1], text.rstrip(BLANK)
        fault = IS_BLANK if not bare else IS_DUPLICATE if again else IS_TRUNCATED if bare[-1] not in ".!?" else NO_FAULT
        self.faults[fault] += 1
        self.illegal += self._initial is not None and (self._initial, initial) not in _PAIRS
        self._initial = initial
        self.rows += 1
        gone = fault in (IS_BLANK, IS_DUPLICATE)
        self._pending.append(("", "") if gone else (role, text))
        to: list[tuple[int, int] | None] = [None] * 4
        own = _BY_INITIAL.get(initial)
        for state, known in enumerate(self._live):
            if known is None:
                continue
            cost, node = known
            self._offer(to, state, cost + DELETE, node, "D")
            if gone:
                continue
            cost += TRUNCATED if fault == IS_TRUNCATED else 0
            after = ASSISTANT if state == USER else USER
            if own == after or (own == SYSTEM and state == START):
                self._offer(to, own, cost, node, "K")
            self._offer(to, after, cost + REROLE, node, "R")
        self._live = to
        self._inserts()
        self._drop()
        if len(self.tree) > self._limit:
            self._settle()

    def _settle(self) -> None:
        """Writes out the edits that all states share, and keeps only living nodes."""
        nodes = [x[1] for x in self._live if x]
        depth = min(self.tree.depths[n] for n in nodes)
        shared = {self.tree.prefix(n, depth) for n in nodes}
        while len(shared) > 1:
            shared = {self.tree.parent(n) for n in shared}
        (node,) = shared
        self._write(self.tree.text(node))
        old, new, made = self.tree, EditTree(self.tree._modulus, self.tree._base), {}
        for state, known in enumerate(self._live):
            if known:
                at = 0
                for letter in old.text(known[1], node):
                    at = made[at, letter] if (at, letter) in made else made.setdefault((at, letter), new.extended(at, letter))
                self._live[state] = (known[0], at)
        self.tree, self._limit = new, max(_NODES, 2 * len(new))

    def _write(self, letters: str) -> None:
        for letter in letters:
            role, text = self._pending.popleft() if letter != "I" else ("", "")
            if letter == "D":
                continue
            self._state = _BY_INITIAL[role[0]] if letter == "K" else ASSISTANT if self._state == USER else USER
            name = role if letter == "K" else "assistant" if self._state == ASSISTANT else "user"
            self._hash.update(f"{chr(10) if self._lines else ''}{name}:{text}".encode("utf-8", "surrogatepass"))
            self._lines += 1
        self._audit.append(letters)

    def finished(self) -> tuple:
        """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)."""
        best = self._live[ASSISTANT]
        start = self._live[START]
        if start and (start[0] < best[0] or (start[0] == best[0] and self.tree.before(start[1], best[1]))):
            best = start
        self._write(self.tree.text(best[1]))
        gaps = self.last - self.first + 1 - self.distinct if self.first is not None else 0
        return gaps, *self.faults[1:], self.illegal, best[0], "".join(self._audit), self._hash.hexdigest()


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repaired(rows: DataFrame) -> DataFrame:
    """Faults and repair of conversations of ``rows`` (conv_id, turn, role, text, gone): a
    row a conversation; rows marked ``gone`` only tell that the conversation exists."""
    kind = rows.schema["conv_id"].dataType
    schema = StructType().add("conv_id", kind)
    for f in StructType.fromDDL(RESULT):
        schema.add(f)
    made = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: Any = None
        own: Conversation | None = None
        out: list[tuple] = []

        def full() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * len(made)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, made, strict=True)], schema=made)

        for batch in batches:
            for conv, turn, role, text, gone, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own is None or conv != key:
                    if own is not None:
                        out.append((key, *own.finished()))
                    key, own = conv, Conversation()
                if not gone:
                    own.add(turn, role, text, again)
            yield full()
            out = []
        if own is not None:
            out = [(key, *own.finished())]
            yield full()

    blank = F.lit(" ")
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(~F.col("gone"), F.coalesce("role", blank)).alias("role"), F.when(~F.col("gone"), F.coalesce("text", blank)).alias("text"), "gone")
    dealt = rows.repartition("conv_id")  # serves the window as well
    number = F.row_number().over(W.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn")))
    dealt = dealt.withColumn("again", (number > 1) & ~F.col("gone"))
    return dealt.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "again").mapInArrow(run, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) with faults by a checksum of id and turn:
    of 20 parts one each is dropped, emptied, unpunctuated, repeated, and given to the user."""
    blank = F.lit(" ")
    text = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    code = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), code.alias("code"))
    rows = rows.withColumns({"role": F.when(F.col("code") == 4, "user").otherwise(F.col("role")), "text": F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")), "gone": F.col("code") == 0})
    rows = rows.withColumn("copy", F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select("conv_id", "turn", "role", "text", "gone")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")))
