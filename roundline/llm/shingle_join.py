"""Near copies by the Jaccard similarity of their word shingles.

The SimHash operator's form for a similarity: two texts link when their sets of
five-word shingles have a Jaccard similarity of 0.8 or more.  Texts of equal sets
make a class.

1. Classes whose SimHash fingerprints link (``simhash.links``: pivot tables) are
   verified on their whole sets.  That joins most copies, groups of thousands
   among them, without making their pairs.
2. At 0.8 two fingerprints differ in about ten of 64 bits, beyond what any filter
   on distances to pivots can tell from chance, so the rest comes from an exact
   prefix filter: with all shingles in one fixed order, two linked sets share
   ``SHARED`` of the first ``n - ceil(0.8 n) + SHARED`` shingles of each, so grouping
   classes by these heads loses no link.  Pairs whose sizes or places in the heads
   rule out 0.8 are dropped, all others are verified on the whole sets.  Heads of at
   most ``SMALL`` classes, nearly all there are, hand on the classes that may have a
   partner, no more rows than came.  These are dealt by a head's smallest class, which
   near copies have in common under most of their heads: a task makes each of its pairs
   once and counts their heads, and pairs of fewer than ``SHARED`` are dropped.

The order puts shingles that are frequent in a sample last (at most
``FREQUENT`` of them, rarest first), so that common passages seldom head a
text.  It is a matter of speed alone: any order finds the same links.

Larger groups are settled without making all their pairs: each class outside a group's
largest component is held against a few classes of other components and about its size,
found links are joined to components, and only pairs of different components that were
not yet tested are left.  Once these are few, or after ``TURNS`` turns, all of them are
made in tasks that hold a group, or two chunks of a very large one, and send each pair
once; so the turns save pairs and lose no link.

Shingles are XXH64 hashes; sets are compared by their lower 32 bits, so a pair
counts one shingle too many with a chance of about n * n / 2^32.
Null or wordless texts are one class.  Null id: has a component, but is never
its smallest id.  Repeated rows: one row each.  Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import simhash
from .common import joined_to_one, scratch, tidy, written
from .graph import components
from .simhash import SEED, shingles
from .textops import U64, Words, column_bytes, mix, text_blocks, xxh64

SHINGLE = 5
#: the least similarity as a fraction of integers, so that comparisons are exact
OVER, UNDER = 4, 5
FREQUENT = 100_000
SAMPLE_ROWS = 20_000
SAMPLE_SHARE = 1 / 32
#: turns in which classes meet partners, the partners of a size, and the step from one size to the next (a log)
TURNS, PARTNERS, STEP = 2, 24, 0.05
#: classes of one head whose pairs are made at once
SMALL = 32
#: heads that two linked sets share; different sets of fewer than four shingles do not link
SHARED = 3
_FLUSH = 500_000
#: comparisons a row at which the rest of a turn is tested whole
FEW = 64
#: rows of a group that one task holds against others
CHUNK = 65_536
#: pairs that a task verifies at once
_PAIRS = 64


def _sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): each text's distinct shingles in ascending order."""
    words = Words(texts, lower=True)
    start, end, first = shingles(words, size)
    hashes, owner = xxh64(words.buf, start, end, SEED), np.repeat(np.arange(len(texts)), np.diff(first))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def _classes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One number for each set: equal sets have equal numbers."""
    sums = np.concatenate((np.zeros(1, dtype=U64), np.cumsum(mix(hashes ^ U64(0x9E3779B97F4A7C15)), dtype=U64)))
    return mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(U64)).view(np.int64)


def _frequent(docs: DataFrame, size: int, text_col: str) -> np.ndarray:
    """Shingles that repeat in a sample of texts, rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_blocks(column_bytes(batch.column(0))):
                yield pa.RecordBatch.from_arrays([pa.array(_sets(texts, size)[0].view(np.int64))], names=["token"])

    share = max(SAMPLE_SHARE, min(1.0, SAMPLE_ROWS / max(1, docs.count())))
    picked = docs.where(F.pmod(F.xxhash64(text_col, F.lit(SEED)), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else docs
    counts = picked.select(text_col).mapInArrow(tidy(run), "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    rows = counts.orderBy(F.desc("n"), "token").limit(FREQUENT).select("token").toArrow()
    return rows.column(0).to_numpy()[::-1].copy()


def prints(docs: DataFrame, frequent: np.ndarray, size: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tie, cls, n, fp, head) of every text: hash of text, class, number of
    shingles, SimHash fingerprint of the shingles and the heads."""
    by_value = np.argsort(frequent)
    values = frequent[by_value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_blocks(column_bytes(batch.column(1))):
                hashes, first = _sets(texts, size)
                tokens, n = hashes.view(np.int64), np.diff(first)
                rank = np.zeros(len(tokens), dtype=np.int64)
                if len(values):
                    i = np.minimum(np.searchsorted(values, tokens), len(values) - 1)
                    rank = np.where(values[i] == tokens, by_value[i] + 1, 0)
                owner = np.repeat(np.arange(len(texts)), n)
                order = np.lexsort((tokens, rank, owner))
                least = (OVER * n + UNDER - 1) // UNDER
                length = n - least + np.minimum(least, SHARED)
                heads = tokens[order][np.arange(len(tokens)) - first[:-1][owner] < length[owner]]
                bounds = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
                fp = simhash.majority(hashes, first).view(np.int64)
                own = [batch.column(i).slice(at, len(texts)) for i in (0, 2)]
                columns = [*own, pa.array(_classes(hashes, first)), pa.array(n.astype(np.int32)), pa.array(fp), pa.ListArray.from_arrays(pa.array(bounds), pa.array(heads))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tie", "cls", "n", "fp", "head"])

    return docs.select(F.col(id_col).cast("long"), text_col, F.xxhash64(text_col)).mapInArrow(tidy(run), "doc_id long, tie long, cls long, n int, fp long, head array<long>")


def _room(n: np.ndarray, pos: np.ndarray, m: np.ndarray, at: np.ndarray, shared: int = 1) -> np.ndarray:
    """Whether sizes and places of a head, one of the first ``shared`` in common, leave room
    for the least similarity."""
    return (np.minimum(n - pos, m - at) + shared - 1) * (OVER + UNDER) >= (n + m) * OVER


def _groups(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, size) of the groups of equal sorted tokens."""
    first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    return first, np.diff(np.concatenate((first, [len(token)])))


def _beside(i: np.ndarray, of: np.ndarray, n: np.ndarray, pos: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row of ``i`` with the later ones of its small group for which there is room."""
    step = 0
    while len(i):
        step += 1
        i = i[i + step < len(of)]
        i = i[of[i + step] == of[i]]
        good = i[_room(n[i], pos[i], n[i + step], pos[i + step], SHARED)]
        yield good, good + step


class _Pairs:
    """Pairs of a task with their numbers, smaller class first, given out once each as far as it holds them."""

    def __init__(self):
        self._parts: list[np.ndarray] = []

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        self._parts.append(np.stack((np.minimum(x, y), np.maximum(x, y), np.ones(len(x), dtype=np.int64)), axis=1))
        if self.full:  # what repeats takes no room
            self._parts = [self._once()]

    @property
    def full(self) -> bool:
        return sum(map(len, self._parts)) >= _FLUSH

    def _once(self) -> np.ndarray:
        rows = np.concatenate(self._parts) if self._parts else np.zeros((0, 3), dtype=np.int64)
        if not len(rows):
            return rows
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        first = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1))))
        return np.concatenate((rows[first, :2], np.add.reduceat(rows[:, 2:], first)), axis=1)

    def taken(self, last: bool) -> np.ndarray:
        """All pairs (a, b, number); none where they are few and more come."""
        rows, self._parts = self._once(), []
        if not last and len(rows) < _FLUSH // 2:
            self._parts, rows = [rows], rows[:0]
        return rows


class _Heads:
    """Rows sorted by token: all of groups of over ``small`` rows, and of the others those
    that may have a partner, with the smallest class of them."""

    def __init__(self, small: int):
        self._small = small
        self._held: pa.Table | None = None  # the last group, which may go on
        self._large: int | None = None

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if batch.num_rows:
            t = pa.Table.from_batches([batch] if self._held is None else [*self._held.to_batches(), batch])
            yield from self._take(t, False)

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self._held is not None:
            yield from self._take(self._held, True)

    def _take(self, t: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        token, cls, n, pos = (t.column(i).to_numpy() for i in range(4))
        first, size = _groups(token)
        of = np.repeat(np.arange(len(first)), size)
        large = size > self._small
        large[0] |= token[0] == self._large
        self._held = None
        if not last and not large[-1]:
            self._held, size = t.slice(first[-1]).combine_chunks(), np.concatenate((size[:-1], [0]))
        self._large = int(token[-1]) if large[-1] else None
        big = large[of]
        if big.any():
            yield _rows(token[big], cls[big], n[big], pos[big], None)
        some = np.zeros(len(of), dtype=bool)
        for i, j in _beside(np.flatnonzero(~big & (size[of] > 1)), of, n, pos):
            some[i] = some[j] = True
        if some.any():
            start, kept = _groups(token[some])
            yield _rows(token[some], cls[some], n[some], pos[some], np.repeat(np.minimum.reduceat(cls[some], start), kept))


def _rows(token: np.ndarray, cls: np.ndarray, n: np.ndarray, pos: np.ndarray, lead: np.ndarray | None) -> pa.RecordBatch:
    last = pa.nulls(len(cls), pa.int64()) if lead is None else pa.array(lead)
    return pa.RecordBatch.from_arrays([pa.array(token), pa.array(cls), pa.array(n), pa.array(pos), last], names=["token", "cls", "n", "pos", "lead"])


def _met(heads: DataFrame) -> DataFrame:
    """Rows (token, cls, n, pos, lead) of heads of many classes, with null leads, and of
    the others the classes that may have a partner, with the smallest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _Heads(SMALL)
        for batch in batches:
            yield from groups.add(batch)
        yield from groups.finish()

    return heads.repartition("token").sortWithinPartitions("token").mapInArrow(tidy(run), "token long, cls long, n int, pos int, lead long")


def _close_pairs(met: DataFrame) -> DataFrame:
    """Distinct possible pairs (a < b) from the rows (token, cls, n, pos, lead) of small
    groups: those with room under ``SHARED`` tokens.  A pair of fewer is no link unless the
    others are tokens of larger groups, so it stays where both classes have such."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pairs = None, _Pairs()

        def settle(t: pa.Table) -> None:
            token, cls, n, pos = (t.column(i).to_numpy() for i in range(4))
            first, size = _groups(token)
            for i, j in _beside(np.arange(len(token)), np.repeat(np.arange(len(first)), size), n, pos):
                pairs.add(cls[i], cls[j])

        def given(last: bool) -> pa.RecordBatch:
            both = pairs.taken(last)
            return pa.RecordBatch.from_arrays([pa.array(both[:, i]) for i in range(3)], names=["a", "b", "k"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            cut = _groups(t.column(0).to_numpy())[0][-1]  # the last group may go on
            if cut:
                settle(t.slice(0, cut))
                if pairs.full:
                    yield given(False)
            held = t.slice(cut).combine_chunks()
        if held is not None:
            settle(held)
        yield given(True)

    made = met.where("lead is not null").select("token", "cls", "n", "pos", "lead").repartition("lead").sortWithinPartitions("lead", "token").drop("lead")
    counts = made.mapInArrow(tidy(run), "a long, b long, k long").groupBy("a", "b").agg(F.sum("k").alias("k"))
    often = met.where("lead is null").select("cls").distinct()
    for c in "ab":
        counts = counts.join(often.select(F.col("cls").alias(c), F.lit(True).alias(f"often_{c}")), c, "left")
    return counts.where((F.col("k") >= SHARED) | (F.col("often_a") & F.col("often_b"))).select("a", "b")


def _sets_of(docs: DataFrame, wanted: DataFrame, size: int, text_col: str) -> DataFrame:
    """(cls, grams): the sets of the wanted classes, as ascending 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_blocks(column_bytes(batch.column(0))):
                hashes, first = _sets(texts, size)
                low = hashes.astype(np.uint32)
                grams = [np.sort(low[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(_classes(hashes, first)), pa.array(grams, pa.binary())], names=["cls", "grams"])

    found = docs.select(text_col).mapInArrow(tidy(run), "cls long, grams binary")
    return found.groupBy("cls").agg(F.first("grams").alias("grams")).join(wanted, "cls", "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _PAIRS):
                part, good = batch.slice(lo, _PAIRS), []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    u, v = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                    both = np.concatenate((u, v))
                    both.sort(kind="stable")
                    overlap = int(np.count_nonzero(both[1:] == both[:-1]))
                    good.append((OVER + UNDER) * overlap >= OVER * (len(u) + len(v)))
                yield part.select([0, 1]).filter(pa.array(good, pa.bool_()))

    # the sets of these pairs alone, by broadcast of their classes where Spark finds them few
    ends = pairs.select(F.col("a").alias("cls")).distinct().union(pairs.select("b").distinct())
    own = sets.join(ends, "cls", "left_semi")
    a, b = (own.select(F.col("cls").alias(c), F.col("grams").alias(f"grams_{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "grams_a", "grams_b").mapInArrow(tidy(run), "a long, b long")


def _partner_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """Distinct possible pairs (a < b) of each class outside its group's main component with a
    few classes of other components and of about its size (others each turn), in the group
    whose shingle comes first in it: late shingles leave no room for the least similarity."""
    size = F.floor(F.log(F.greatest("n", F.lit(1))) / STEP)
    order = F.row_number().over(W.partitionBy("cls").orderBy("pos", "token"))
    outer = rows.where("root <> main").withColumn("place", order).where("place = 1")
    outer = outer.select("cls", "token", "n", "pos", "root").withColumn("size", F.explode(F.array(size - 1, size, size + 1)))
    inner = rows.where((OVER + UNDER) * F.col("pos") <= F.col("n")).select("token", size.alias("size"), F.col("cls").alias("c"), F.col("n").alias("m"), F.col("pos").alias("p"), F.col("root").alias("r"))
    inner = inner.withColumn("place", F.row_number().over(W.partitionBy("token", "size").orderBy(F.xxhash64("c", F.lit(turn)), "c"))).where(F.col("place") <= PARTNERS)
    met = outer.join(inner, ["token", "size"]).where("root <> r")
    room = F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("p")) * (OVER + UNDER) >= (F.col("n") + F.col("m")) * OVER
    return met.where(room).select(F.least("cls", "c").alias("a"), F.greatest("cls", "c").alias("b")).distinct()


def _all_pairs(rows: DataFrame) -> DataFrame:
    """Distinct possible pairs (a < b) of different components under one token, from
    rows (token, cls, n, pos, root, main, all): each row outside its group's main
    component against the others of the group."""
    chunks = F.ceil(F.col("all") / CHUNK).cast("int")
    own = rows.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))
    met = own.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    names = ["token", "lo", "hi"]
    dealt = met.select("token", F.least("chunk", "with").alias("lo"), F.greatest("chunk", "with").alias("hi"), "chunk", "cls", "n", "pos", "root", "main")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pairs = None, _Pairs()

        def settle(t: pa.Table) -> None:
            lo, hi = t.column(1)[0].as_py(), t.column(2)[0].as_py()
            chunk, cls, n, pos, root, main = (t.column(i).to_numpy() for i in range(3, 9))
            out = np.flatnonzero(root != main)
            for at in range(0, len(out), 256):
                i = out[at : at + 256, None]
                good = (root[i] != root[None, :]) & _room(n[i], pos[i], n[None, :], pos[None, :])
                x, y = np.nonzero(good & (chunk[i] != chunk[None, :]) if lo != hi else good)
                pairs.add(cls[i[x, 0]], cls[y])

        def given(last: bool) -> pa.RecordBatch:
            both = pairs.taken(last)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            key = np.stack([t.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for a, b in zip(np.concatenate(([0], cut[:-1])), cut, strict=False):
                settle(t.slice(a, b - a).combine_chunks())
                if pairs.full:
                    yield given(False)
            held = t.slice(cut[-1] if len(cut) else 0)
        if held is not None:
            settle(held.combine_chunks())
        yield given(True)

    return dealt.repartition(*names).sortWithinPartitions(*names).mapInArrow(tidy(run), "a long, b long").distinct()


def _alike_prints(classes: DataFrame, folder: str) -> DataFrame:
    """Pairs (a < b) of ``classes`` (cls, fp) that a spanning forest of the
    fingerprints' links makes: each class with its fingerprint's first, and the
    firsts of two linked fingerprints."""
    prints = written(classes.groupBy("fp").agg(F.min("cls").alias("one"), F.count(F.lit(1)).alias("n")), f"{folder}/fp")
    own = joined_to_one(classes.select("cls", "fp"), prints, "fp").select("cls", "one")
    a, b = (prints.select(F.col("fp").alias(c), F.col("one").alias(f"one_{c}")) for c in "ab")
    edges = simhash.links(prints, folder).join(a, "a").join(b, "b").select("one_a", "one_b")
    both = own.union(edges).toDF("x", "y").where("x <> y")
    return written(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{folder}/alike")


def links(classes: DataFrame, docs: DataFrame, folder: str, size: int = SHINGLE, text_col: str = "text") -> DataFrame:
    """Stars (a, b) of the components of ``classes`` (cls, n, fp, head)."""
    heads = classes.select("cls", "n", F.posexplode("head").alias("pos", "token")).select("token", "cls", "n", "pos")
    met = written(_met(heads), f"{folder}/met")
    near = _close_pairs(met)
    tested = written(_alike_prints(classes, folder).union(near).distinct(), f"{folder}/pairs-0")
    large = met.where("lead is null").drop("lead")
    wanted = large.select("cls").distinct().union(tested.select("a").distinct()).union(tested.select("b").distinct()).distinct()
    sets = written(_sets_of(docs, wanted, size, text_col), f"{folder}/sets")
    stars, turn = components(written(_verified(tested, sets), f"{folder}/links-0"), f"{folder}/stars-0"), 0
    while True:
        turn += 1
        rooted = large.join(stars.select(F.col("a").alias("cls"), F.col("b").alias("root")), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        # only groups of several components are left
        sizes = rooted.groupBy("token", "root").agg(F.count(F.lit(1)).alias("m"))
        several = sizes.groupBy("token").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.max("m").alias("most"), F.sum("m").alias("all"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
        rows = written(rooted.join(several.drop("kinds"), "token"), f"{folder}/left-{turn}")
        n, cost = rows.agg(F.count(F.lit(1)), F.sum(F.when(F.col("root") != F.col("main"), F.col("all").cast("double")))).first()
        if not n:
            return stars
        whole = turn > TURNS or cost <= FEW * n
        pairs = _all_pairs(rows) if whole else _partner_pairs(rows, turn)
        pairs = written(pairs.join(tested, ["a", "b"], "left_anti"), f"{folder}/pairs-{turn}")
        tested = tested.union(pairs)
        found = written(_verified(pairs, sets), f"{folder}/links-{turn}")
        stars = components(stars.union(found), f"{folder}/stars-{turn}")
        if whole:
            return stars


def near_copies(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row (doc_id, tie, component, component_id): hash of text, the component's
    number, and the smallest id that links reach."""
    folder = scratch(docs.sparkSession, "shingles")
    found = written(prints(docs, _frequent(docs, size, text_col), size, id_col, text_col), f"{folder}/prints")
    classes = found.groupBy("cls").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("head").alias("head"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    classes = written(classes, f"{folder}/classes")
    stars = links(classes.select("cls", "n", "fp", "head"), docs, folder, size, text_col)
    rooted = classes.select("cls", "first", F.col("rows").alias("n")).join(stars.select(F.col("a").alias("cls"), F.col("b").alias("root")), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(rooted.join(smallest, "root").select("cls", "n", F.col("root").alias("component"), "component_id"), f"{folder}/named")
    return joined_to_one(found.select("doc_id", "tie", "cls"), named, "cls").select("doc_id", "tie", "component", "component_id")


def one_of_each(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly one row of each group of near copies: that of smallest id (null last)
    and smallest hash of text, with all its columns."""
    spark = docs.sparkSession
    found = written(near_copies(docs, size, id_col, text_col), f"{scratch(spark, 'copies')}/found")
    key = [F.coalesce(F.col("doc_id"), F.lit(0).cast("long")).alias("__id"), F.col("doc_id").isNull().alias("__none"), F.col("tie").alias("__tie")]
    best = found.select("component", *key).groupBy("component").agg(F.min(F.struct("__none", "__id", "__tie")).alias("k"))
    kept = best.select("k.*")
    number = F.col(id_col).cast("long")
    own = docs.withColumns({"__id": F.coalesce(number, F.lit(0).cast("long")), "__none": number.isNull(), "__tie": F.xxhash64(text_col)})
    names = ["__id", "__none", "__tie"]
    # rows that share id and text: one of them
    again = found.select(*key).groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    if not again.limit(1).count():
        return own.join(kept, names, "left_semi").select(docs.columns)
    once = own.join(kept.join(again, names, "left_anti"), names, "left_semi")
    several = own.join(kept.join(again, names, "left_semi"), names, "left_semi").dropDuplicates(names)
    return once.unionByName(several).select(docs.columns)
