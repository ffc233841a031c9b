"""Repair of counter events around a value that cannot be read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import islands


def gap_starts(reads: DataFrame) -> DataFrame:
    """(stem, gap): first times of runs of missed readings."""
    runs = islands.marked_runs(reads, F.col("method") == "template_miss").where(F.col("method") == "template_miss")
    return runs.groupBy("stem", "run").agg(F.min("t").alias("gap")).select("stem", "gap")


def split_skips(kills: DataFrame, reads: DataFrame, boundaries: DataFrame, gaps: DataFrame | None = None, low: int = 7) -> DataFrame:
    """Kills (stem, t, from_k, to_k) in which a step of two from ``low`` hides an
    unreadable value: where a boundary lies between the last sighting of ``low``
    and the kill, the first half moves to the last run of misses before the
    boundary.  Other kills stay as they are.

    Only such steps are joined; a recording bounds all lists.  ``gaps``: ``gap_starts`` of
    the readings, where they are at hand."""
    skip = kills.where((F.col("from_k") == low) & (F.col("to_k") == low + 2)).select("stem", "t")
    seen = reads.where(F.col("k") == low).select("stem", F.col("t").alias("x"))
    last = skip.join(seen, "stem").where("x < t").groupBy("stem", "t").agg(F.max("x").alias("seen"))
    edge = last.join(boundaries.select("stem", F.col("t").alias("b")), "stem").where("b > seen and b < t").groupBy("stem", "t", "seen").agg(F.min("b").alias("b"))
    hidden = edge.join(gap_starts(reads) if gaps is None else gaps, "stem").where("gap > seen and gap < b").groupBy("stem", "t").agg(F.max("gap").alias("gap"))
    both = kills.join(hidden.withColumns({"from_k": F.lit(low).cast("bigint"), "to_k": F.lit(low + 2).cast("bigint")}), ["stem", "t", "from_k", "to_k"], "left")
    step = lambda t, a, b: F.struct(t.alias("t"), F.lit(a).cast("bigint").alias("from_k"), F.lit(b).cast("bigint").alias("to_k"))
    same = F.struct("t", "from_k", "to_k")
    made = F.when(F.col("gap").isNull(), F.array(same)).otherwise(F.array(step(F.col("gap"), low, low + 1), step(F.col("t"), low + 1, low + 2)))
    return both.select("stem", F.explode(made).alias("e")).select("stem", "e.*")


def injected(kills: DataFrame, reads: DataFrame, boundaries: DataFrame, gaps: DataFrame | None = None, low: int = 7) -> DataFrame:
    """Kills and, where one reaches ``low`` and the next starts above the unreadable
    value after it, two more: to the unreadable value and to the one above it.

    The upper one is at the first reading of that value after the kill (until a
    second after the next kill, whose time it has if there is none); the lower one
    at a run of misses between: the last one before the first boundary there, else
    the first.  Without such a run nothing is added."""
    w = W.partitionBy("stem").orderBy("t", "to_k")
    pair = kills.withColumns({"next_t": F.lead("t").over(w), "next_k": F.lead("from_k").over(w)}).where((F.col("to_k") == low) & (F.col("next_k") >= low + 2)).select("stem", "t", "next_t")
    seen = reads.where((F.col("k") == low + 2) & (F.col("method") == "template")).select("stem", F.col("t").alias("x"))
    first = pair.join(seen, "stem", "left").groupBy("stem", "t", "next_t").agg(F.min(F.when((F.col("x") > F.col("t")) & (F.col("x") <= F.col("next_t") + 1.0), F.col("x"))).alias("x"))
    upper = first.select("stem", "t", F.coalesce("x", "next_t").alias("upper"))
    edge = upper.join(boundaries.select("stem", F.col("t").alias("b")), "stem", "left").groupBy("stem", "t", "upper").agg(F.min(F.when((F.col("b") > F.col("t")) & (F.col("b") < F.col("upper")), F.col("b"))).alias("b"))
    found = edge.join(gap_starts(reads) if gaps is None else gaps, "stem").where("gap > t and gap < upper").groupBy("stem", "t", "upper").agg(F.max(F.when(F.col("gap") < F.col("b"), F.col("gap"))).alias("before"), F.min("gap").alias("first"))
    number = lambda n: F.lit(n).cast("bigint")
    lower = found.select("stem", F.coalesce("before", "first").alias("t"), number(low).alias("from_k"), number(low + 1).alias("to_k"))
    above = found.select("stem", F.col("upper").alias("t"), number(low + 1).alias("from_k"), number(low + 2).alias("to_k"))
    return kills.select("stem", "t", "from_k", "to_k").unionByName(lower).unionByName(above)


def attributed(kills: DataFrame, cut: DataFrame, reads: DataFrame, grace: float = 10.0, most: int = 2) -> DataFrame:
    """Kills with the segment they belong to: one or two kills within ``grace`` after
    a boundary are the segment's before it, if the old value was seen there and
    not between the boundary and the kill."""
    placed = islands.assigned(kills, cut)
    before = cut.select("stem", (F.col("seg") + 1).alias("seg"), F.col("s").alias("before_start"))
    late = placed.join(before, ["stem", "seg"], "left")
    seen = reads.where("method = 'template'").select("stem", F.col("k").alias("from_k"), F.col("t").alias("x"))
    near = late.where((F.col("t") - F.col("seg_start") <= grace) & (F.col("t") > F.col("seg_start")) & (F.col("to_k") - F.col("from_k") <= most) & F.col("before_start").isNotNull())
    counts = near.join(seen, ["stem", "from_k"]).groupBy("stem", "t", "from_k", "to_k").agg(F.count_if((F.col("x") > F.col("before_start")) & (F.col("x") < F.col("seg_start"))).alias("a"), F.count_if((F.col("x") > F.col("seg_start")) & (F.col("x") < F.col("t"))).alias("b"))
    moved = counts.where("a > 0 and b = 0").select("stem", "t", "from_k", "to_k", F.lit(1).alias("back")).distinct()
    return late.join(moved, ["stem", "t", "from_k", "to_k"], "left").select("stem", "t", "from_k", "to_k", (F.col("seg") - F.coalesce("back", F.lit(0))).alias("seg"))
