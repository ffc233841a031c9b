"""Joins of intervals and points within a recording.

Each join is keyed by the recording and by time buckets: both sides are dealt to
the buckets that they touch, so a long recording spreads over tasks and pairs
far apart never meet; a pair is made once, in the first bucket that both touch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import folds


def _bucketed(df: DataFrame, lo: Column, hi: Column, width: float, name: str) -> DataFrame:
    first = F.floor(lo / width)
    return df.withColumn(f"__first_{name}", first).withColumn("__bucket", F.explode(F.sequence(first, F.greatest(first, F.floor(hi / width)))))


def overlapping(left: DataFrame, right: DataFrame, l1: str, l2: str, r1: str, r2: str, tolerance: float = 0.0, by: str = "stem", width: float = 256.0, how: str = "inner") -> DataFrame:
    """Pairs whose closed intervals meet within ``tolerance``; ``how`` inner or left.
    Column names of the two sides must differ, but for ``by``.  Intervals with a
    null end meet nothing."""
    a = _bucketed(left.where(F.col(l1).isNotNull() & F.col(l2).isNotNull()), F.col(l1) - tolerance, F.col(l2) + tolerance, width, "l")
    b = _bucketed(right.where(F.col(r1).isNotNull() & F.col(r2).isNotNull()), F.col(r1), F.col(r2), width, "r")
    pairs = a.join(b, [by, "__bucket"]).where((F.col(l1) - tolerance <= F.col(r2)) & (F.col(r1) <= F.col(l2) + tolerance))
    pairs = pairs.where(F.col("__bucket") == F.greatest("__first_l", "__first_r")).drop("__bucket", "__first_l", "__first_r")
    if how == "inner":
        return pairs
    mine = [F.col(c) for c in left.columns]
    found = pairs.select(*left.columns).distinct()
    rest = left.join(found.select(*(F.col(c).alias(f"__{c}") for c in left.columns)), [c.eqNullSafe(F.col(f"__{n}")) for c, n in zip(mine, left.columns, strict=True)], "left_anti")
    return pairs.unionByName(rest, allowMissingColumns=True)


def near_points(anchors: DataFrame, points: DataFrame, before: float, after: float, by: str = "stem", t: str = "t", p: str = "p", width: float = 256.0) -> DataFrame:
    """``anchors`` with ``n_near``: points in [t - before, t + after], from one
    running count over the union of both (no range join).

    The count up to the interval's end less the count before its start; three
    rows for each anchor, whatever the number of points."""
    key = F.struct(*(F.col(c) for c in anchors.columns))
    lo = anchors.select(by, (F.col(t) - before).alias("__at"), F.lit(0).alias("__order"), key.alias("__key"), F.lit(-1).alias("__sign"), F.lit(0).alias("__one"))
    hi = anchors.select(by, (F.col(t) + after).alias("__at"), F.lit(2).alias("__order"), key.alias("__key"), F.lit(1).alias("__sign"), F.lit(0).alias("__one"))
    at = points.select(by, F.col(p).alias("__at"), F.lit(1).alias("__order"), F.lit(None).cast(anchors.select(key.alias("k")).schema["k"].dataType).alias("__key"), F.lit(0).alias("__sign"), F.lit(1).alias("__one"))
    w = W.partitionBy(by).orderBy("__at", "__order").rowsBetween(W.unboundedPreceding, 0)
    counted = lo.unionByName(hi).unionByName(at).withColumn("__n", F.sum("__one").over(w)).where("__sign <> 0")
    return counted.groupBy("__key").agg((F.max(F.when(F.col("__sign") == 1, F.col("__n"))) - F.max(F.when(F.col("__sign") == -1, F.col("__n")))).alias("n_near")).select("__key.*", "n_near")


def latest_before(points: DataFrame, events: DataFrame, furthest: float, nearest: float, by: str = "stem", t: str = "t", e: str = "e") -> DataFrame:
    """``points`` with the latest event in [t - furthest, t - nearest]: an as-of join
    from a union and a running last value."""
    left = points.withColumns({"__at": F.col(t) - nearest, "__side": F.lit(1)})
    right = events.select(by, F.col(e).alias("__at"), F.lit(0).alias("__side"), F.struct(*(F.col(c) for c in events.columns if c != by)).alias("__event"))
    w = W.partitionBy(by).orderBy("__at", "__side").rowsBetween(W.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True).withColumn("__event", F.last("__event", ignorenulls=True).over(w)).where("__side = 1")
    fresh = F.when(F.col(f"__event.{e}") >= F.col(t) - furthest, F.col("__event"))
    return both.withColumn("__event", fresh).select(*points.columns, "__event.*")


def nearest_middle(left: DataFrame, right: DataFrame, by: str = "stem", m: str = "m", id_col: str = "d") -> DataFrame:
    """``left`` (by, m, ...) with ``gap`` and ``id_col`` of the nearest row of ``right``
    (by, m, id_col) by middle, the smaller id of equally near ones: two running
    values over the union of both."""
    points = right.groupBy(by, F.col(m).alias("__at")).agg(F.min(id_col).alias("__id")).select(by, "__at", F.lit(1).alias("__side"), F.struct(F.col("__at").alias("m"), F.col("__id").alias("id")).alias("__p"))
    both = left.withColumns({"__at": F.col(m), "__side": F.lit(0)}).unionByName(points, allowMissingColumns=True)
    # a point at the same place comes first going up, and counts once
    up = W.partitionBy(by).orderBy("__at", F.desc("__side")).rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(by).orderBy(F.desc("__at"), "__side").rowsBetween(W.unboundedPreceding, 0)
    near = both.withColumns({"__lo": F.last("__p", ignorenulls=True).over(up), "__hi": F.last("__p", ignorenulls=True).over(down)}).where("__side = 0")
    lo, hi = (F.struct(F.abs(F.col(m) - F.col(f"{c}.m")).alias("gap"), F.col(f"{c}.id").alias("id")) for c in ("__lo", "__hi"))
    best = F.least(F.when(F.col("__lo").isNotNull(), lo), F.when(F.col("__hi").isNotNull(), hi))
    return near.withColumn("__b", best).select(*left.columns, F.col("__b.gap").alias("gap"), F.col("__b.id").alias(id_col))


def greedy_matches(truth: DataFrame, found: DataFrame, tolerance: float = 15.0, by: str = "stem") -> DataFrame:
    """One-to-one matches: each true span (g1, g2) in order of ``idx`` takes the first
    unused detection (d1, d2) in order of ``idx`` that meets it within the
    tolerance.  (by, idx, hit: the detection's idx or null)

    Only candidate lists are gathered, one a true span; they are walked in order."""
    pairs = overlapping(truth.select(by, F.col("idx").alias("g"), "g1", "g2"), found.select(by, F.col("idx").alias("d"), "d1", "d2"), "g1", "g2", "d1", "d2", tolerance)
    lists = pairs.groupBy(by, "g").agg(F.sort_array(F.collect_list("d")).alias("cands"))

    def step(used, row):
        g, cands = row
        used = set() if used is None else used
        hit = next((d for d in cands if d not in used), None)
        if hit is not None:
            used.add(hit)
        return used, [(g, hit)]

    hits = folds.folded(lists, by, ["g"], step, f"{by} string, idx long, hit long")
    return truth.select(by, "idx").join(hits, [by, "idx"], "left")
