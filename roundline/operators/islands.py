"""Runs, sessions and transitions along the time axis of a recording.

Every operator takes ``by`` (the recording) and ``t`` (the order) as column
names, shuffles once by ``by`` and runs inside one sorted window; a recording is
bounded by its length.  Null order values sort first.  Empty input: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import folds


def _over(by: str, t: str):
    return W.partitionBy(by).orderBy(t)


def marked_runs(df: DataFrame, value: Column, by: str = "stem", t: str = "t") -> DataFrame:
    """``df`` with ``run``: the number of the run of equal values (null equals null) it lies in."""
    w = _over(by, t)
    new = F.when(F.row_number().over(w) == 1, 1).otherwise((~value.eqNullSafe(F.lag(value).over(w))).cast("int"))
    return df.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def status_runs(reads: DataFrame, status: str, least: int = 18, by: str = "stem", t: str = "t", column: str = "method") -> DataFrame:
    """Runs of ``least`` or more readings in a row with one status: (by, start, last, n)."""
    runs = marked_runs(reads, F.col(column) == status, by, t).where(F.col(column) == status)
    return runs.groupBy(by, "run").agg(F.min(t).alias("start"), F.max(t).alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("run")


def gap_sessions(points: DataFrame, gap: float = 1.5, step: float = 0.0, by: str = "stem", t: str = "t", value: str = "prob") -> DataFrame:
    """Points no more than ``gap`` apart as sessions: (by, start, end, mean_value, n); the end gains ``step``."""
    w = _over(by, t)
    new = (F.col(t) - F.lag(t).over(w) > gap).cast("int")
    s = points.withColumn("__s", F.sum(F.coalesce(new, F.lit(1))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy(by, "__s").agg(F.min(t).alias("start"), (F.max(t) + step).alias("end"), F.avg(value).alias("mean_value"), F.count("*").alias("n")).drop("__s")


def complement(windows: DataFrame, totals: DataFrame, least: float = 5.0, by: str = "stem") -> DataFrame:
    """Time between windows (start, end) and up to ``duration``: (by, round_id, start, end), ``least`` long or more."""
    w = _over(by, "start")
    before = windows.select(by, F.lag("end", 1, 0.0).over(w).alias("s"), F.col("start").alias("e"))
    tail = windows.groupBy(by).agg(F.max("end").alias("s")).join(totals, by, "right").select(by, F.coalesce("s", F.lit(0.0)).alias("s"), F.col("duration").alias("e"))
    gaps = before.unionByName(tail).where(F.col("e") - F.col("s") >= least)
    return gaps.select(by, F.row_number().over(_over(by, "s")).cast("bigint").alias("round_id"), F.col("s").alias("start"), F.col("e").alias("end"))


def merged_windows(windows: DataFrame, gap: float = 3.0, by: str = "stem", kind: str = "kind", order: tuple[str, ...] = ("start",)) -> DataFrame:
    """Neighbouring windows of one kind, ``gap`` apart at most, as one: largest end and score."""
    w = W.partitionBy(by).orderBy(*order)
    open_ = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(F.lag(kind).over(w).eqNullSafe(F.col(kind)) & (F.col("start") - open_ <= gap), 0).otherwise(1)
    g = windows.withColumn("__n", new).withColumn("__g", F.sum("__n").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return g.groupBy(by, "__g").agg(F.first(kind).alias(kind), F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score"), F.count("*").alias("n")).drop("__g")


def thinned(events: DataFrame, gap: float = 3.0, by: str = "stem", t: str = "t") -> DataFrame:
    """Events more than ``gap`` after the last one kept, in time order."""

    def step(kept, row):
        return (row[0], [row]) if kept is None or row[0] - kept > gap else (kept, [])

    return folds.folded(events.select(by, F.col(t).cast("double").alias(t)).where(F.col(t).isNotNull()), by, [t], step, f"{by} string, {t} double")


def eliminated(state, t: float, s: str, active: int = 3, ended: int = 3, gap: float = 3.0):
    """One step of ``streak_ends``: (new state, ends found).  The state: active states
    in a row, length, kind and start of the streak of eliminations, whether this
    episode's end was given out, and the time of the last end kept."""
    live, gone, kind, since, waiting, kept = state or (0, 0, None, None, False, None)
    if s == "active":
        return (live + 1, 0, None, since, False, kept), []
    if s not in ("red_eliminated", "blue_eliminated"):
        return (0, 0, None, since, waiting, kept), []
    gone, since = (gone + 1, since) if s == kind else (1, t)
    if waiting or live < active or gone < ended:
        return (live, gone, s, since, waiting, kept), []
    if kept is not None and since - kept <= gap:
        return (0, gone, s, since, True, kept), []
    return (0, gone, s, since, True, since), [(since, s.removesuffix("_eliminated"))]


def streak_ends(states: DataFrame, active: int = 3, ended: int = 3, gap: float = 3.0, by: str = "stem", t: str = "t", state: str = "state") -> DataFrame:
    """Ends of rounds: an elimination seen ``ended`` times in a row after ``active``
    active states, once an episode, at the streak's start; ends within ``gap`` of
    the last one kept go.  (by, t, eliminated)

    The streak of active states survives other eliminations but no unknown state."""
    rows = states.select(by, F.col(t).cast("double").alias("t"), F.col(state).alias("state"))
    return folds.folded(rows, by, ["t", "state"], lambda held, row: eliminated(held, *row, active, ended, gap), f"{by} string, t double, eliminated string")


def confirmed_changes(reads: DataFrame, values: list[str], by: str = "stem", t: str = "t", least: int = 2, order: tuple[str, ...] = ()) -> DataFrame:
    """Changes of each of ``values`` between values seen ``least`` times in a row, nulls left out:
    (by, t_lo, t_hi, old, new, kind, side: the column's name).

    ``t_hi`` is the new run's first time, ``t_lo`` the last time before it that the old value was
    seen.  A fall is a ``reset``, a rise a ``win``.  All columns are running values over one order
    (``t``, then ``order``), so one sort serves them all; ``values`` have one type."""
    w = W.partitionBy(by).orderBy(t, *order)
    so_far, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    names = [(v, f"__{i}") for i, v in enumerate(values)]
    rows = reads.select(by, t, *order, *(F.col(v).alias(n) for v, n in names))
    was = lambda c, over: F.last(c, ignorenulls=True).over(over)
    # the reading's place among those with a value, and where its run began
    rows = rows.withColumns({f"{n}n": F.count(n).over(so_far) for _, n in names} | {f"{n}p": was(n, before) for _, n in names})
    new = {n: F.col(n).isNotNull() & ~F.col(n).eqNullSafe(F.col(f"{n}p")) for _, n in names}
    rows = rows.withColumns({f"{n}r": was(F.when(new[n], F.struct(F.col(f"{n}n").alias("n"), F.col(t).alias("t"))), so_far) for _, n in names})
    sure = {n: F.col(n).isNotNull() & (F.col(f"{n}n") - F.col(f"{n}r.n") + 1 == least) for _, n in names}
    rows = rows.withColumns({f"{n}s": was(F.when(sure[n], F.col(n)), so_far) for _, n in names} | {f"{n}o": was(F.when(sure[n], F.col(n)), before) for _, n in names})
    # sightings of the value that is sure
    rows = rows.withColumns({f"{n}l": was(F.when(F.col(n) == F.col(f"{n}s"), F.col(t)), before) for _, n in names})
    found = [F.when(sure[n] & (F.col(n) != F.col(f"{n}o")), F.struct(F.col(f"{n}l").alias("t_lo"), F.col(f"{n}r.t").alias("t_hi"), F.col(f"{n}o").alias("old"), F.col(n).alias("new"), F.when(F.col(n) > F.col(f"{n}o"), "win").otherwise("reset").alias("kind"), F.lit(v).alias("side"))) for v, n in names]
    return rows.select(by, F.explode(F.array_compact(F.array(*found))).alias("__c")).select(by, "__c.*")


def confirmed_transitions(reads: DataFrame, value: str, by: str = "stem", t: str = "t", least: int = 2) -> DataFrame:
    """``confirmed_changes`` of one value, without its side."""
    return confirmed_changes(reads, [value], by, t, least).drop("side")


def segments(boundaries: DataFrame, totals: DataFrame, least: float = 0.5, by: str = "stem", t: str = "t") -> DataFrame:
    """Pieces of [0, duration) between distinct boundaries: (by, seg, s, e).  A
    piece of ``least`` or less is dropped and its end still begins the next."""
    inside = boundaries.join(totals, by).where((F.col(t) > 0) & (F.col(t) < F.col("duration"))).select(by, F.col(t).alias("b")).distinct()
    ends = inside.unionByName(totals.select(by, F.col("duration").alias("b")))
    cut = ends.select(by, F.lag("b", 1, 0.0).over(_over(by, "b")).alias("s"), F.col("b").alias("e")).where(F.col("e") - F.col("s") > least)
    return cut.select(by, (F.row_number().over(_over(by, "s")) - 1).cast("bigint").alias("seg"), "s", "e")


def marked_false_zeros(reads: DataFrame, value: str = "k", name: str = "false_zero", within: float = 120.0, by: str = "stem", t: str = "t") -> DataFrame:
    """``reads`` with ``name``: a zero between a value and one that is not smaller, both
    within ``within`` seconds; the counter went on, so the zero was misread."""
    w = W.partitionBy(by).orderBy(t)
    some = F.when(F.col(value) > 0, F.struct(F.col(t).alias("t"), F.col(value).alias("v")))
    before = F.last(some, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    # a running frame in falling order: a frame to the end would be walked for every row
    falling = W.partitionBy(by).orderBy(F.desc(t)).rowsBetween(W.unboundedPreceding, -1)
    after = F.last(some, ignorenulls=True).over(falling)
    false = (F.col(value) == 0) & (F.col(t) - F.col("__b.t") <= within) & (F.col("__a.t") - F.col(t) <= within) & (F.col("__a.v") >= F.col("__b.v"))
    return reads.withColumns({"__b": before, "__a": after}).withColumn(name, F.coalesce(false, F.lit(False))).drop("__a", "__b")


def without_false_zeros(reads: DataFrame, value: str = "k", within: float = 120.0, by: str = "stem", t: str = "t") -> DataFrame:
    """``reads`` less the rows of ``marked_false_zeros``."""
    return marked_false_zeros(reads, value, "__false", within, by, t).where("not __false").drop("__false")


def first_change(reads: DataFrame, value: str = "d", least: int = 2, by: tuple[str, ...] = ("stem", "seg"), t: str = "t") -> DataFrame:
    """First time that a value seen ``least`` times or more differs from the first such value."""
    rows = reads.where(F.col(value).isNotNull()).withColumn("__n", F.count("*").over(W.partitionBy(*by, value))).where(F.col("__n") >= least)
    base = F.first(value).over(W.partitionBy(*by).orderBy(t).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("__base", base).where(F.col(value) != F.col("__base")).groupBy(*by).agg(F.min(t).alias("anomaly"))


def without_two_in_a_row(boundaries: DataFrame, wants_out: Column, breaks: Column, by: str = "stem", t: str = "t") -> DataFrame:
    """Drops boundaries that ``wants_out`` but never two in a row: odd places of
    each run of such boundaries go; one that ``breaks`` goes too and ends a run."""
    w = W.partitionBy(by).orderBy(t)
    out = F.coalesce(wants_out & ~breaks, F.lit(False))
    rows = boundaries.withColumns({"__out": out, "__breaks": F.coalesce(breaks, F.lit(False))})
    rows = marked_runs(rows, F.struct("__out", "__breaks"), by, t)
    place = F.row_number().over(W.partitionBy(by, "run").orderBy(t))
    return rows.withColumn("__p", place).where(~F.col("__breaks") & ~(F.col("__out") & (F.col("__p") % 2 == 1))).drop("__out", "__breaks", "__p", "run")


def assigned(reads: DataFrame, cut: DataFrame, by: str = "stem", t: str = "t") -> DataFrame:
    """Readings with their segment (s <= t < e) from a running count over the union
    of both: one shuffle and no range join.  A reading outside all segments goes."""
    left = reads.withColumns({"__side": F.lit(1), "__t": F.col(t)})
    right = cut.select(by, F.col("s").alias("__t"), F.lit(0).alias("__side"), F.struct("seg", "s", "e").alias("__cut"))
    both = left.unionByName(right, allowMissingColumns=True)
    w = W.partitionBy(by).orderBy("__t", "__side").rowsBetween(W.unboundedPreceding, 0)
    held = both.withColumn("__cut", F.last("__cut", ignorenulls=True).over(w)).where("__side = 1").where(F.col(t) < F.col("__cut.e"))
    return held.select(*reads.columns, "__cut.seg", F.col("__cut.s").alias("seg_start"), F.col("__cut.e").alias("seg_end"))
