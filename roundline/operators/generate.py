"""Row generators and samples: windows, grids, even and seeded picks.

All are projections with ``explode(sequence)`` but for the even sample, which
numbers the rows of each recording in one window.  Null durations give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _steps(df: DataFrame, last: Column) -> DataFrame:
    """``i`` from 0 to ``last``; no row where it is negative or null."""
    return df.where(last >= 0).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))))


def sliding(totals: DataFrame, length: float = 12.0, stride: float = 6.0, slack: float = 0.01) -> DataFrame:
    """Windows of ``length`` every ``stride`` that end by ``duration``."""
    rows = _steps(totals, F.floor((F.col("duration") + slack - length) / stride))
    return rows.select("stem", (F.col("i") * stride).alias("start"), (F.col("i") * stride + length).alias("end"))


def chunks(totals: DataFrame, length: float = 12.0, slack: float = 0.05, cap: int = 10_000) -> DataFrame:
    """Windows of ``length`` without gaps; a rest of half a window or more is one too."""
    last = F.least(F.floor((F.col("duration") + slack - length / 2) / length), F.lit(cap - 1))
    rows = _steps(totals, last)
    return rows.select("stem", (F.col("i") * length).alias("start"), F.least(F.col("i") * length + length, "duration").alias("end"))


def sample_times(spans: DataFrame, per_second: float, start: str = "start", end: str = "last") -> DataFrame:
    """Half-open grid over each span; its middle if the grid is empty."""
    n = F.ceil((F.col(end) - F.col(start)) * per_second)
    rows = _steps(spans.withColumn("__n", n), F.greatest(F.col("__n"), F.lit(1)) - 1)
    at = F.when(F.col("__n") == 0, (F.col(start) + F.col(end)) / 2).otherwise(F.col(start) + F.col("i") / per_second)
    return rows.select("stem", start, at.alias("at"))


def grid(totals: DataFrame, n: int, head: float = 60.0, share: float = 0.05, tail: float = 30.0) -> DataFrame:
    """``n`` times spread evenly from the end of the head to the start of the tail."""
    first = F.least(F.lit(head), F.col("duration") * share)
    rows = _steps(totals, F.lit(n - 1))
    return rows.select("stem", "i", F.round(first + F.col("i") * (F.col("duration") - tail - first) / max(1, n - 1), 6).alias("at"))


def even_sample(df: DataFrame, n: int, by: str = "stem", order: str = "t") -> DataFrame:
    """``n`` rows spread evenly over each recording (half-even rounding); all, if fewer."""
    w = W.partitionBy(by)
    rows = df.withColumns({"__i": F.row_number().over(w.orderBy(order)) - 1, "__m": F.count("*").over(w)})
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.bround(j * (F.col("__m") - 1) / max(1, n - 1), 0).cast("bigint"))
    return rows.where((F.col("__m") <= n) | F.array_contains(picks, F.col("__i").cast("bigint"))).drop("__i", "__m")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int, tie: str) -> DataFrame:
    """``n`` rows in the order of a digest of seed and key: the same at every partitioning."""
    return df.orderBy(F.sha1(F.concat(F.lit(f"{seed}|"), F.col(key)).cast("binary")), tie).limit(n)


def repeated(df: DataFrame, times: Column) -> DataFrame:
    """Each row ``times`` times, numbered from 1 in ``copy``."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
