"""Connected components of large edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, folder: str) -> DataFrame:
    """Stars (a, b) of ``edges`` (a, b long, not null): each node a that is not
    the smallest of its component, with that smallest node b.

    Large-star and small-star rounds (Kiveris et al. 2014); each round is a
    written table in ``folder``, which must be shared, so a lost executor costs
    one round at most.  Smallest neighbours are sums of partial minima; no
    neighbour list is gathered."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{folder}/edges-0")
    state, turn = _state(now), 0
    while True:
        turn += 1
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.distinct(), f"{folder}/large-{turn}")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.union(low).distinct(), f"{folder}/edges-{turn}")
        before, state = state, _state(now)
        if state == before:
            return now
