"""Streaming queries over the events table, and the batch tracker and repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import guards
from ..operators import repair, tracker
from ..sources import adapters as A
from ..sources import files
from ..streaming import live
from . import judging, sequences
from .base import plan


@plan("e17_tracker")
def tracked(spark, sf_dir):
    return tracker.tracked(A.hud_reads(spark, sf_dir))


def _kills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracked(spark, sf_dir).where("kind = 'kill'").select("stem", "t", F.col("old").alias("from_k"), F.col("new").alias("to_k"))


@plan("e18_skip_repair")
def skip_repair(spark, sf_dir):
    # each is used several times: written once
    b = files.written(sequences.runs(spark, sf_dir).select("stem", ((F.col("start") + F.col("last")) / 2).alias("t")), "edges")
    reads = files.written(A.hud_reads(spark, sf_dir).where("k in (7, 9) or method = 'template_miss'").select("stem", "rn", "t", "k", "method"), "sightings")
    gaps = files.written(repair.gap_starts(A.hud_reads(spark, sf_dir)), "gaps")
    kills = files.written(repair.split_skips(files.written(_kills(spark, sf_dir), "kills"), reads, b, gaps), "split")
    return repair.injected(kills, reads, b, gaps)


@plan("e19_kill_attribution")
def kill_attribution(spark, sf_dir):
    return repair.attributed(judging.kill_events(spark, sf_dir).drop("seg"), sequences.cut(spark, sf_dir), A.hud_reads(spark, sf_dir))


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream with (stem, t, ts) and fixture channels."""
    schema = A.table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    kind, i = F.col("event_type"), F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    k = F.when(kind == "view", F.expr("event_id div 400"))
    method = F.when(kind == "error", "row_miss").otherwise("template")
    return e.select(A.stem("user_id", A.USERS).alias("stem"), (F.unix_micros(ts) / 1440e6).alias("t"), ts.alias("ts"), k.alias("k"), (0.5 + (i % 50) / 100).alias("conf"), method.alias("method"), F.expr("(event_id div 240) % 6").alias("red"), F.expr("(event_id div 360) % 6").alias("blue"), F.least(F.lit(1.0), F.col("value") / 100).alias("prob"))


def _live(name: str, make) -> None:
    plan(name)(lambda spark, sf_dir: live.drained(spark, make(stream(spark, sf_dir)), files.scratch(spark, name)))


_live("l1_live_transitions", lambda s: live.transitions(s, "red"))
_live("l2_live_eliminations", lambda s: live.eliminations(s.withColumn("state", guards.elimination_state(F.col("red"), F.col("blue")))))
_live("l3_live_tracker", live.tracked)
_live("l4_live_sessions", lambda s: live.sessions(s, "2 hours", "1 hour"))
_live("l5_live_runs", lambda s: live.boundary_runs(s, "row_miss", 2))
