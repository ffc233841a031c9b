"""Rounds and verdicts from readings, and the flagship job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import guards, times
from ..operators import islands, settle
from ..sources import adapters as A
from ..sources import files
from . import sequences
from .base import plan


def rounds(spark: SparkSession, sf_dir: str, cut: DataFrame | None = None) -> DataFrame:
    return settle.settled_rounds(A.hud_reads(spark, sf_dir), sequences.cut(spark, sf_dir) if cut is None else cut)


plan("e12_best_chain")(lambda spark, sf_dir: settle.chains(A.hud_reads(spark, sf_dir), sequences.cut(spark, sf_dir)))
plan("e13_settled_rounds")(rounds)


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds with first and last kill, the ace verdict, and its revocation where
    all kills share one instant and two or more score events fall in the round."""
    cut = files.written(sequences.cut(spark, sf_dir), "segments")  # used twice, a few rows a recording
    r = rounds(spark, sf_dir, cut)
    kt = F.col("kill_times")
    judged = r.withColumns({"first_kill": F.get(kt, F.lit(0)), "ace_sec": F.get(kt, F.lit(2)), "ace": guards.is_ace(F.col("kills"), F.col("reset").cast("int"), kt, F.col("k_samples")), "width_zero": guards.is_width_zero(kt)})
    wins = sequences.score_events(spark, sf_dir).where("kind = 'win'").select("stem", F.col("t_hi").alias("t"))
    n = islands.assigned(wins, cut).groupBy("stem", "seg").agg(F.count("*").alias("wins"))
    both = judged.join(n, ["stem", "seg"], "left").withColumn("wins", F.coalesce("wins", F.lit(0)))
    revoked = F.col("ace") & F.col("width_zero") & (F.col("wins") >= 2)
    return both.withColumns({"end_reason": F.when(revoked, "score_wins_split").otherwise("boundary"), "ace": F.col("ace") & ~revoked})


plan("e14_e15_verdicts")(verdicts)


@plan("e14_kill_events")
def kill_events(spark, sf_dir):
    """One row a kill with the counter before and after it."""
    k = rounds(spark, sf_dir).select("stem", "seg", F.coalesce("k_base", F.lit(0)).alias("base"), F.posexplode("kill_times").alias("i", "t"))
    return k.select("stem", "seg", "t", (F.col("base") + F.col("i")).alias("from_k"), (F.col("base") + F.col("i") + 1).alias("to_k"))


@plan("a17_timeline_report")
def timeline_report(spark, sf_dir):
    """One text line a recording."""
    v = verdicts(spark, sf_dir)
    line = F.format_string("R%02d %s kills=%d%s", F.col("seg"), times.mss(F.col("s")), F.col("kills"), F.when(F.col("ace"), " ACE").otherwise(""))
    return v.groupBy("stem").agg(F.sort_array(F.collect_list(F.struct("seg", line.alias("line")))).alias("x")).select("stem", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("report"))


@plan("a18_replay_clips")
def replay_clips(spark, sf_dir):
    """Clip windows of all rounds with kills, from stored readings alone."""
    s, e = guards.ace_window(F.col("s"), F.col("e"), F.col("first_kill"), F.col("ace_sec"))
    return verdicts(spark, sf_dir).where("kills > 0").select("stem", "seg", "ace", s.alias("clip_start"), e.alias("clip_end"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay: stored readings to judged rounds."""
    return verdicts(spark, sf_dir).select("stem", "seg", "s", "e", "k_base", "k_start", "k_end", "kills", "reset", "k_samples", "first_kill", "ace_sec", "ace", "end_reason")
