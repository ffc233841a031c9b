"""Sources and sinks: written from the given tables and read back."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..operators import islands, replay
from ..sources import adapters as A
from ..sources import files, signal_source
from . import judging, sequences
from .base import plan


@plan("a1_a2_signal_cache", views="hud", sql="SELECT stem, row_number() OVER (PARTITION BY stem ORDER BY t, rn) - 1 AS i, CAST(printf('%.3f', t) AS DOUBLE) AS t, k, CAST(printf('%.3f', conf) AS DOUBLE) AS conf, method, d, a FROM hud")
def signal_cache(spark, sf_dir):
    path = files.scratch(spark, "signals")
    files.write_signal_cache(A.hud_reads(spark, sf_dir), path)
    return files.read_signal_cache(spark, path)


@plan("a3_a13_timelines")
def timelines(spark, sf_dir):
    path = files.scratch(spark, "timelines")
    files.write_timelines(judging.verdicts(spark, sf_dir), path)
    return files.read_timelines(spark, path)


@plan("a4_truth_map", views="gt", sql="SELECT stem, g1, g2, true AS source_available FROM gt")
def truth_map(spark, sf_dir):
    path = files.scratch(spark, "truths")
    files.write_truths(A.truths(spark, sf_dir), path)
    return files.read_truths(spark, path)


@plan("a5_baseline", views="gt", sql="SELECT concat(stem, '|', idx) AS gt_key, CASE WHEN idx % 3 > 0 THEN concat('R', idx % 90) END AS hit FROM gt")
def baseline(spark, sf_dir):
    path = files.scratch(spark, "baseline")
    hit = F.when(F.col("idx") % 3 > 0, F.concat(F.lit("R"), (F.col("idx") % 90).cast("string")))
    files.write_baseline(A.truths(spark, sf_dir).select(F.concat_ws("|", "stem", F.col("idx").cast("string")).alias("gt_key"), hit.alias("hit")), path)
    return files.read_baseline(spark, path)


@plan("a6_a7_optional_channels", views="hud score", sql=", s AS (SELECT stem, count(red) AS n FROM score WHERE stem < 'v00009' GROUP BY stem) SELECT h.stem, count(*) AS reads, any_value(s.n) AS score_reads, any_value(s.n) IS NOT NULL AS active FROM hud h LEFT JOIN s ON s.stem = h.stem GROUP BY h.stem")
def optional_channels(spark, sf_dir):
    """A recording without the channel keeps null: the feature is off."""
    s = A.score_reads(spark, sf_dir).where("stem < 'v00009'").groupBy("stem").agg(F.count("red").alias("score_reads"))
    h = A.hud_reads(spark, sf_dir).groupBy("stem").agg(F.count("*").alias("reads"))
    return h.join(s, "stem", "left").withColumn("active", F.col("score_reads").isNotNull())


@plan("a8_a9_span_tables", views="det", sql="SELECT stem, CAST(printf('%.3f', d1 / 7) AS DOUBLE) AS start_sec, CAST(printf('%.3f', d2 / 7) AS DOUBLE) AS end_sec FROM det WHERE idx % 11 > 0 AND CAST(printf('%.3f', d2 / 7) AS DOUBLE) > CAST(printf('%.3f', d1 / 7) AS DOUBLE)")
def span_tables(spark, sf_dir):
    path = files.scratch(spark, "spans")
    d = A.detections(spark, sf_dir)
    end = F.when(F.col("idx") % 11 == 0, F.lit("bad")).otherwise(F.format_string("%.3f", F.col("d2") / 7))
    files.write_table(d.select("stem", (F.col("d1") / 7).alias("start_sec"), end.alias("end_sec")), path, {"start_sec": 3})
    return files.read_spans(spark, path)


@plan("a10_list_file", sql="SELECT DISTINCT concat('src ', source) AS value FROM documents WHERE source > 'src4'")
def list_file(spark, sf_dir):
    path = files.scratch(spark, "list")
    s = A.table(spark, sf_dir, "documents").select("source").distinct()
    s.select(F.when(F.col("source") > "src4", F.concat(F.lit(" src "), F.col("source"))).otherwise(F.concat(F.lit("# "), F.col("source"))).alias("value")).write.text(path)
    return files.read_list(spark, path)


@plan("a11_timeline_text", views="det", sql="""SELECT CASE idx % 4 WHEN 0 THEN 'range' WHEN 1 THEN 'instant' WHEN 2 THEN 'range' END AS kind,
 CASE WHEN idx % 4 < 3 THEN CAST(idx % 50 * 60 + 5 AS DOUBLE) END AS start_sec, CASE idx % 4 WHEN 0 THEN CAST(idx % 50 * 60 + 42 AS DOUBLE) WHEN 1 THEN CAST(idx % 50 * 60 + 5 AS DOUBLE) WHEN 2 THEN CAST(idx % 50 * 60 + 2 AS DOUBLE) END AS end_sec,
 CASE WHEN idx % 4 < 3 THEN 'all kill' END AS label, CASE idx % 4 WHEN 2 THEN 'ends before it begins' WHEN 3 THEN 'unreadable' END AS warning FROM det""")
def timeline_text(spark, sf_dir):
    path = files.scratch(spark, "lines")
    i, m = F.col("idx"), (F.col("idx") % 50).cast("string")
    line = F.when(i % 4 == 0, F.concat(m, F.lit(":05 - "), m, F.lit(":42 all kill"))).when(i % 4 == 1, F.concat(m, F.lit(":05 all kill"))).when(i % 4 == 2, F.concat(m, F.lit(":05 ~ "), m, F.lit(":02 all kill"))).otherwise("kills all")
    A.detections(spark, sf_dir).select(line.alias("value")).write.text(path)
    return files.read_timeline_text(spark, path)


@plan("a16_run_summary", views="hud", sql="SELECT CASE WHEN hits < 90 THEN 'short' ELSE 'ok' END AS status, count(*) AS runs, CAST(sum(hits) AS BIGINT) AS hits FROM (SELECT stem, count(k) AS hits FROM hud GROUP BY stem) GROUP BY 1")
def run_summary(spark, sf_dir):
    c = sequences.read_counters(spark, sf_dir)
    return c.groupBy(F.when(F.col("hits") < 90, "short").otherwise("ok").alias("status")).agg(F.count("*").alias("runs"), F.sum("hits").alias("hits"))


@plan("a20_identities", sql="SELECT source AS stem, CASE WHEN n % 2 = 0 THEN concat('name', n) ELSE '' END AS nickname, CAST(CASE WHEN n % 3 = 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS confidence, CASE WHEN n % 5 = 0 THEN 'direct' ELSE 'unknown' END AS mode, n AS samples FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def identities(spark, sf_dir):
    path = files.scratch(spark, "identities")
    s = A.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("stem")).agg(F.count("*").alias("samples"))
    n = F.col("samples")
    s.select("stem", F.when(n % 2 == 0, F.concat(F.lit("name"), n.cast("string"))).alias("nickname"), F.when(n % 3 == 0, 0.5).alias("confidence"), F.when(n % 5 == 0, "direct").alias("mode"), "samples").write.json(path)
    return files.read_identities(spark, path)


@plan("a12_media_inventory")
def media_inventory(spark, sf_dir):
    """The files of the given tables, as a recording folder is listed; contents are not read."""
    return files.media_inventory(spark, sf_dir, ("parquet",)).groupBy("name").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


@plan("a14_write_guard", views="hud", sql="SELECT stem, count(*) AS reads, true AS refused FROM hud GROUP BY stem")
def write_guard(spark, sf_dir):
    """A table written once, read back after a second write was refused."""
    path = f"{files.scratch(spark, 'guard')}/reads"
    n = A.hud_reads(spark, sf_dir).groupBy("stem").agg(F.count("*").alias("reads"))
    files.write_table(n, path)
    try:
        files.write_table(n, path)
        refused = False
    except AnalysisException:
        refused = True
    return spark.read.option("header", True).schema("stem string, reads long").csv(path).withColumn("refused", F.lit(refused))


@plan("a1_a2_signal_source", views="hud", sql="SELECT concat(stem, '.json') AS file, stem, 2 AS version, row_number() OVER (PARTITION BY stem ORDER BY t, rn) - 1 AS i, round(t, 3) AS t, k, round(conf, 3) AS conf, CASE WHEN method = 'click' THEN 'click' ELSE method END AS method, d, a FROM hud")
def signal_documents(spark, sf_dir):
    """Readings written as documents and read back through the data source."""
    path = files.scratch(spark, "documents")
    signal_source.write_signals(A.hud_reads(spark, sf_dir), path)
    return signal_source.read_signals(spark, path).select("file", "stem", "version", "i", "t", "k", "conf", "method", "d", "a")


@plan("a15_a18_incremental_replay", views="hud", sql=sequences.RUNS + ", m2 AS (SELECT median(CAST(stem[2:] AS BIGINT)) AS m FROM (SELECT DISTINCT stem FROM hud)) SELECT runs.*, CASE WHEN CAST(stem[2:] AS BIGINT) <= m THEN 1 ELSE 2 END AS run FROM runs, m2")
def incremental_replay(spark, sf_dir):
    """A first run over the older half of the recordings, a second over all: the results of the
    first half are still those of the first run."""
    folder = files.scratch(spark, "replay")
    reads = A.hud_reads(spark, sf_dir)
    number = F.substring("stem", 2, 20).cast("bigint")
    older = reads.select("stem").distinct().agg(F.median(number)).first()[0]
    compute = lambda rows: islands.status_runs(rows, "row_miss", sequences.MIN_RUN)
    if older is not None:
        replay.replayed(reads.where(number <= older), compute, folder)
    return replay.replayed(reads, compute, folder)
