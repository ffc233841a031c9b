"""Runs, sessions, transitions and neighbours along the time axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import guards
from ..operators import islands
from ..sources import adapters as A
from .base import plan

#: fixture densities: shorter runs and wider gaps than the defaults
MIN_RUN, GAP, DURATION = 3, 5.0, 1800.0

RUNS = """, m AS (SELECT stem, rn, t, method = 'row_miss' AS miss FROM hud),
 g AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY rn) - row_number() OVER (PARTITION BY stem, miss ORDER BY rn) AS run FROM m),
 runs AS (SELECT stem, min(t) AS start, max(t) AS last, count(*) AS n FROM g WHERE miss GROUP BY stem, run HAVING count(*) >= 3)"""
SEGMENTS = RUNS + """, stems AS (SELECT DISTINCT stem FROM hud), b AS (SELECT DISTINCT stem, (start + last) / 2 AS b FROM runs WHERE (start + last) / 2 > 0 AND (start + last) / 2 < 1800),
 ends AS (SELECT * FROM b UNION ALL SELECT stem, 1800.0::DOUBLE FROM stems),
 cuts AS (SELECT stem, lag(b, 1, 0) OVER (PARTITION BY stem ORDER BY b) AS s, b AS e FROM ends),
 segs AS (SELECT stem, row_number() OVER (PARTITION BY stem ORDER BY s) - 1 AS seg, s, e FROM cuts WHERE e - s > 0.5)"""
IN_SEGMENTS = SEGMENTS + ", ins AS (SELECT h.*, g2.seg, g2.s, g2.e FROM hud h JOIN segs g2 ON g2.stem = h.stem AND h.t >= g2.s AND h.t < g2.e)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.status_runs(A.hud_reads(spark, sf_dir), "row_miss", MIN_RUN)


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.hud_reads(spark, sf_dir).select("stem").distinct().withColumn("duration", F.lit(DURATION))


def cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    middle = runs(spark, sf_dir).select("stem", ((F.col("start") + F.col("last")) / 2).alias("t"))
    return islands.segments(middle, totals(spark, sf_dir))


def in_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.assigned(A.hud_reads(spark, sf_dir), cut(spark, sf_dir))


@plan("d1_read_counters", views="hud", sql="SELECT stem, count(k) AS hits, count(*) FILTER (k IS NULL AND method IN ('template_miss', 'triple_incomplete')) AS misses, count(*) FILTER (k IS NULL AND method = 'row_miss') AS row_misses FROM hud GROUP BY stem")
def read_counters(spark, sf_dir):
    none = F.col("k").isNull()
    return A.hud_reads(spark, sf_dir).groupBy("stem").agg(F.count("k").alias("hits"), F.count_if(none & F.col("method").isin("template_miss", "triple_incomplete")).alias("misses"), F.count_if(none & (F.col("method") == "row_miss")).alias("row_misses"))


plan("e1_rowmiss_runs", views="hud", sql=RUNS + " SELECT * FROM runs")(runs)
plan("e9_segments", views="hud", sql=SEGMENTS + " SELECT * FROM segs")(cut)


@plan("c5_reads_by_segment", views="hud", sql=IN_SEGMENTS + " SELECT stem, seg, s, e, count(k) AS k_samples, count(*) AS n FROM ins GROUP BY stem, seg, s, e")
def reads_by_segment(spark, sf_dir):
    return in_segments(spark, sf_dir).groupBy("stem", "seg", F.col("seg_start").alias("s"), F.col("seg_end").alias("e")).agg(F.count("k").alias("k_samples"), F.count("*").alias("n"))


@plan("d2_support_filter", views="hud", sql=IN_SEGMENTS + ", x AS (SELECT *, count(*) OVER (PARTITION BY stem, seg, k) AS n, max(conf) OVER (PARTITION BY stem, seg, k) AS c FROM ins WHERE k IS NOT NULL) SELECT stem, rn, seg, k FROM x WHERE n >= 2 OR c >= 0.88")
def support_filter(spark, sf_dir):
    from ..operators import settle

    return settle.supported(in_segments(spark, sf_dir).where("k is not null")).select("stem", "rn", "seg", "k")


_SESSIONS = """, p AS (SELECT stem, t, prob FROM probs WHERE prob >= 0.6), n AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY stem ORDER BY t) <= 5 THEN 0 ELSE 1 END AS new FROM p),
 s AS (SELECT *, sum(new) OVER (PARTITION BY stem ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM n),
 sessions AS (SELECT stem, min(t) AS start, max(t) + 0.5 AS end, round(avg(prob), 9) AS mean_value, count(*) AS n FROM s GROUP BY stem, g)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = islands.gap_sessions(A.frame_probs(spark, sf_dir).where("prob >= 0.6"), GAP, 0.5)
    return found.withColumn("mean_value", F.round("mean_value", 9))


plan("e2_gap_sessions", views="probs", sql=_SESSIONS + " SELECT * FROM sessions")(sessions)


@plan("e3_long_sessions", views="probs", sql=_SESSIONS + " SELECT stem, count(*) FILTER (\"end\" - start >= 3.5) AS kept, count(*) FILTER (\"end\" - start < 3.5) AS dropped FROM sessions GROUP BY stem")
def long_sessions(spark, sf_dir):
    long = F.col("end") - F.col("start") >= 3.5
    return sessions(spark, sf_dir).groupBy("stem").agg(F.count_if(long).alias("kept"), F.count_if(~long).alias("dropped"))


@plan("e4_complement", views="probs", sql=_SESSIONS + """, w AS (SELECT stem, start, "end" FROM sessions WHERE "end" - start >= 3.5),
 x AS (SELECT stem, lag("end", 1, 0) OVER (PARTITION BY stem ORDER BY start) AS s, start AS e FROM w UNION ALL
  SELECT d.stem, coalesce(m, 0), 1800.0 FROM (SELECT DISTINCT stem FROM probs) d LEFT JOIN (SELECT stem, max("end") AS m FROM w GROUP BY stem) z ON z.stem = d.stem)
SELECT stem, row_number() OVER (PARTITION BY stem ORDER BY s) AS round_id, CAST(s AS DOUBLE) AS start, CAST(e AS DOUBLE) AS "end" FROM x WHERE e - s >= 5""")
def complement(spark, sf_dir):
    return islands.complement(sessions(spark, sf_dir).where("end - start >= 3.5"), totals(spark, sf_dir))


@plan("e5_merged_windows", views="det", sql=""", x AS (SELECT stem, CASE WHEN idx % 2 = 0 THEN 'a' ELSE 'b' END AS kind, d1 AS start, d1 + 6 AS "end", CAST(idx % 100 AS DOUBLE) AS score, idx FROM det),
 y AS (SELECT *, CASE WHEN lag(kind) OVER w = kind AND start - max("end") OVER (PARTITION BY stem ORDER BY start, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 3 THEN 0 ELSE 1 END AS new FROM x WINDOW w AS (PARTITION BY stem ORDER BY start, idx)),
 z AS (SELECT *, sum(new) OVER (PARTITION BY stem ORDER BY start, idx ROWS UNBOUNDED PRECEDING) AS g FROM y)
SELECT stem, kind, min(start) AS start, max("end") AS "end", max(score) AS score, count(*) AS n FROM z GROUP BY stem, g, kind""")
def merged_windows(spark, sf_dir):
    d = A.detections(spark, sf_dir)
    w = d.select("stem", F.when(F.col("idx") % 2 == 0, "a").otherwise("b").alias("kind"), F.col("d1").alias("start"), (F.col("d1") + 6).alias("end"), (F.col("idx") % 100).cast("double").alias("score"), "idx")
    return islands.merged_windows(w, order=("start", "idx"))


@plan("e6_thinned_events", views="probs", sql=""", p AS MATERIALIZED (SELECT stem, t FROM probs WHERE prob >= 0.6),
 k(stem, t) AS (SELECT stem, min(t) FROM p GROUP BY stem UNION ALL SELECT k.stem, min(p.t) FROM k JOIN p ON p.stem = k.stem AND p.t - k.t > 3 GROUP BY k.stem)
SELECT stem, t FROM k""")
def thinned(spark, sf_dir):
    return islands.thinned(A.frame_probs(spark, sf_dir).where("prob >= 0.6"))


@plan("e7_streak_ends", views="score", sql=""", s AS MATERIALIZED (SELECT stem, t, row_number() OVER (PARTITION BY stem ORDER BY t) AS r, CASE WHEN red IS NULL OR blue IS NULL THEN 'unknown' WHEN red = 0 AND blue > 0 THEN 'red_eliminated' WHEN blue = 0 AND red > 0 THEN 'blue_eliminated' WHEN red > 0 AND blue > 0 THEN 'active' ELSE 'unknown' END AS s FROM score),
 f(stem, r, live, gone, kind, since, waiting, kept, hit) AS (SELECT DISTINCT stem, 0::BIGINT, 0, 0, NULL::VARCHAR, NULL::DOUBLE, false, NULL::DOUBLE, false FROM s UNION ALL
  SELECT stem, r, CASE WHEN s = 'active' THEN live + 1 WHEN fire OR s = 'unknown' THEN 0 ELSE live END, g, CASE WHEN lost THEN s END, since2, CASE WHEN s = 'active' THEN false ELSE waiting OR fire END, CASE WHEN hit THEN since2 ELSE kept END, hit FROM (
   SELECT *, fire AND (kept IS NULL OR since2 - kept > 3) AS hit FROM (SELECT *, lost AND NOT waiting AND live >= 3 AND g >= 3 AS fire FROM (
    SELECT s.stem, s.r, s.s, f.live, f.waiting, f.kept, s.s LIKE '%eliminated' AS lost, CASE WHEN s.s NOT LIKE '%eliminated' THEN 0 WHEN f.kind = s.s THEN f.gone + 1 ELSE 1 END AS g,
     CASE WHEN s.s LIKE '%eliminated' AND f.kind IS DISTINCT FROM s.s THEN s.t ELSE f.since END AS since2 FROM f JOIN s ON s.stem = f.stem AND s.r = f.r + 1))))
SELECT stem, since AS t, replace(kind, '_eliminated', '') AS eliminated FROM f WHERE hit""")
def streak_ends(spark, sf_dir):
    s = A.score_reads(spark, sf_dir)
    return islands.streak_ends(s.withColumn("state", guards.elimination_state(F.col("red"), F.col("blue"))))


_TRANSITIONS = """, v{x} AS (SELECT stem, t, rn, {x} AS v FROM score WHERE {x} IS NOT NULL), g{x} AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY t, rn) - row_number() OVER (PARTITION BY stem, v ORDER BY t, rn) AS g FROM v{x}),
 r{x} AS (SELECT stem, v, min(t) AS f, max(t) AS l, count(*) AS n FROM g{x} GROUP BY stem, v, g), s{x} AS (SELECT *, lag(v) OVER (PARTITION BY stem ORDER BY f) AS p FROM r{x} WHERE n >= 2),
 e{x} AS (SELECT stem, (SELECT max(o.t) FROM v{x} o WHERE o.stem = s{x}.stem AND o.v = s{x}.p AND o.t < s{x}.f) AS t_lo, f AS t_hi, p AS old, v AS new, CASE WHEN v > p THEN 'win' ELSE 'reset' END AS kind, '{x}' AS side FROM s{x} WHERE p IS NOT NULL AND p <> v)"""
EVENTS = _TRANSITIONS.format(x="red") + _TRANSITIONS.format(x="blue") + ", events8 AS (SELECT * FROM ered UNION ALL SELECT * FROM eblue)"


def score_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.confirmed_changes(A.score_reads(spark, sf_dir), ["red", "blue"], order=("rn",))


plan("e8_transitions", views="score", sql=EVENTS + " SELECT * FROM events8")(score_events)


@plan("e10_zero_quarantine", views="hud", sql=""", r AS (SELECT stem, rn, t, k FROM hud WHERE k IS NOT NULL),
 p AS (SELECT r.*, (SELECT max(t) FROM r o WHERE o.stem = r.stem AND o.k > 0 AND o.t < r.t) AS bt, (SELECT min(t) FROM r o WHERE o.stem = r.stem AND o.k > 0 AND o.t > r.t) AS ft FROM r),
 q AS (SELECT p.stem, p.rn, p.k, k = 0 AND t - bt <= 120 AND ft - t <= 120 AND (SELECT k FROM r o WHERE o.stem = p.stem AND o.t = p.ft) >= (SELECT k FROM r o WHERE o.stem = p.stem AND o.t = p.bt) AS out FROM p)
SELECT stem, rn, k FROM q WHERE NOT coalesce(out, false)""")
def zero_quarantine(spark, sf_dir):
    return islands.without_false_zeros(A.hud_reads(spark, sf_dir).where("k is not null")).select("stem", "rn", "k")


@plan("e11_first_change", views="hud", sql=IN_SEGMENTS + """, x AS (SELECT stem, seg, t, d, count(*) OVER (PARTITION BY stem, seg, d) AS n FROM ins WHERE d IS NOT NULL),
 y AS (SELECT *, first_value(d) OVER (PARTITION BY stem, seg ORDER BY t) AS base FROM x WHERE n >= 2)
SELECT stem, seg, min(t) AS anomaly FROM y WHERE d <> base GROUP BY stem, seg""")
def first_change(spark, sf_dir):
    return islands.first_change(in_segments(spark, sf_dir))


@plan("e16_boundary_gate", views="hud score", sql=RUNS + EVENTS + """, b AS (SELECT stem, (start + last) / 2 AS t, CAST(floor(start) AS BIGINT) % 7 = 0 AS bad, NOT EXISTS (SELECT 1 FROM events8 e WHERE e.stem = runs.stem AND e.kind = 'win' AND e.t_hi BETWEEN (runs.start + runs.last) / 2 - 28 AND (runs.start + runs.last) / 2 + 24) AS lone FROM runs),
 c AS (SELECT *, CASE WHEN bad THEN 2 WHEN lone THEN 1 ELSE 0 END AS c FROM b),
 d AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY t) - row_number() OVER (PARTITION BY stem, c ORDER BY t) AS g FROM c),
 f AS (SELECT *, row_number() OVER (PARTITION BY stem, c, g ORDER BY t) AS p FROM d)
SELECT stem, t FROM f WHERE c = 0 OR (c = 1 AND p % 2 = 0)""")
def boundary_gate(spark, sf_dir):
    from ..operators import intervals

    b = runs(spark, sf_dir).select("stem", ((F.col("start") + F.col("last")) / 2).alias("t"), (F.floor("start") % 7 == 0).alias("bad"))
    near = intervals.near_points(b, score_events(spark, sf_dir).where("kind = 'win'").select("stem", F.col("t_hi").alias("p")), before=28.0, after=24.0)
    return islands.without_two_in_a_row(near, F.col("n_near") == 0, F.col("bad")).select("stem", "t")


@plan("e21_play_gap", views="det", sql="SELECT stem, idx, greatest(0, d1 - lag(d2, 1, 0) OVER (PARTITION BY stem ORDER BY d1, idx)) AS gap FROM det")
def play_gap(spark, sf_dir):
    w = W.partitionBy("stem").orderBy("d1", "idx")
    return A.detections(spark, sf_dir).select("stem", "idx", F.greatest(F.lit(0.0), F.col("d1") - F.lag("d2", 1, 0.0).over(w)).alias("gap"))


@plan("d11_upper_median_gap", views="det", sql=""", g AS (SELECT stem, d1 - lag(d2) OVER (PARTITION BY stem ORDER BY d1, idx) AS gap FROM det), s AS (SELECT stem, list(gap ORDER BY gap) FILTER (gap > 0) AS v FROM g GROUP BY stem)
SELECT stem, coalesce(v[len(v) // 2 + 1], 45) AS median_gap FROM s""")
def upper_median_gap(spark, sf_dir):
    w = W.partitionBy("stem").orderBy("d1", "idx")
    g = A.detections(spark, sf_dir).select("stem", (F.col("d1") - F.lag("d2").over(w)).alias("gap"))
    v = F.sort_array(F.collect_list(F.when(F.col("gap") > 0, F.col("gap"))))
    return g.groupBy("stem").agg(v.alias("v")).select("stem", F.coalesce(F.get("v", F.expr("size(v) div 2")), F.lit(45.0)).alias("median_gap"))


@plan("e22_e23_neighbours", views="hud", sql=IN_SEGMENTS + """, k AS (SELECT stem, seg, max(k) - min(k) AS kills FROM ins GROUP BY stem, seg)
SELECT stem, seg, coalesce(lag(kills, 1, -1) OVER w, -1) AS before, coalesce(lead(kills, 1, -1) OVER w, -1) AS after, seg / CAST(count(*) OVER (PARTITION BY stem) AS DOUBLE) AS position FROM k WINDOW w AS (PARTITION BY stem ORDER BY seg)""")
def neighbours(spark, sf_dir):
    w = W.partitionBy("stem").orderBy("seg")
    k = in_segments(spark, sf_dir).groupBy("stem", "seg").agg((F.max("k") - F.min("k")).alias("kills"))
    side = lambda f: F.coalesce(f("kills", 1, -1).over(w), F.lit(-1).cast("bigint"))
    return k.select("stem", "seg", side(F.lag).alias("before"), side(F.lead).alias("after"), (F.col("seg") / F.count("*").over(W.partitionBy("stem"))).alias("position"))


@plan("e24_null_streaks", views="hud", sql=""", g AS (SELECT stem, rn, k IS NULL AS miss, row_number() OVER (PARTITION BY stem ORDER BY rn) - row_number() OVER (PARTITION BY stem, k IS NULL ORDER BY rn) AS run FROM hud)
SELECT stem, min(rn) AS first_rn, count(*) AS n FROM g WHERE miss GROUP BY stem, run HAVING count(*) >= 3""")
def null_streaks(spark, sf_dir):
    none = F.col("k").isNull()
    r = islands.marked_runs(A.hud_reads(spark, sf_dir), none, t="rn").where(none)
    return r.groupBy("stem", "run").agg(F.min("rn").alias("first_rn"), F.count("*").alias("n")).where("n >= 3").drop("run")


@plan("e25_forward_fill", views="hud", sql="SELECT stem, rn, last_value(d IGNORE NULLS) OVER (PARTITION BY stem ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM hud")
def forward_fill(spark, sf_dir):
    w = W.partitionBy("stem").orderBy("rn").rowsBetween(W.unboundedPreceding, -1)
    return A.hud_reads(spark, sf_dir).select("stem", "rn", F.last("d", ignorenulls=True).over(w).alias("previous"))


@plan("c19_previous_confirmed", views="hud", sql="SELECT stem, seg, max(k) AS k, last_value(max(k) IGNORE NULLS) OVER (PARTITION BY stem ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM (SELECT stem, rn // 25 AS seg, CASE WHEN (rn // 25) % 3 > 0 THEN k END AS k FROM hud) GROUP BY stem, seg")
def previous_confirmed(spark, sf_dir):
    seg = F.expr("rn div 25")
    k = A.hud_reads(spark, sf_dir).groupBy("stem", seg.alias("seg")).agg(F.max(F.when(seg % 3 > 0, F.col("k"))).alias("k"))
    w = W.partitionBy("stem").orderBy("seg").rowsBetween(W.unboundedPreceding, -1)
    return k.withColumn("previous", F.last("k", ignorenulls=True).over(w))


@plan("e26_value_pattern", views="hud", sql=""", x AS (SELECT *, sum(CASE WHEN method = 'row_miss' THEN 1 ELSE 0 END) OVER (PARTITION BY stem ORDER BY rn ROWS UNBOUNDED PRECEDING) AS part, count(k) OVER (PARTITION BY stem ORDER BY rn ROWS UNBOUNDED PRECEDING) AS hit FROM hud),
 h AS (SELECT stem, part, t, hit, k, lag(k) OVER w AS pk, lag(t) OVER w AS pt, lag(hit) OVER w AS ph FROM x WHERE k IS NOT NULL WINDOW w AS (PARTITION BY stem, part ORDER BY rn)),
 f AS (SELECT * FROM h WHERE k - pk BETWEEN 1 AND 2 AND t - pt <= 15)
SELECT f.stem, f.pt AS t_from, f.t AS t_to, count(*) AS misses FROM f JOIN x ON x.stem = f.stem AND x.t > f.pt AND x.t < f.t AND x.method = 'template_miss' GROUP BY f.stem, f.pt, f.t""")
def value_pattern(spark, sf_dir):
    """Misses between two readings whose value rises by one or two within 15 s, no lost row between."""
    w = W.partitionBy("stem").orderBy("rn").rowsBetween(W.unboundedPreceding, 0)
    x = A.hud_reads(spark, sf_dir).withColumn("part", F.sum(F.when(F.col("method") == "row_miss", 1).otherwise(0)).over(w))
    x = x.withColumn("misses", F.sum(F.when(F.col("method") == "template_miss", 1).otherwise(0)).over(w))
    v = W.partitionBy("stem", "part").orderBy("rn")
    h = x.where("k is not null").select("stem", "t", "k", "misses", F.lag("k").over(v).alias("pk"), F.lag("t").over(v).alias("t_from"), F.lag("misses").over(v).alias("pm"))
    return h.where("k - pk between 1 and 2 and t - t_from <= 15 and misses > pm").select("stem", "t_from", F.col("t").alias("t_to"), (F.col("misses") - F.col("pm")).alias("misses"))


@plan("e28_output_numbers", views="det", sql="SELECT stem, idx, row_number() OVER (PARTITION BY stem ORDER BY d1, idx) AS number FROM det WHERE idx % 4 = 0")
def output_numbers(spark, sf_dir):
    return A.detections(spark, sf_dir).where("idx % 4 = 0").select("stem", "idx", F.row_number().over(W.partitionBy("stem").orderBy("d1", "idx")).cast("bigint").alias("number"))


@plan("e29_boundary_list", views="hud", sql=RUNS + " SELECT stem, list(start ORDER BY start) AS boundaries FROM runs GROUP BY stem")
def boundary_list(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("stem").agg(F.sort_array(F.collect_list("start")).alias("boundaries"))


@plan("d18_longest_streak", views="hud", sql=RUNS + """, b AS (SELECT stem, start, CAST(floor(start) AS BIGINT) % 3 > 0 AS rejected FROM runs), g2 AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY start) - row_number() OVER (PARTITION BY stem, rejected ORDER BY start) AS r FROM b)
SELECT stem, max(n) AS longest FROM (SELECT stem, count(*) AS n FROM g2 WHERE rejected GROUP BY stem, r) GROUP BY stem""")
def longest_streak(spark, sf_dir):
    rejected = F.floor("start") % 3 > 0
    r = islands.marked_runs(runs(spark, sf_dir), rejected, t="start").where(rejected)
    return r.groupBy("stem", "run").agg(F.count("*").alias("n")).groupBy("stem").agg(F.max("n").alias("longest"))


@plan("a19_window_dump", views="hud", sql="SELECT * FROM hud WHERE stem = 'v00001' AND t BETWEEN 300 AND 420")
def window_dump(spark, sf_dir):
    return A.hud_reads(spark, sf_dir).where((F.col("stem") == "v00001") & F.col("t").between(300, 420))
