"""Joins of intervals, points and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import guards, names
from ..operators import intervals, name_index
from ..sources import adapters as A
from . import scalars, sequences
from .base import plan

_PAIRS = ", pairs AS (SELECT g.stem, g.idx AS g, d.idx AS d, g1, g2, d1, d2 FROM gt g JOIN det d ON d.stem = g.stem AND g1 - 15 <= d2 AND d1 - 15 <= g2)"


def pairs(spark: SparkSession, sf_dir: str, tolerance: float = 15.0, how: str = "inner") -> DataFrame:
    g = A.truths(spark, sf_dir).withColumnRenamed("idx", "g")
    return intervals.overlapping(g, A.detections(spark, sf_dir).withColumnRenamed("idx", "d"), "g1", "g2", "d1", "d2", tolerance, how=how)


@plan("b14_overlaps", views="gt det", sql="SELECT g.stem, g.idx AS g, d.idx AS d, g1 < d2 AND d1 < g2 AS strict FROM gt g JOIN det d ON d.stem = g.stem AND g1 - 15 <= d2 AND d1 - 15 <= g2")
def overlaps(spark, sf_dir):
    return pairs(spark, sf_dir).select("stem", "g", "d", guards.overlaps(F.col("g1"), F.col("g2"), F.col("d1"), F.col("d2")).alias("strict"))


#: truths of a recording in turn, each with the detections that are still free
GREEDY = _PAIRS + """, lists AS MATERIALIZED (SELECT stem, g, list(d ORDER BY d) AS cands, row_number() OVER (PARTITION BY stem ORDER BY g) AS r FROM pairs GROUP BY stem, g),
 taken(stem, r, g, hit, used) AS (SELECT DISTINCT stem, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, []::BIGINT[] FROM lists UNION ALL
  SELECT stem, r, g, hit, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit) END FROM (
   SELECT l.stem, l.r, l.g, t.used, list_filter(l.cands, lambda d: NOT list_contains(t.used, d))[1] AS hit FROM taken t JOIN lists l ON l.stem = t.stem AND l.r = t.r + 1)),
 hits AS (SELECT gt.stem, gt.idx, t.hit FROM gt LEFT JOIN (SELECT stem, g, hit FROM taken WHERE r > 0) t ON t.stem = gt.stem AND t.g = gt.idx)"""


@plan("c1_greedy_matches", views="gt det", sql=GREEDY + " SELECT * FROM hits")
def greedy_matches(spark, sf_dir):
    return intervals.greedy_matches(A.truths(spark, sf_dir), A.detections(spark, sf_dir))


@plan("c2_first_hit", views="gt det", sql=_PAIRS + " SELECT gt.stem, gt.idx, count(d) > 0 AS hit, CAST(min(d) % 100 AS DOUBLE) AS score FROM gt LEFT JOIN pairs p ON p.stem = gt.stem AND p.g = gt.idx GROUP BY gt.stem, gt.idx")
def first_hit(spark, sf_dir):
    p = pairs(spark, sf_dir, how="left").withColumn("score", (F.col("d") % 100).cast("double"))
    return p.groupBy("stem", F.col("g").alias("idx")).agg((F.count("d") > 0).alias("hit"), F.min_by("score", "d").alias("score"))


@plan("c3_unmatched", views="gt det", sql=_PAIRS + " SELECT stem, idx FROM gt WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.stem = gt.stem AND p.g = gt.idx)")
def unmatched(spark, sf_dir):
    return pairs(spark, sf_dir, how="left").where("d is null").select("stem", F.col("g").alias("idx"))


_NEAREST = """, o AS (SELECT g.stem, g.idx AS g, d.idx AS d, least(g2, d2) - greatest(g1, d1) AS ov, abs((g1 + g2) / 2 - (d1 + d2) / 2) AS gap FROM gt g JOIN det d ON d.stem = g.stem),
 r AS (SELECT *, row_number() OVER (PARTITION BY stem, g ORDER BY CASE WHEN ov > 0 THEN 0 ELSE 1 END, CASE WHEN ov > 0 THEN -ov END, gap, d) AS n, ov > 0 AS hit FROM o)"""


def best_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-overlapping detection of each truth, else the nearest by middle; by recording."""
    g, d = A.truths(spark, sf_dir).withColumnRenamed("idx", "g"), A.detections(spark, sf_dir).withColumnRenamed("idx", "d")
    met = intervals.overlapping(g, d, "g1", "g2", "d1", "d2").withColumn("ov", F.least("g2", "d2") - F.greatest("g1", "d1")).where("ov > 0")
    gap = F.abs((F.col("g1") + F.col("g2")) / 2 - (F.col("d1") + F.col("d2")) / 2)
    over = met.groupBy("stem", "g").agg(F.min_by("d", F.struct((-F.col("ov")).alias("ov"), gap.alias("gap"), "d")).alias("d"))
    rest = g.join(over, ["stem", "g"], "left_anti").select("stem", "g", ((F.col("g1") + F.col("g2")) / 2).alias("m"))
    near = intervals.nearest_middle(rest, d.select("stem", "d", ((F.col("d1") + F.col("d2")) / 2).alias("m"))).where("d is not null")
    return over.select("stem", "g", "d", F.lit(True).alias("hit")).unionByName(near.select("stem", "g", "d", F.lit(False).alias("hit")))


plan("c4_best_or_nearest", views="gt det", sql=_NEAREST + " SELECT stem, g, d, hit FROM r WHERE n = 1")(best_rounds)


@plan("c6_verdict_lookup", views="hud", sql=sequences.RUNS + """, v AS (SELECT stem, start + 0.02 AS vs, last - 0.02 AS vl, CAST(floor(start) AS BIGINT) % 2 = 0 AS ok FROM runs WHERE CAST(floor(last) AS BIGINT) % 3 > 0)
SELECT r.stem, r.start, coalesce((SELECT v.ok FROM v WHERE v.stem = r.stem AND abs(v.vs - r.start) < 0.05 AND abs(v.vl - r.last) < 0.05 ORDER BY vs LIMIT 1), true) AS keep FROM runs r""")
def verdict_lookup(spark, sf_dir):
    r = sequences.runs(spark, sf_dir)
    v = r.where(F.floor("last") % 3 > 0).select("stem", (F.col("start") + 0.02).alias("vs"), (F.col("last") - 0.02).alias("vl"), (F.floor("start") % 2 == 0).alias("ok"))
    near = (F.abs(F.col("vs") - F.col("start")) < 0.05) & (F.abs(F.col("vl") - F.col("last")) < 0.05)
    v = v.withColumn("vs2", F.col("vs"))
    met = intervals.overlapping(r.select("stem", "start", "last", F.col("start").alias("start2")), v, "start", "start2", "vs", "vs2", tolerance=0.05).where(near)
    found = met.groupBy("stem", "start").agg(F.min_by("ok", "vs").alias("ok"))
    both = r.select("stem", "start").join(found, ["stem", "start"], "left")
    return both.select("stem", "start", F.coalesce("ok", F.lit(True)).alias("keep"))


@plan("c7_nearby_win", views="hud score", sql=sequences.RUNS + sequences.EVENTS + " SELECT stem, start FROM runs r WHERE EXISTS (SELECT 1 FROM events8 e WHERE e.stem = r.stem AND e.kind = 'win' AND e.t_hi BETWEEN r.start - 28 AND r.start + 24)")
def nearby_win(spark, sf_dir):
    wins = sequences.score_events(spark, sf_dir).where("kind = 'win'").select("stem", F.col("t_hi").alias("p"))
    return intervals.near_points(sequences.runs(spark, sf_dir).select("stem", "start"), wins, 28.0, 24.0, t="start").where("n_near > 0").select("stem", "start")


@plan("c8_wins_in_round", views="hud score", sql=sequences.SEGMENTS + sequences.EVENTS + " SELECT g.stem, g.seg, count(e.t_hi) AS wins FROM segs g LEFT JOIN events8 e ON e.stem = g.stem AND e.kind = 'win' AND e.t_hi >= g.s AND e.t_hi < g.e GROUP BY g.stem, g.seg")
def wins_in_round(spark, sf_dir):
    from ..operators import islands

    cut = sequences.cut(spark, sf_dir)
    wins = sequences.score_events(spark, sf_dir).where("kind = 'win'").select("stem", F.col("t_hi").alias("t"))
    n = islands.assigned(wins, cut).groupBy("stem", "seg").agg(F.count("*").alias("wins"))
    return cut.join(n, ["stem", "seg"], "left").select("stem", "seg", F.coalesce("wins", F.lit(0).cast("bigint")).alias("wins"))


@plan("c9_asof_before", views="probs score", sql=""", w AS (SELECT stem, rn, t FROM probs WHERE prob >= 0.9), e AS (SELECT stem, t AS e, red FROM score WHERE red = 0)
SELECT w.stem, w.rn, max(e.e) AS e FROM w LEFT JOIN e ON e.stem = w.stem AND e.e BETWEEN w.t - 8 AND w.t - 0.3 GROUP BY w.stem, w.rn""")
def asof_before(spark, sf_dir):
    w = A.frame_probs(spark, sf_dir).where("prob >= 0.9").select("stem", "rn", "t")
    e = A.score_reads(spark, sf_dir).where("red = 0").select("stem", F.col("t").alias("e"))
    return intervals.latest_before(w, e, 8.0, 0.3).select("stem", "rn", "e")


@plan("c10_lookback_max", views="hud probs", sql=sequences.RUNS + " SELECT r.stem, r.start, max(p.prob) AS best, coalesce(max(p.prob) >= 0.6, false) AS ok FROM runs r LEFT JOIN probs p ON p.stem = r.stem AND p.t BETWEEN r.start - 3 AND r.start GROUP BY r.stem, r.start")
def lookback_max(spark, sf_dir):
    r = sequences.runs(spark, sf_dir).select("stem", "start", (F.col("start") - 3).alias("from_sec"))
    p = A.frame_probs(spark, sf_dir).select("stem", F.col("t").alias("p1"), F.col("t").alias("p2"), "prob")
    hit = intervals.overlapping(r, p, "from_sec", "start", "p1", "p2", how="left")
    best = hit.groupBy("stem", "start").agg(F.max("prob").alias("best"))
    return best.withColumn("ok", F.coalesce(F.col("best") >= 0.6, F.lit(False)))


@plan("c11_value_between", views="hud", sql=sequences.SEGMENTS + " SELECT stem, seg FROM segs g WHERE EXISTS (SELECT 1 FROM hud h WHERE h.stem = g.stem AND h.k = 8 AND h.t > g.s AND h.t < g.e)")
def value_between(spark, sf_dir):
    k = A.hud_reads(spark, sf_dir).where("k = 8").select("stem", F.col("t").alias("p1"), F.col("t").alias("p2"))
    hit = intervals.overlapping(sequences.cut(spark, sf_dir), k, "s", "e", "p1", "p2").where("p1 > s and p1 < e")
    return hit.select("stem", "seg").distinct()


_S = scalars._STRIP("text")


@plan("c12_best_name", views="votes", sql=f""", s AS (SELECT stem, ord, {_S} AS text, conf FROM votes), q AS (SELECT stem, min_by(text, ord) AS player FROM s GROUP BY stem),
 m AS (SELECT q.stem, s.ord, {scalars.sql_score('q.player', 's.text')} AS score FROM q JOIN s ON s.stem = q.stem),
 b AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY score DESC, ord) AS n FROM m WHERE score >= 0.65)
SELECT stem, ord, round(score, 9) AS score FROM b WHERE n = 1""")
def best_name(spark, sf_dir):
    s = A.votes(spark, sf_dir).withColumn("text", names.stripped(F.col("text")))
    q = s.groupBy("stem").agg(F.min_by("text", "ord").alias("player"))
    m = s.join(q, "stem").withColumn("score", names.match_score(F.col("player"), F.col("text"))).where("score >= 0.65")
    best = m.groupBy("stem").agg(F.min(F.struct((-F.col("score")).alias("x"), "ord")).alias("b"))
    return best.select("stem", "b.ord", F.round(-F.col("b.x"), 9).alias("score"))


@plan("c13_cross_confirmation", views="source_votes", sql=f""", s AS (SELECT stem, ord, {_S} AS text, weight FROM source_votes),
 c AS (SELECT a.stem, a.ord, min(b.ord) AS first_frame FROM s a JOIN s b ON b.stem = a.stem AND b.weight = 0.5 AND b.ord > a.ord AND {scalars.sql_match(scalars._NORM('a.text'), scalars._NORM('b.text'))} WHERE a.weight > 2 GROUP BY a.stem, a.ord)
SELECT stem, ord, first_frame, CAST(2 AS DOUBLE) AS bonus FROM c""")
def cross_confirmation(spark, sf_dir):
    """Distinct texts are matched once; a vote's next frame of each matching text is a running value."""
    s = A.source_votes(spark, sf_dir).withColumn("text", names.stripped(F.col("text")))
    a, b = s.where("weight > 2"), s.where("weight = 0.5")
    matched = name_index.matches(a, b)
    asks = a.select("stem", F.col("text").alias("x"), "ord").join(matched, ["stem", "x"]).select("stem", "y", "ord", F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("frame"))
    frames = b.select("stem", F.col("text").alias("y"), "ord", F.lit(1).alias("side"), F.col("ord").alias("frame"))
    later = W.partitionBy("stem", "y").orderBy(F.desc("ord"), "side").rowsBetween(W.unboundedPreceding, 0)
    hit = asks.unionByName(frames).withColumn("frame", F.last("frame", ignorenulls=True).over(later)).where("side = 0 and frame is not null")
    return hit.groupBy("stem", "ord").agg(F.min("frame").alias("first_frame"), F.lit(2.0).alias("bonus"))


@plan("c15_baseline_diff", views="gt det", sql=_PAIRS + """, now AS (SELECT DISTINCT stem, g FROM pairs), old AS (SELECT stem, idx AS g FROM gt WHERE idx % 3 > 0)
SELECT coalesce(o.stem, n.stem) AS stem, coalesce(o.g, n.g) AS g, CASE WHEN o.g IS NULL THEN 'gained' WHEN n.g IS NULL THEN 'lost' ELSE 'kept' END AS change FROM old o FULL JOIN now n ON n.stem = o.stem AND n.g = o.g""")
def baseline_diff(spark, sf_dir):
    now = pairs(spark, sf_dir).select("stem", "g").distinct().withColumn("n", F.lit(1))
    old = A.truths(spark, sf_dir).where("idx % 3 > 0").select("stem", F.col("idx").alias("g"), F.lit(1).alias("o"))
    change = F.when(F.col("o").isNull(), "gained").when(F.col("n").isNull(), "lost").otherwise("kept")
    return old.join(now, ["stem", "g"], "full").select("stem", "g", change.alias("change"))


@plan("c16_asset_audit", views="gt det hud", sql=""", g AS (SELECT stem, count(*) AS spans FROM gt GROUP BY stem)
SELECT g.stem, spans, s.stem IS NOT NULL AS source, c.stem IS NOT NULL AS cache, t.stem IS NOT NULL AS timeline, s.stem IS NULL AND c.stem IS NULL AS lost FROM g
 LEFT JOIN (SELECT DISTINCT stem FROM det WHERE idx % 7 = 0) s ON s.stem = g.stem LEFT JOIN (SELECT DISTINCT stem FROM hud) c ON c.stem = g.stem LEFT JOIN (SELECT DISTINCT stem FROM det WHERE d1 > 2400) t ON t.stem = g.stem""")
def asset_audit(spark, sf_dir):
    d = A.detections(spark, sf_dir)
    has = lambda df, name: df.select("stem").distinct().withColumn(name, F.lit(True))
    g = A.truths(spark, sf_dir).groupBy("stem").agg(F.count("*").alias("spans"))
    all_ = g.join(has(d.where("idx % 7 = 0"), "source"), "stem", "left").join(has(A.hud_reads(spark, sf_dir), "cache"), "stem", "left").join(has(d.where("d1 > 2400"), "timeline"), "stem", "left").fillna(False)
    return all_.withColumn("lost", ~F.col("source") & ~F.col("cache"))


@plan("c17_stale_outputs", views="gt", sql=scalars._PATHS + r""", f AS (SELECT o_orderkey, path, TRY_CAST(nullif(regexp_extract(path, '_R(\d+)_|R(\d+)_', 2), '') AS BIGINT) AS r FROM p), a AS (SELECT idx % 15 AS r FROM gt)
SELECT o_orderkey, CASE WHEN r IS NULL THEN 'unparsable' ELSE 'not current' END AS why FROM f WHERE r IS NULL OR r NOT IN (SELECT r FROM a)""")
def stale_outputs(spark, sf_dir):
    f = scalars._paths(spark, sf_dir).withColumn("r", F.nullif(F.regexp_extract("path", r"_R(\d+)_|R(\d+)_", 2), F.lit("")).try_cast("bigint"))
    now = A.truths(spark, sf_dir).select((F.col("idx") % 15).alias("r")).distinct()
    return f.join(now, "r", "left_anti").select("o_orderkey", F.when(F.col("r").isNull(), "unparsable").otherwise("not current").alias("why"))


@plan("c18_destination", views="gt det", sql="SELECT d.stem, d.idx, CASE WHEN f.stem IS NOT NULL THEN 'false_positive' WHEN idx % 4 = 0 THEN 'current' ELSE 'old' END AS destination FROM det d LEFT JOIN (SELECT stem, max(g1) AS m FROM gt GROUP BY stem) f ON f.stem = d.stem AND d.d1 > f.m")
def destination(spark, sf_dir):
    f = A.truths(spark, sf_dir).groupBy("stem").agg(F.max("g1").alias("m"))
    where = F.when(F.col("d1") > F.col("m"), "false_positive").when(F.col("idx") % 4 == 0, "current").otherwise("old")
    return A.detections(spark, sf_dir).join(f, "stem", "left").select("stem", "idx", where.alias("destination"))


@plan("c20_own_row", views="sb", sql="SELECT a.stem, a.rn, min(b.kills) AS kills FROM (SELECT stem, rn, min(row_index) AS row_index FROM sb GROUP BY stem, rn) a JOIN sb b ON b.stem = a.stem AND b.rn = a.rn AND b.row_index = a.row_index GROUP BY a.stem, a.rn")
def own_row(spark, sf_dir):
    sb = A.sb_rows(spark, sf_dir)
    own = sb.groupBy("stem", "rn").agg(F.min("row_index").alias("row_index"))
    return sb.join(own, ["stem", "rn", "row_index"]).groupBy("stem", "rn").agg(F.min("kills").alias("kills"))


@plan("c21_segment_clips", sql="SELECT c.conv_id, c.turn, p.page_id IS NOT NULL AS extracted FROM conversations c LEFT JOIN pages p ON p.page_id = c.conv_id AND c.turn % 2 = 0")
def segment_clips(spark, sf_dir):
    p = A.table(spark, sf_dir, "pages").select(F.col("page_id").alias("conv_id"), F.lit(0).cast("bigint").alias("side"))
    c = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") % 2).alias("side"))
    return c.join(p.withColumn("hit", F.lit(True)), ["conv_id", "side"], "left").select("conv_id", "turn", F.coalesce("hit", F.lit(False)).alias("extracted"))


@plan("c22_label_join", views="preds", sql="SELECT d.doc_id, coalesce(CAST(l.label AS VARCHAR), '') AS label FROM documents d LEFT JOIN preds l ON l.doc_id = d.doc_id")
def label_join(spark, sf_dir):
    p = A.predictions(spark, sf_dir).select("doc_id", F.col("label").cast("string").alias("label"))
    return A.table(spark, sf_dir, "documents").select("doc_id").join(p, "doc_id", "left").fillna("", ["label"])


_WINDOWS = """, w AS (SELECT stem, n, CAST(CAST(concat('0x', substr(sha1(concat(stem, '|', n)), 1, 8)) AS UBIGINT) % 2400 AS DOUBLE) AS s FROM (SELECT DISTINCT stem FROM gt), (SELECT unnest(range(0, 40)) AS n)),
 f AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM gt g WHERE g.stem = w.stem AND w.s < g.g2 + 6 AND g.g1 - 6 < w.s + 12)), r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY n) AS k FROM f)"""


@plan("c23_h7_background_windows", views="gt", sql=_WINDOWS + " SELECT stem, s AS start, s + 12 AS \"end\" FROM r WHERE k <= 10")
def background_windows(spark, sf_dir):
    """Hash-seeded windows away from forbidden spans, the first ten of each recording."""
    g = A.truths(spark, sf_dir).select("stem", "g1", "g2")
    slot = F.conv(F.substring(F.sha1(F.concat_ws("|", "stem", F.col("n").cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint") % 2400
    w = g.select("stem").distinct().withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("s", slot.cast("double")).withColumn("e", F.col("s") + 12)
    spoilt = intervals.overlapping(w, g, "s", "e", "g1", "g2", tolerance=6.0).where("s < g2 + 6 and g1 - 6 < e").select("stem", "n").distinct()
    k = F.row_number().over(W.partitionBy("stem").orderBy("n"))
    return w.join(spoilt, ["stem", "n"], "left_anti").withColumn("k", k).where("k <= 10").select("stem", F.col("s").alias("start"), F.col("e").alias("end"))


@plan("c24_team_by_names", views="source_votes", sql=f""", s AS (SELECT stem, ord // 20 AS n, {_S} AS text FROM source_votes), t AS (SELECT DISTINCT stem, text FROM s WHERE n % 5 = 0), r AS (SELECT * FROM s WHERE n % 5 > 0)
SELECT r.stem, r.n // 10 AS round, CASE WHEN bool_or(r.n % 10 <= 5) THEN 'red' ELSE 'blue' END AS team FROM r JOIN t ON t.stem = r.stem AND {scalars.sql_match(scalars._NORM('r.text'), scalars._NORM('t.text'))} GROUP BY r.stem, r.n // 10""")
def team_by_names(spark, sf_dir):
    """Side on which a team mate is read; distinct texts are matched once."""
    s = A.source_votes(spark, sf_dir).select("stem", F.expr("ord div 20").alias("n"), names.stripped(F.col("text")).alias("text"))
    mates, rows = s.where("n % 5 = 0").select("stem", "text"), s.where("n % 5 > 0")
    known = name_index.matches(rows, mates).select("stem", F.col("x").alias("text")).distinct()
    return rows.join(known, ["stem", "text"]).groupBy("stem", F.expr("n div 10").alias("round")).agg(F.when(F.bool_or(F.col("n") % 10 <= 5), "red").otherwise("blue").alias("team"))


@plan("c25_cluster_labels", sql="SELECT e.vec_id, coalesce(l.name, 'junk') AS name FROM embeddings e LEFT JOIN (SELECT DISTINCT label, concat('digit_', label) AS name FROM embeddings WHERE label % 3 > 0) l ON l.label = e.label")
def cluster_labels(spark, sf_dir):
    e = A.table(spark, sf_dir, "embeddings")
    known = e.where("label % 3 > 0").select("label", F.concat(F.lit("digit_"), F.col("label").cast("string")).alias("name")).distinct()
    return e.select("vec_id", "label").join(known, "label", "left").select("vec_id", F.coalesce("name", F.lit("junk")).alias("name"))


@plan("c26_densest_band", views="sb", sql=""", x AS (SELECT stem, rn, line, kills AS y FROM sb), n AS (SELECT a.stem, a.rn, a.y, count(*) AS n FROM x a JOIN x b ON b.stem = a.stem AND b.rn // 100 = a.rn // 100 AND abs(a.y - b.y) <= 4 GROUP BY a.stem, a.rn, a.line, a.y)
SELECT stem, rn // 100 AS part, max(n) AS n, min(y) FILTER (WHERE n = m) AS anchor FROM (SELECT *, max(n) OVER (PARTITION BY stem, rn // 100) AS m FROM n) GROUP BY stem, rn // 100 HAVING max(n) >= 5""")
def densest_band(spark, sf_dir):
    """Value with the most neighbours within 4 of its group (five at least)."""
    x = A.sb_rows(spark, sf_dir).select("stem", F.expr("rn div 100").alias("part"), "rn", "line", F.col("kills").alias("y")).dropna(subset=["stem", "part", "y"])
    # equal values are counted first; rows that share their keys count for each other's number
    value = x.groupBy("stem", "part", "rn", "line", "y").count().groupBy("stem", "part", "y").agg(F.sum("count").alias("all"), F.max("count").alias("alike"))
    near = F.sum("all").over(W.partitionBy("stem", "part").orderBy("y").rangeBetween(-4, 4))
    n = value.withColumn("n", near * F.col("alike"))
    best = n.groupBy("stem", "part").agg(F.max(F.struct("n", (-F.col("y")).alias("y"))).alias("b")).where("b.n >= 5")
    return best.select("stem", "part", "b.n", (-F.col("b.y")).alias("anchor"))


@plan("s13_merged_fragments", views="sb", sql=""", x AS (SELECT stem, rn, line, kills AS y, deaths AS d FROM sb), g AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY stem, rn ORDER BY y, line, d) <= 18 THEN 0 ELSE 1 END AS new FROM x),
 h AS (SELECT *, sum(new) OVER (PARTITION BY stem, rn ORDER BY y, line, d ROWS UNBOUNDED PRECEDING) AS row FROM g) SELECT stem, rn, row, string_agg(CAST(line AS VARCHAR), '' ORDER BY line) AS text, max(y) AS best FROM h GROUP BY stem, rn, row""")
def merged_fragments(spark, sf_dir):
    """Fragments at most 18 apart in height are one row; its texts in reading order."""
    x = A.sb_rows(spark, sf_dir).withColumnRenamed("kills", "y")
    w = W.partitionBy("stem", "rn").orderBy("y", "line", "deaths")
    g = x.withColumn("new", F.when(F.col("y") - F.lag("y").over(w) <= 18, 0).otherwise(1)).withColumn("row", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return g.groupBy("stem", "rn", "row").agg(F.array_join(F.sort_array(F.collect_list("line")), "").alias("text"), F.max("y").alias("best"))


@plan("s14_own_name", views="votes", sql=""", c AS (SELECT stem, ord // 20 AS scan, ord, text, conf, CASE WHEN lower(text) = 'the' THEN 0 ELSE 1 END AS p FROM votes WHERE length(text) > 1)
SELECT stem, scan, arg_min(text, row(p, -conf, ord)) AS name FROM c GROUP BY stem, scan""")
def own_name(spark, sf_dir):
    c = A.votes(spark, sf_dir).where(F.length("text") > 1)
    key = F.struct(F.when(F.lower("text") == "the", 0).otherwise(1), (-F.col("conf")).alias("c"), "ord")
    return c.groupBy("stem", F.expr("ord div 20").alias("scan")).agg(F.min_by("text", key).alias("name"))


@plan("a21_source_fallback", views="source_votes", sql="""SELECT stem, arg_min(src, p) AS source FROM (SELECT DISTINCT stem, 'convention' AS src, 2 AS p FROM source_votes UNION ALL SELECT DISTINCT stem, 'explicit', 1 FROM source_votes WHERE stem < 'src3' UNION ALL SELECT DISTINCT stem, 'old list', 3 FROM source_votes) GROUP BY stem""")
def source_fallback(spark, sf_dir):
    s = A.source_votes(spark, sf_dir).select("stem").distinct()
    tagged = lambda df, name, p: df.select("stem", F.lit(name).alias("src"), F.lit(p).alias("p"))
    every = tagged(s, "convention", 2).unionByName(tagged(s.where("stem < 'src3'"), "explicit", 1)).unionByName(tagged(s, "old list", 3))
    return every.groupBy("stem").agg(F.min_by("src", "p").alias("source"))


@plan("a15_pending_runs", views="det", sql="SELECT DISTINCT stem FROM det WHERE stem NOT IN (SELECT stem FROM det WHERE idx % 200 = 0)")
def pending_runs(spark, sf_dir):
    d = A.detections(spark, sf_dir)
    return d.select("stem").distinct().join(d.where("idx % 200 = 0").select("stem").distinct(), "stem", "left_anti")


