"""Votes, metrics, selections, generators and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels, names
from ..operators import evaluate, generate, name_index, votes
from ..sources import adapters as A
from ..sources import files
from . import intervals, scalars, sequences
from .base import plan


@plan("d3_majority_value", views="sb", sql=", c AS (SELECT stem, row_index, kills, count(*) AS n, min(rn * 100 + line) AS first FROM sb GROUP BY stem, row_index, kills) SELECT stem, row_index, arg_min(kills, row(-n, first)) AS value FROM c GROUP BY stem, row_index")
def majority_value(spark, sf_dir):
    return votes.majority(A.sb_rows(spark, sf_dir).withColumn("ord", F.col("rn") * 100 + F.col("line")), ["stem", "row_index"], "kills", "ord")


@plan("d4_vote_sums", views="votes", sql="SELECT stem, text, sum(weight) AS weight, max(conf) AS conf, count(*) AS samples FROM votes GROUP BY stem, text")
def vote_sums(spark, sf_dir):
    return votes.summed(A.votes(spark, sf_dir)).drop("first")


_SAME = f"({scalars.sql_match(scalars._NORM('a.text'), scalars._NORM('b.text'))} OR (a.text <> '' AND b.text <> '' AND {scalars.sql_match('a.text', 'b.text')}))"
#: texts of a recording in turn, each with its leader; texts are of kept characters, as DuckDB's distance counts bytes
CLUSTERS = f""", s AS (SELECT stem, ord, {scalars._STRIP('text')} AS text, weight, conf FROM votes),
 o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY weight DESC, first) AS r FROM (SELECT stem, text, sum(weight) AS weight, max(conf) AS conf, count(*) AS samples, min(ord) AS first FROM s GROUP BY stem, text)),
 e AS MATERIALIZED (SELECT b.stem, b.r, coalesce(list(a.r ORDER BY a.r) FILTER (a.r IS NOT NULL), []) AS near FROM o b LEFT JOIN o a ON a.stem = b.stem AND a.r < b.r AND {_SAME} GROUP BY b.stem, b.r),
 turn(stem, r, leader, leaders) AS (SELECT DISTINCT stem, 0::BIGINT, 0::BIGINT, []::BIGINT[] FROM o UNION ALL
  SELECT stem, r, x, CASE WHEN x = r THEN list_append(leaders, r) ELSE leaders END FROM (SELECT e.stem, e.r, t.leaders, coalesce(list_filter(e.near, lambda n: list_contains(t.leaders, n))[1], e.r) AS x FROM turn t JOIN e ON e.stem = t.stem AND e.r = t.r + 1)),
 g AS (SELECT t.stem, leader, sum(weight) AS weight, CAST(sum(samples) AS BIGINT) AS samples, max(conf) AS best_conf, list(text ORDER BY t.r) AS variants, arg_min(text, t.r) AS lead, bool_or(text IN {scalars._NULLS}) AS is_null FROM turn t JOIN o ON o.stem = t.stem AND o.r = t.r GROUP BY t.stem, leader),
 clusters AS (SELECT stem, row_number() OVER (PARTITION BY stem ORDER BY weight DESC, leader) AS rank, CASE WHEN is_null THEN 'null' ELSE lead END AS canonical, CASE WHEN is_null THEN 'null' ELSE lead END AS core, weight, samples, best_conf, variants FROM g)"""


def stripped_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.votes(spark, sf_dir).withColumn("text", names.stripped(F.col("text")))


plan("j6_name_clusters", views="votes", sql=CLUSTERS + " SELECT * FROM clusters")(lambda spark, sf_dir: votes.clusters(stripped_votes(spark, sf_dir)))


@plan("j8_identities", views="votes", sql=CLUSTERS + """, totals AS (SELECT stem, sum(weight) AS total, max(samples) AS most, sum(samples) AS n FROM clusters GROUP BY stem),
 cross_ AS (SELECT stem, count(*) FILTER (weight = 0.5) / CAST(count(*) AS DOUBLE) AS share FROM s GROUP BY stem),
 cores AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY w DESC, text) AS k, lead(w) OVER (PARTITION BY stem ORDER BY w DESC, text) AS second FROM (SELECT stem, text, sum(weight) AS w, count(*) AS n FROM s WHERE length(text) >= 3 GROUP BY stem, text)),
 soft AS (SELECT stem, CASE WHEN n >= 2 AND (second IS NULL OR w / (w + second) >= 0.38) THEN text END AS accepted FROM cores WHERE k = 1),
 z AS (SELECT c.*, accepted, least(1, weight / total * 0.5 + share * 0.3 + most / CAST(n AS DOUBLE) * 0.2) AS sure FROM clusters c JOIN totals t ON t.stem = c.stem JOIN cross_ x ON x.stem = c.stem LEFT JOIN soft f ON f.stem = c.stem WHERE rank = 1)
SELECT stem, CASE WHEN samples >= 4 AND sure >= 0.35 THEN canonical ELSE accepted END AS name, round(sure, 6) AS confidence, CASE WHEN samples >= 4 AND sure >= 0.35 THEN 'gate' WHEN accepted IS NOT NULL THEN 'soft' ELSE 'none' END AS mode, samples FROM z""")
def identities(spark, sf_dir):
    return votes.identities(stripped_votes(spark, sf_dir))


@plan("c14_own_cluster", views="votes", sql=CLUSTERS + f""", m AS (SELECT stem, rank, canonical, unnest(variants) AS text FROM clusters), own AS (SELECT DISTINCT stem, text FROM s WHERE weight > 2)
SELECT a.stem, min(rank) AS rank, arg_min(canonical, rank) AS canonical FROM m a JOIN own b ON b.stem = a.stem AND {scalars.sql_match(scalars._NORM('a.text'), scalars._NORM('b.text'))} GROUP BY a.stem""")
def own_cluster(spark, sf_dir):
    """First cluster of each recording that holds a strongly voted name."""
    v = stripped_votes(spark, sf_dir)
    members = files.written(votes.clusters(v).select("stem", "rank", "canonical", F.explode("variants").alias("x")), "members")
    strong = v.where("weight > 2").select("stem", "text")
    hit = members.hint("merge").join(name_index.matches(members.select("stem", F.col("x").alias("text")), strong), ["stem", "x"])
    return hit.groupBy("stem").agg(F.min("rank").alias("rank"), F.min_by("canonical", "rank").alias("canonical"))


@plan("j7_cluster_summary", views="votes", sql=CLUSTERS + " SELECT stem, rank, canonical, round(weight, 2) AS weight, samples, array_to_string(variants, '|') AS variants FROM clusters WHERE rank <= 8")
def cluster_summary(spark, sf_dir):
    return votes.clusters(stripped_votes(spark, sf_dir)).where("rank <= 8").select("stem", "rank", "canonical", F.round("weight", 2).alias("weight"), "samples", F.array_join("variants", "|").alias("variants"))


@plan("d5_zero_filled_counts", sql="SELECT l.label, count(o.o_orderkey) AS n FROM (SELECT unnest(['allkill', 'background', 'doublekill', 'multikill', 'save']) AS label) l LEFT JOIN (SELECT o_orderkey, " + scalars._ALIAS_SQL + " AS label FROM (SELECT o_orderkey, " + scalars._SPELL_SQL + " AS raw FROM orders)) o ON o.label = l.label GROUP BY l.label")
def zero_filled_counts(spark, sf_dir):
    dim = spark.createDataFrame([(x,) for x in sorted(set(labels.ALIASES.values()))], "label string")
    found = scalars.label_alias(spark, sf_dir)
    return dim.join(F.broadcast(dim.select("label")).join(found, "label").groupBy("label").agg(F.count("*").alias("n")), "label", "left").fillna(0)


@plan("d6_recall_precision", views="gt det", sql=intervals.GREEDY + """, x AS (SELECT stem, 1 AS truths, CASE WHEN hit IS NULL THEN 0 ELSE 1 END AS matched, 0 AS found FROM hits UNION ALL SELECT stem, 0, 0, 1 FROM det),
 c AS (SELECT stem, CAST(sum(truths) AS BIGINT) AS truths, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(found) AS BIGINT) AS found FROM x GROUP BY ROLLUP (stem))
SELECT *, round(matched / CAST(nullif(truths, 0) AS DOUBLE), 9) AS recall, round(matched / CAST(nullif(found, 0) AS DOUBLE), 9) AS precision FROM c""")
def recall_precision(spark, sf_dir):
    """Recall and precision by recording and in all."""
    hits = intervals.greedy_matches(spark, sf_dir)
    return evaluate.match_metrics(hits, A.detections(spark, sf_dir))


@plan("d7_recall_rollup", views="gt det", sql=intervals._PAIRS + """, h AS (SELECT gt.stem, gt.idx, EXISTS (SELECT 1 FROM pairs p WHERE p.stem = gt.stem AND p.g = gt.idx) AS hit FROM gt)
SELECT stem, count(*) AS n, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) / CAST(count(*) AS DOUBLE), 9) AS recall FROM h GROUP BY ROLLUP (stem)""")
def recall_rollup(spark, sf_dir):
    h = intervals.first_hit(spark, sf_dir)
    return h.rollup("stem").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.round(F.count_if("hit") / F.count("*"), 9).alias("recall"))


_CONFUSION = "count(*) FILTER (pred = 1 AND label = 1) AS tp, count(*) FILTER (pred = 1 AND label = 0) AS fp, count(*) FILTER (pred = 0 AND label = 1) AS fn, count(*) FILTER (pred = 0 AND label = 0) AS tn"


@plan("d8_confusion", views="preds", sql=f""", c AS (SELECT {_CONFUSION} FROM preds) SELECT *, round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 9) AS accuracy, round(tp / CAST(tp + fp AS DOUBLE), 9) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 9) AS recall, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 9) AS f1 FROM c""")
def confusion(spark, sf_dir):
    return evaluate.confusion(A.predictions(spark, sf_dir))


@plan("d9_class_recall", views="preds", sql=""", c AS (SELECT label, count(*) AS n, count(*) FILTER (pred = label) / CAST(count(*) AS DOUBLE) AS recall FROM preds GROUP BY label)
SELECT label, n, round(recall, 9) AS recall, round(avg(recall) OVER (), 9) AS macro_recall FROM c""")
def class_recall(spark, sf_dir):
    return evaluate.class_recall(A.predictions(spark, sf_dir))


@plan("d12_median_width", sql="SELECT source, CAST(trunc(median(n_chars)) AS BIGINT) AS width FROM documents GROUP BY source")
def median_width(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").groupBy("source").agg(F.median("n_chars").cast("bigint").alias("width"))


@plan("d13_position_mode", sql="""SELECT x, y, count(*) AS hits, max(conf) AS conf FROM (SELECT CAST(round_even(l_extendedprice / 10000, 0) AS BIGINT) AS x, CAST(round_even(l_quantity / 10, 0) AS BIGINT) AS y, CAST(l_partkey % 100 AS DOUBLE) / 100 AS conf FROM lineitem) WHERE conf >= 0.75 GROUP BY x, y HAVING count(*) >= 5""")
def position_mode(spark, sf_dir):
    near = lambda c, w: F.bround(F.col(c) / w, 0).cast("bigint")
    p = A.table(spark, sf_dir, "lineitem").select(near("l_extendedprice", 10000).alias("x"), near("l_quantity", 10).alias("y"), ((F.col("l_partkey") % 100).cast("double") / 100).alias("conf"))
    return p.where("conf >= 0.75").groupBy("x", "y").agg(F.count("*").alias("hits"), F.max("conf").alias("conf")).where("hits >= 5")


@plan("d14_team_sum", views="sb", sql="SELECT stem, rn, team, CASE WHEN count(*) FILTER (kills BETWEEN 0 AND 40) >= 2 THEN CAST(sum(kills) FILTER (kills BETWEEN 0 AND 40) AS BIGINT) END AS total FROM sb GROUP BY stem, rn, team")
def team_sum(spark, sf_dir):
    v = F.when(F.col("kills").between(0, 40), F.col("kills"))
    return A.sb_rows(spark, sf_dir).groupBy("stem", "rn", "team").agg(F.when(F.count(v) >= 2, F.sum(v)).alias("total"))


@plan("d15_class_weights", views="preds", sql=", c AS (SELECT label, count(*) AS n FROM preds GROUP BY label) SELECT label, n, round(sum(n) OVER () / CAST(n * count(*) OVER () AS DOUBLE), 9) AS weight, round((1 / CAST(n AS DOUBLE)) / sum(1 / CAST(n AS DOUBLE)) OVER (), 9) AS share FROM c")
def class_weights(spark, sf_dir):
    return evaluate.class_weights(A.predictions(spark, sf_dir))


@plan("d16_auc_ap", views="preds", sql=""", r AS (SELECT label, score, count(*) OVER (ORDER BY score) - (count(*) OVER (PARTITION BY score) - 1) / CAST(2 AS DOUBLE) AS rnk FROM preds),
 a AS (SELECT (sum(rnk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / CAST(2 AS DOUBLE)) / CAST(count(*) FILTER (label = 1) * count(*) FILTER (label = 0) AS DOUBLE) AS auc FROM r),
 t AS (SELECT score, sum(label) AS p, count(*) AS n FROM preds GROUP BY score), c AS (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS k FROM t WINDOW w AS (ORDER BY score DESC))
SELECT round(any_value(auc), 9) AS auc, round(sum(p * CAST(tp AS DOUBLE) / k) / CAST(sum(p) AS DOUBLE), 9) AS ap FROM c, a""")
def auc_ap(spark, sf_dir):
    return evaluate.ranking(A.predictions(spark, sf_dir))


@plan("d17_low_score_errors", views="preds", sql=", q AS (SELECT pred, label, row_number() OVER (ORDER BY score, doc_id) AS r FROM preds) SELECT count(*) FILTER (pred = 1 AND label = 0) AS errors, count(*) FILTER (pred = 1 AND label = 0 AND r <= 50) AS among_lowest FROM q")
def low_score_errors(spark, sf_dir):
    p = A.predictions(spark, sf_dir)
    low = p.orderBy("score", "doc_id").limit(50).agg(F.count_if((F.col("pred") == 1) & (F.col("label") == 0)).alias("among_lowest"))
    return p.agg(F.count_if((F.col("pred") == 1) & (F.col("label") == 0)).alias("errors")).crossJoin(low)


@plan("d19_name_votes", views="votes", sql=""", t AS (SELECT stem, text, count(*) AS n, max(conf) AS c, min(ord) AS f FROM votes GROUP BY stem, text), r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY n DESC, f) AS k FROM t)
SELECT stem, max(text) FILTER (k = 1) AS top, max(n) FILTER (k = 1) AS hits, max(c) FILTER (k = 1) AS conf, string_agg(text, '|' ORDER BY k) FILTER (k BETWEEN 2 AND 7) AS others FROM r GROUP BY stem""")
def name_votes(spark, sf_dir):
    return votes.top_names(A.votes(spark, sf_dir), 6)


@plan("d20_failure_histogram", views="votes", sql="SELECT stem, count(*) FILTER (conf < 0.3) AS low, count(*) FILTER (conf >= 0.3 AND conf < 0.7) AS mid, count(*) FILTER (conf >= 0.7) AS ok FROM votes GROUP BY stem")
def failure_histogram(spark, sf_dir):
    kind = F.when(F.col("conf") < 0.3, "low").when(F.col("conf") < 0.7, "mid").otherwise("ok")
    return A.votes(spark, sf_dir).withColumn("kind", kind).groupBy("stem").pivot("kind", ["low", "mid", "ok"]).count().fillna(0)


@plan("d21_miss_causes", views="gt det", sql=intervals._NEAREST + """, m AS (SELECT CASE WHEN g.idx % 10 = 1 AND g.stem < 'v00009' THEN 'NO_SCAN' WHEN r.d IS NULL THEN 'NO_ROUND' WHEN r.d % 2 = 0 THEN 'KILLS_LOW' ELSE 'ACE_FALSE' END AS cause FROM gt g LEFT JOIN r ON r.stem = g.stem AND r.g = g.idx AND r.n = 1)
SELECT cause, count(*) AS n FROM m GROUP BY cause""")
def miss_causes(spark, sf_dir):
    best = intervals.best_rounds(spark, sf_dir).withColumnRenamed("g", "idx")
    g = A.truths(spark, sf_dir).join(best, ["stem", "idx"], "left")
    cause = F.when((F.col("idx") % 10 == 1) & (F.col("stem") < "v00009"), "NO_SCAN").when(F.col("d").isNull(), "NO_ROUND").when(F.col("d") % 2 == 0, "KILLS_LOW").otherwise("ACE_FALSE")
    return g.groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))


_D22 = """, t AS (SELECT stem, text, sum(weight) AS w, count(*) AS n FROM votes GROUP BY stem, text), s AS (SELECT stem, max(w) AS top, sum(w) AS total, max(n) / CAST(sum(n) AS DOUBLE) AS mode FROM t GROUP BY stem),
 c AS (SELECT stem, count(*) FILTER (weight = 0.5) / CAST(count(*) AS DOUBLE) AS cross_share FROM votes GROUP BY stem)"""


@plan("d22_identity_confidence", views="votes", sql=_D22 + " SELECT s.stem, round(least(CAST(1 AS DOUBLE), top / total * 0.5 + cross_share * 0.3 + mode * 0.2), 9) AS confidence FROM s JOIN c ON c.stem = s.stem")
def identity_confidence(spark, sf_dir):
    v = A.votes(spark, sf_dir)
    s = votes.summed(v).groupBy("stem").agg(F.max("weight").alias("top"), F.sum("weight").alias("total"), (F.max("samples") / F.sum("samples")).alias("mode"))
    c = v.groupBy("stem").agg((F.count_if(F.col("weight") == 0.5) / F.count("*")).alias("cross_share"))
    return s.join(c, "stem").select("stem", F.round(votes.confidence(F.col("top") / F.col("total"), F.col("cross_share"), F.col("mode")), 9).alias("confidence"))


@plan("d23_window_means", views="probs", sql="SELECT stem, CAST(floor(t / 12) AS BIGINT) AS w, round(avg(prob), 9) AS mean_prob, count(*) AS n FROM probs GROUP BY stem, CAST(floor(t / 12) AS BIGINT)")
def window_means(spark, sf_dir):
    return A.frame_probs(spark, sf_dir).groupBy("stem", F.floor(F.col("t") / 12).alias("w")).agg(F.round(F.avg("prob"), 9).alias("mean_prob"), F.count("*").alias("n"))


@plan("d24_spot_check", views="hud probs", sql=sequences.RUNS + """, c AS (SELECT stem, start, last, n, start + (last - start) * f AS at FROM runs, (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS f)),
 s AS (SELECT c.*, (SELECT arg_min(p.prob, row(abs(p.t - c.at), p.t)) FROM probs p WHERE p.stem = c.stem AND abs(p.t - c.at) <= 2) AS prob FROM c)
SELECT stem, start, count(prob) AS n_ok, any_value(n) >= 40 OR count(prob) < 3 OR max(prob) >= 0.6 AS keep FROM s GROUP BY stem, start""")
def spot_check(spark, sf_dir):
    return evaluate.spot_checks(sequences.runs(spark, sf_dir), A.frame_probs(spark, sf_dir))


@plan("d25_team_locks", views="sb", sql=""", own AS (SELECT stem, rn, arg_min(team, line) AS own FROM sb GROUP BY stem, rn), first AS (SELECT stem, arg_min(own, rn) AS team FROM own GROUP BY stem),
 sums AS (SELECT o.stem, o.rn, team, sum(CASE WHEN own = team THEN 1 ELSE -1 END) OVER (PARTITION BY o.stem ORDER BY rn) AS s FROM own o JOIN first f ON f.stem = o.stem),
 n AS (SELECT stem, team, CAST(arg_max(s, rn) - least(0, min(s)) AS INTEGER) AS confirmed FROM sums GROUP BY stem, team),
 good AS (SELECT sb.stem, sb.team, CAST(deaths AS VARCHAR) AS player, f.team AS lock FROM sb JOIN own o ON o.stem = sb.stem AND o.rn = sb.rn JOIN first f ON f.stem = sb.stem WHERE own = f.team),
 sets AS (SELECT stem, coalesce(list(DISTINCT player ORDER BY player) FILTER (team = lock AND player IS NOT NULL), []) AS mates, coalesce(list(DISTINCT player ORDER BY player) FILTER (team <> lock AND player IS NOT NULL), []) AS opponents FROM good GROUP BY stem)
SELECT n.*, mates, opponents FROM n LEFT JOIN sets s ON s.stem = n.stem""")
def team_locks(spark, sf_dir):
    return evaluate.team_locks(A.sb_rows(spark, sf_dir).select("stem", "rn", "line", "team", F.col("deaths").alias("player")))


@plan("d26_batch_totals", views="det", sql=", s AS (SELECT stem, count(*) FILTER (idx % 4 = 0) AS aces, max(d2) - min(d1) >= 2200 AS ok FROM det GROUP BY stem) SELECT count(*) FILTER (ok) AS ok, CAST(sum(aces) FILTER (ok) AS BIGINT) AS aces, count(*) FILTER (NOT ok) AS skipped FROM s")
def batch_totals(spark, sf_dir):
    s = A.detections(spark, sf_dir).groupBy("stem").agg(F.count_if(F.col("idx") % 4 == 0).alias("aces"), (F.max("d2") - F.min("d1") >= 2200).alias("good"))
    return s.agg(F.count_if("good").alias("ok"), F.sum(F.when(F.col("good"), F.col("aces"))).alias("aces"), F.count_if(~F.col("good")).alias("skipped"))


@plan("d27_soft_accept", views="votes", sql=f""", c AS (SELECT stem, {scalars._STRIP('text')} AS core, sum(weight) AS w, count(*) AS n FROM votes GROUP BY stem, {scalars._STRIP('text')}), k AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY w DESC, core) AS r FROM c WHERE length(core) >= 3)
SELECT a.stem, CASE WHEN a.n >= 2 AND (b.w IS NULL OR a.w / (a.w + b.w) >= 0.38) THEN a.core END AS accepted FROM k a LEFT JOIN k b ON b.stem = a.stem AND b.r = 2 WHERE a.r = 1""")
def soft_accept(spark, sf_dir):
    return votes.soft_accepted(A.votes(spark, sf_dir))


@plan("d28_spot_truth", views="hud", sql="SELECT count(*) AS n, count(*) FILTER (k = rn // 20) AS ok FROM hud WHERE method = 'template' AND rn % 10 = 0")
def spot_truth(spark, sf_dir):
    h = A.hud_reads(spark, sf_dir).where("rn % 10 = 0")
    truth = h.where("method = 'template'").select("stem", "rn", F.expr("rn div 20").alias("expected"))
    return truth.join(h.select("stem", "rn", "k"), ["stem", "rn"], "left").agg(F.count("*").alias("n"), F.count_if(F.col("k") == F.col("expected")).alias("ok"))


@plan("d30_d31_first_last", views="sb", sql=", r AS (SELECT stem, row_index, kills, row_number() OVER (PARTITION BY stem, row_index ORDER BY rn, line, kills) AS a, row_number() OVER (PARTITION BY stem, row_index ORDER BY rn DESC, line DESC, kills DESC) AS b FROM sb) SELECT stem, row_index, max(kills) FILTER (a = 1) AS first, max(kills) FILTER (b = 1) AS last FROM r GROUP BY stem, row_index")
def first_last(spark, sf_dir):
    key = F.struct("rn", "line", "kills")
    return A.sb_rows(spark, sf_dir).groupBy("stem", "row_index").agg(F.min_by("kills", key).alias("first"), F.max_by("kills", key).alias("last"))


@plan("e20_delta_gates", views="sb", sql=""", g AS (SELECT stem, rn, arg_min(kills, row(line, kills, coalesce(deaths, -1))) AS k, arg_min(CASE WHEN deaths IS NULL THEN -1 ELSE deaths END, row(line, kills, coalesce(deaths, -1))) AS d0, sum(kills) FILTER (team = 'red') AS team_sum FROM sb GROUP BY stem, rn),
 o AS (SELECT *, nullif(d0, -1) AS deaths, row_number() OVER w AS n, sum(k % 4) OVER w AS total FROM g WINDOW w AS (PARTITION BY stem ORDER BY rn)),
 r AS (SELECT stem, CAST(n AS INTEGER) AS round, CASE WHEN rn % 13 <> 0 THEN CAST(total % 60 AS BIGINT) END AS kills, deaths, team_sum, n - CASE WHEN rn % 17 = 0 THEN 1 ELSE 0 END AS match_total,
  CASE WHEN rn % 5 > 0 THEN n - CASE WHEN rn % 19 = 0 THEN 1 ELSE 0 END END AS team_wins, CAST(rn % 60 AS DOUBLE) AS gap, rn % 9 = 0 AS inferred, CAST(rn % 100 AS DOUBLE) / 100 AS score FROM o),
 m AS (SELECT stem, coalesce(list(gap ORDER BY gap) FILTER (gap > 0), []) AS gs FROM r GROUP BY stem), md AS (SELECT stem, coalesce(gs[len(gs) // 2 + 1], CAST(45 AS DOUBLE)) AS median FROM m),
 d AS (SELECT r.*, median, row_number() OVER w AS place, kills - lag(kills) OVER w AS delta, lag(round) OVER w AS p_round, lag(deaths) OVER w AS p_deaths, lag(team_sum) OVER w AS p_sum, lag(match_total) OVER w AS p_total, lag(team_wins) OVER w AS p_wins, lag(inferred) OVER w AS p_inferred
  FROM r JOIN md ON md.stem = r.stem WHERE kills IS NOT NULL WINDOW w AS (PARTITION BY r.stem ORDER BY round)),
 k AS MATERIALIZED (SELECT stem, round, place, kills, delta, p_round, coalesce(gap < median * CAST(0.55 AS DOUBLE), false) AS tight, CASE WHEN delta IS NULL THEN 'first' WHEN delta < 0 THEN 'reset' WHEN delta > 3 THEN 'error' WHEN delta <> 3 OR round <> p_round + 1 THEN 'none'
  WHEN gap > median * CAST(1.55 AS DOUBLE) THEN 'play_gap_wide' WHEN match_total - p_total <> 1 THEN 'match_rounds' WHEN team_wins - p_wins <> 1 THEN 'team_wins' WHEN team_sum - p_sum < 3 THEN 'team_sum' WHEN deaths > p_deaths THEN 'deaths_increased' WHEN deaths = 0 AND p_deaths >= 1 THEN 'deaths_read_zero'
  WHEN NOT inferred AND NOT p_inferred THEN 'ace' WHEN score < 0.55 THEN 'match_low' ELSE 'candidate' END AS kind FROM d),
 f(stem, place, verdict) AS (SELECT stem, place, kind FROM k WHERE place = 1 UNION ALL
  SELECT k.stem, k.place, CASE WHEN k.tight AND k.kind NOT IN ('first', 'reset', 'error', 'none', 'play_gap_wide') AND f.verdict = 'ace' THEN 'consecutive_ace' ELSE k.kind END FROM f JOIN k ON k.stem = f.stem AND k.place = f.place + 1)
SELECT k.stem, k.round, k.kills, CASE WHEN k.delta >= 0 THEN k.delta END AS delta, f.verdict FROM k JOIN f ON f.stem = k.stem AND f.place = k.place""")
def delta_gates(spark, sf_dir):
    return evaluate.counter_steps(evaluate.readouts(A.sb_rows(spark, sf_dir)))


@plan("e30_team_fallback", views="sb", sql=""", locks AS (SELECT stem, arg_min(team, row(rn, line)) AS lock FROM sb GROUP BY stem),
 g AS (SELECT sb.stem, rn, max(kills) FILTER (line = 1 AND rn % 3 <> 0) AS direct,
  coalesce(list({'c': -coalesce(CAST(deaths % 10 AS DOUBLE) / 10, 0), 'i': row_index, 'k': kills} ORDER BY -coalesce(CAST(deaths % 10 AS DOUBLE) / 10, 0), row_index, kills) FILTER (team = lock AND kills IS NOT NULL), []) AS cands FROM sb JOIN locks l ON l.stem = sb.stem GROUP BY sb.stem, rn),
 n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY rn) AS place FROM g),
 f(stem, place, rn, last, kills, inferred, score) AS (SELECT stem, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, false, NULL::DOUBLE FROM locks UNION ALL
  SELECT stem, place, rn, coalesce(direct, best.k, last), coalesce(direct, best.k), direct IS NULL AND best IS NOT NULL, CASE WHEN direct IS NOT NULL THEN 1 ELSE round(-best.c * CAST(0.6 AS DOUBLE), 3) END FROM (
   SELECT n.stem, n.place, n.rn, n.direct, f.last, list_filter(n.cands, lambda c: f.last IS NULL OR c.k = 0 OR c.k - f.last BETWEEN 0 AND 5)[1] AS best FROM f JOIN n ON n.stem = f.stem AND n.place = f.place + 1))
SELECT stem, rn, kills, inferred, score FROM f WHERE place > 0""")
def team_fallback(spark, sf_dir):
    return evaluate.team_fallback(A.sb_rows(spark, sf_dir))


@plan("e31_tiered_reads", views="sb", sql=""", t AS (SELECT stem, rn, CASE WHEN count(*) FILTER (line % 2 = 1 AND kills > 25) > 0 THEN 1 ELSE 2 END AS tier FROM sb GROUP BY stem, rn)
SELECT t.stem, t.rn, t.tier, max(kills) AS kills, count(*) AS n FROM t JOIN sb ON sb.stem = t.stem AND sb.rn = t.rn AND (t.tier = 2 OR line % 2 = 1) GROUP BY t.stem, t.rn, t.tier""")
def tiered_reads(spark, sf_dir):
    """A coarse sample of each round, and all of it only where the coarse one shows nothing."""
    coarse = F.col("line") % 2 == 1
    s = A.sb_rows(spark, sf_dir).groupBy("stem", "rn").agg(F.count_if(coarse & (F.col("kills") > 25)).alias("hit"), F.max(F.when(coarse, F.col("kills"))).alias("k1"), F.count_if(coarse).alias("n1"), F.max("kills").alias("k2"), F.count("*").alias("n2"))
    hit = F.col("hit") > 0
    return s.select("stem", "rn", F.when(hit, 1).otherwise(2).alias("tier"), F.when(hit, F.col("k1")).otherwise(F.col("k2")).alias("kills"), F.when(hit, F.col("n1")).otherwise(F.col("n2")).alias("n"))


# --- order, samples and generators ---------------------------------------


@plan("f1_review_queue", views="preds", sql="SELECT doc_id, score FROM preds WHERE label = 0 ORDER BY score, doc_id LIMIT 10")
def review_queue(spark, sf_dir):
    return A.predictions(spark, sf_dir).where("label = 0").orderBy("score", "doc_id").limit(10).select("doc_id", "score")


@plan("f2_top_clusters", views="votes", sql=", t AS (SELECT stem, text, sum(weight) AS w, row_number() OVER (PARTITION BY stem ORDER BY sum(weight) DESC, text) AS k FROM votes GROUP BY stem, text) SELECT stem, text, w, k FROM t WHERE k <= 3")
def top_clusters(spark, sf_dir):
    t = A.votes(spark, sf_dir).groupBy("stem", "text").agg(F.sum("weight").alias("w"))
    return t.withColumn("k", F.row_number().over(W.partitionBy("stem").orderBy(F.desc("w"), "text")).cast("bigint")).where("k <= 3")


@plan("f3_even_sample", views="hud", sql=""", r AS (SELECT stem, rn, row_number() OVER (PARTITION BY stem ORDER BY rn) - 1 AS i, count(*) OVER (PARTITION BY stem) AS m FROM hud)
SELECT stem, rn FROM r WHERE i IN (SELECT unnest(list_transform(range(0, 7), lambda j: CAST(round_even(j * (r.m - 1) / CAST(6 AS DOUBLE), 0) AS BIGINT))))""")
def even_sample(spark, sf_dir):
    return generate.even_sample(A.hud_reads(spark, sf_dir), 7, order="rn").select("stem", "rn")


@plan("f4_strided_pick", views="hud", sql=sequences.RUNS + """, r AS (SELECT stem, start, row_number() OVER (PARTITION BY stem ORDER BY start) - 1 AS i, count(*) OVER (PARTITION BY stem) AS m FROM runs)
SELECT stem, start FROM r WHERE m <= 2 OR i IN (0, CAST(floor(m / CAST(2 AS DOUBLE)) AS BIGINT))""")
def strided_pick(spark, sf_dir):
    w = W.partitionBy("stem")
    r = sequences.runs(spark, sf_dir).withColumns({"i": F.row_number().over(w.orderBy("start")) - 1, "m": F.count("*").over(w)})
    return r.where((F.col("m") <= 2) | (F.col("i") == 0) | (F.col("i") == F.floor(F.col("m") / 2))).select("stem", "start")


@plan("f5_f7_first_messages", views="det", sql="SELECT stem, idx FROM det ORDER BY stem, d1, idx LIMIT 25")
def first_messages(spark, sf_dir):
    return A.detections(spark, sf_dir).orderBy("stem", "d1", "idx").limit(25).select("stem", "idx")


@plan("f6_seeded_sample", sql="SELECT page_id FROM pages ORDER BY sha1(concat('11|', url)), page_id LIMIT 40")
def seeded_sample(spark, sf_dir):
    return generate.seeded_sample(A.table(spark, sf_dir, "pages"), "url", 40, 11, "page_id").select("page_id")


@plan("g1_union_sources", views="gt det", sql="SELECT source, count(*) AS n FROM (SELECT 'truth' AS source, stem FROM gt UNION ALL SELECT 'detected', stem FROM det) GROUP BY source")
def union_sources(spark, sf_dir):
    g, d = A.truths(spark, sf_dir), A.detections(spark, sf_dir)
    both = g.select(F.lit("truth").alias("source"), "stem").unionByName(d.select(F.lit("detected").alias("source"), "stem"))
    return both.groupBy("source").agg(F.count("*").alias("n"))


@plan("g2_distinct_times", views="gt det", sql="SELECT stem, g1 AS t FROM gt UNION SELECT stem, d1 FROM det")
def distinct_times(spark, sf_dir):
    return A.truths(spark, sf_dir).select("stem", F.col("g1").alias("t")).union(A.detections(spark, sf_dir).select("stem", "d1")).distinct()


@plan("g3_valid_rounds", views="det", sql="(SELECT idx FROM det WHERE idx % 4 = 0 UNION SELECT idx FROM det WHERE idx % 5 = 0) EXCEPT SELECT idx FROM det WHERE idx % 7 = 0")
def valid_rounds(spark, sf_dir):
    d = A.detections(spark, sf_dir).select("idx")
    return d.where("idx % 4 = 0").union(d.where("idx % 5 = 0")).subtract(d.where("idx % 7 = 0"))


@plan("g4_false_positives", views="gt det", sql=intervals._PAIRS + " SELECT stem, idx FROM det WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.stem = det.stem AND p.d = det.idx)")
def false_positives(spark, sf_dir):
    hit = intervals.pairs(spark, sf_dir).select("stem", F.col("d").alias("idx")).distinct()
    return A.detections(spark, sf_dir).select("stem", "idx").join(hit, ["stem", "idx"], "left_anti")


@plan("g6_group_split", views="preds", sql="SELECT doc_id, CASE WHEN grp IN (SELECT DISTINCT grp FROM preds WHERE doc_id % 97 = 0) THEN 'val' ELSE 'train' END AS part FROM preds")
def group_split(spark, sf_dir):
    p = A.predictions(spark, sf_dir)
    held = p.where("doc_id % 97 = 0").select("grp").distinct().withColumn("held", F.lit(True))
    return p.join(held, "grp", "left").select("doc_id", F.when(F.col("held"), "val").otherwise("train").alias("part"))


@plan("h1_sliding_windows", views="hud", sql="SELECT stem, CAST(i * 6 AS DOUBLE) AS start, CAST(i * 6 + 12 AS DOUBLE) AS \"end\" FROM (SELECT stem, max(t) AS d FROM hud GROUP BY stem), (SELECT unnest(range(0, 400)) AS i) WHERE i * 6 + 12 <= d + 0.01")
def sliding_windows(spark, sf_dir):
    return generate.sliding(A.hud_reads(spark, sf_dir).groupBy("stem").agg(F.max("t").alias("duration")))


@plan("h2_chunk_plan", views="hud", sql="SELECT stem, CAST(i * 12 AS DOUBLE) AS start, least(CAST(i * 12 + 12 AS DOUBLE), d) AS \"end\" FROM (SELECT stem, max(t) AS d FROM hud GROUP BY stem), (SELECT unnest(range(0, 100)) AS i) WHERE i * 12 + 6 <= d + 0.05")
def chunk_plan(spark, sf_dir):
    return generate.chunks(A.hud_reads(spark, sf_dir).groupBy("stem").agg(F.max("t").alias("duration")), cap=100)


@plan("h3_h4_sample_times", views="hud", sql=sequences.RUNS + """, c AS (SELECT stem, start, last, CAST(ceil((last - start) * 2) AS BIGINT) AS n FROM runs)
SELECT stem, start, CASE WHEN n = 0 THEN (start + last) / 2 ELSE start + i / CAST(2 AS DOUBLE) END AS at FROM c, (SELECT unnest(range(0, 4000)) AS i) WHERE i < greatest(n, 1)""")
def sample_times(spark, sf_dir):
    return generate.sample_times(sequences.runs(spark, sf_dir), 2.0)


@plan("h5_recording_grid", views="hud", sql="SELECT stem, i, round(least(60, d * 0.05) + i * (d - 30 - least(60, d * 0.05)) / 9, 6) AS at FROM (SELECT stem, max(t) AS d FROM hud GROUP BY stem), (SELECT unnest(range(0, 10)) AS i)")
def recording_grid(spark, sf_dir):
    return generate.grid(A.hud_reads(spark, sf_dir).groupBy("stem").agg(F.max("t").alias("duration")), 10)


@plan("h6_oversampling", views="preds", sql="SELECT doc_id, CASE WHEN label = 0 THEN i ELSE 1 END AS copy FROM preds, (SELECT unnest(range(1, 4)) AS i) WHERE label = 0 OR i = 1")
def oversampling(spark, sf_dir):
    return generate.repeated(A.predictions(spark, sf_dir), F.when(F.col("label") == 0, 3).otherwise(1)).select("doc_id", "copy")


@plan("h8_label_template", sql="SELECT s.source, n.n, concat(s.source, '_', lpad(CAST(n.n AS VARCHAR), 3, '0')) AS row_id, CASE WHEN n.n <= s.m THEN 'listed' ELSE 'blank' END AS kind FROM (SELECT source, least(count(*), 5) AS m FROM documents GROUP BY source) s, (SELECT unnest(range(1, 11)) AS n) n WHERE n.n <= s.m + 5")
def label_template(spark, sf_dir):
    s = A.table(spark, sf_dir, "documents").groupBy("source").agg(F.least(F.count("*"), F.lit(5)).alias("m"))
    rows = s.withColumn("n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m") + 5)))
    return rows.select("source", "n", F.concat_ws("_", "source", F.lpad(F.col("n").cast("string"), 3, "0")).alias("row_id"), F.when(F.col("n") <= F.col("m"), "listed").otherwise("blank").alias("kind"))


@plan("h9_frame_plan", views="det", sql="SELECT stem, idx, CASE WHEN idx % 4 = 0 THEN 'positive' ELSE 'negative' END AS kind, CASE WHEN idx % 4 = 0 THEN greatest(0, d1 - 2.5) ELSE d1 END + i * 0.5 AS at FROM det, (SELECT unnest(range(0, 3)) AS i)")
def frame_plan(spark, sf_dir):
    pos = F.col("idx") % 4 == 0
    start = F.when(pos, F.greatest(F.lit(0.0), F.col("d1") - 2.5)).otherwise(F.col("d1"))
    rows = A.detections(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return rows.select("stem", "idx", F.when(pos, "positive").otherwise("negative").alias("kind"), (start + F.col("i") * 0.5).alias("at"))


@plan("b37_vote_construction", views="votes", sql="""SELECT ord, CASE WHEN ord % 3 = 0 AND conf >= 0.3 THEN 'strong' WHEN ord % 3 = 1 AND conf >= 0.3 THEN 'weak' ELSE 'scoreboard' END AS kind,
 CAST(CASE WHEN ord % 3 = 0 AND conf >= 0.3 THEN 2.5 WHEN ord % 3 = 1 AND conf >= 0.3 THEN 0.35 ELSE 0.5 END AS DOUBLE) AS weight FROM votes WHERE (ord % 3 < 2 AND conf >= 0.3) OR (ord % 3 = 2 AND conf >= 0.35)""")
def vote_construction(spark, sf_dir):
    v, o = A.votes(spark, sf_dir), F.col("ord")
    made = lambda df, kind, weight: df.select("ord", F.lit(kind).alias("kind"), F.lit(weight).alias("weight"))
    return made(v.where((o % 3 == 0) & (F.col("conf") >= 0.3)), "strong", 2.5).unionByName(made(v.where((o % 3 == 1) & (F.col("conf") >= 0.3)), "weak", 0.35)).unionByName(made(v.where((o % 3 == 2) & (F.col("conf") >= 0.35)), "scoreboard", 0.5))
