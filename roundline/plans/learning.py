"""Similarity, clustering and learned verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import similarity, verify
from ..sources import adapters as A
from ..sources import files
from .base import plan
from .intervals import GREEDY

_BITS = "list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)"
_IOU = "coalesce(list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: z[1] * z[2])) / CAST(nullif(list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: greatest(z[1], z[2]))), 0) AS DOUBLE), 0)"
_VECTORS = f", v AS (SELECT vec_id, label, {_BITS} AS bits FROM embeddings)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "embeddings").select("vec_id", "label", similarity.binary(F.col("embedding")).alias("bits"))


_PAIRED = "FROM v a JOIN v b ON b.label = a.label AND b.vec_id > a.vec_id"
_MOVED = ", ".join(_IOU.replace("b.bits", x) for x in ("b.bits", "list_concat(b.bits[2:], [0])", "list_concat([0], b.bits[:len(b.bits) - 1])"))


@plan("j1_pair_similarity", views="gt", sql=_VECTORS + f" SELECT a.label, a.vec_id AS a, b.vec_id AS b, round({_IOU}, 9) AS iou {_PAIRED} WHERE {_IOU} >= 0.5")
def pair_similarity(spark, sf_dir):
    return similarity.similar_pairs(vectors(spark, sf_dir), 0.5)


@plan("j1_shifted_similarity", views="gt", sql=_VECTORS + f" SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(greatest({_MOVED}), 9) AS iou {_PAIRED} WHERE greatest({_MOVED}) >= 0.5")
def shifted_similarity(spark, sf_dir):
    return similarity.similar_pairs(vectors(spark, sf_dir), 0.5, (0, -1, 1))


@plan("j2_leader_clusters", views="gt", sql=_VECTORS + f""", p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, round({_IOU}, 9) AS iou {_PAIRED} WHERE {_IOU} >= 0.5),
 o AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r FROM v),
 e AS MATERIALIZED (SELECT o.r, o.vec_id, coalesce(list(p.a) FILTER (p.a IS NOT NULL), []) AS near FROM o LEFT JOIN p ON p.b = o.vec_id GROUP BY o.r, o.vec_id),
 lead(r, leaders) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT e.r, CASE WHEN len(list_intersect(e.near, l.leaders)) = 0 THEN list_append(l.leaders, e.vec_id) ELSE l.leaders END FROM lead l JOIN e ON e.r = l.r + 1),
 z AS (SELECT unnest(leaders) AS leader FROM lead WHERE r = (SELECT max(r) FROM lead))
SELECT leader AS vec_id, leader FROM z UNION ALL SELECT p.b, arg_min(p.a, row(-p.iou, p.a)) FROM p WHERE p.a IN (SELECT leader FROM z) AND p.b NOT IN (SELECT leader FROM z) GROUP BY p.b""")
def leader_clusters(spark, sf_dir):
    return similarity.leader_clusters(vectors(spark, sf_dir), files.scratch(spark, "leaders"), least=0.5)


@plan("e27_near_repeats")
def near_repeats(spark, sf_dir):
    """A recording of the fixture holds a hundred vectors; its slots are the classes."""
    slot = F.concat_ws("/", F.expr("vec_id div 100").cast("string"), F.col("label").cast("string"))
    return similarity.without_near_repeats(vectors(spark, sf_dir).withColumn("slot", slot), least=0.5)


@plan("j3_medoids", views="gt", sql=_VECTORS + f""", f AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM v), p AS (SELECT a.label, a.vec_id, round(avg({_IOU}), 9) AS mean FROM f a JOIN f b ON b.label = a.label AND b.vec_id <> a.vec_id WHERE a.r <= 60 AND b.r <= 60 GROUP BY a.label, a.vec_id)
SELECT label, arg_min(vec_id, row(-mean, vec_id)) AS medoid, max(mean) AS mean FROM p GROUP BY label""")
def medoids(spark, sf_dir):
    return similarity.medoids(vectors(spark, sf_dir))


_CLAIMS = _VECTORS + f""", proto AS (SELECT * FROM v WHERE vec_id IN (SELECT min(vec_id) FROM v GROUP BY label)), s AS (SELECT a.vec_id, b.label, max(round({_IOU}, 9)) AS score FROM v a, proto b GROUP BY a.vec_id, b.label),
 r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS k, lead(score) OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS second FROM s)"""


@plan("j4_prototype_claims", views="gt", sql=_CLAIMS + " SELECT vec_id, label AS best, score, CASE WHEN score >= 0.55 AND score - second >= 0.06 THEN label END AS claimed FROM r WHERE k = 1")
def prototype_claims(spark, sf_dir):
    v = vectors(spark, sf_dir)
    first = v.groupBy("label").agg(F.min_by("bits", "vec_id").alias("bits"))
    return similarity.claims(v, first, 0.55, 0.06)


@plan("j5_nearest_template", views="gt", sql=_CLAIMS + " SELECT vec_id, label AS best, score FROM r WHERE k = 1")
def nearest_template(spark, sf_dir):
    return prototype_claims(spark, sf_dir).select("vec_id", "best", "score")


@plan("k1_k2_feature_table", sql=r"""SELECT d.doc_id, CAST(l.quality AS BIGINT) AS label, d.source AS grp, CAST(d.n_chars AS DOUBLE) AS n_chars, CAST(len(string_split(d.text, ' ')) AS DOUBLE) AS n_words, CAST(len(string_split(d.text, chr(10))) AS DOUBLE) AS n_lines,
 round(length(regexp_replace(d.text, '[^A-Z]', '', 'g')) / CAST(greatest(1, length(d.text)) AS DOUBLE), 9) AS share_upper, CAST(d.doc_id % 100 AS DOUBLE) / 100 AS position FROM documents d JOIN labels l ON l.doc_id = d.doc_id""")
def feature_table(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").join(A.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    upper = F.length(F.regexp_replace("text", "[^A-Z]", "")) / F.greatest(F.lit(1), F.length("text"))
    return d.select("doc_id", F.col("quality").cast("bigint").alias("label"), F.col("source").alias("grp"), F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split("text", " ")).cast("double").alias("n_words"), F.size(F.split("text", "\n")).cast("double").alias("n_lines"), F.round(upper, 9).alias("share_upper"), ((F.col("doc_id") % 100).cast("double") / 100).alias("position"))


_READ_QUALITY = ", q AS (SELECT stem, CASE WHEN count(k) + count(*) FILTER (k IS NULL AND method IN ('template_miss', 'triple_incomplete', 'row_miss')) > 0 THEN CAST(count(k) AS DOUBLE) / (count(k) + count(*) FILTER (k IS NULL AND method IN ('template_miss', 'triple_incomplete', 'row_miss'))) ELSE -1 END AS read_quality FROM hud GROUP BY stem)"
_FEATURES = _READ_QUALITY + """, n AS (SELECT *, lag(kills) OVER w AS p, lead(kills) OVER w AS f, count(*) OVER (PARTITION BY stem) AS total, greatest(e - s, 1) AS longest FROM tl WINDOW w AS (PARTITION BY stem ORDER BY seg)),
 x AS (SELECT n.stem, n.seg, n.s AS start, n.e AS "end", list_max(kill_times) - list_min(kill_times) AS width, CAST(CASE WHEN list_max(kill_times) = list_min(kill_times) THEN 1 ELSE 0 END AS DOUBLE) AS width0,
  CAST(len(list_filter(kill_times, lambda t: t = n.s)) AS DOUBLE) AS n_start_kills, first_kill - n.s AS first_kill_off, n.e - ace_sec AS ace_off_end, n.e - n.s AS dur, k_samples / longest AS k_density, CAST(k_samples AS DOUBLE) AS k_samples,
  CAST(CASE WHEN reset THEN 1 ELSE 0 END AS DOUBLE) AS resets, CAST(coalesce(p, -1) AS DOUBLE) AS prev_kills, CAST(coalesce(f, -1) AS DOUBLE) AS next_kills, coalesce(read_quality, -1) AS read_quality, seg / CAST(total AS DOUBLE) AS round_pos,
  list_sum(list_transform(kill_times, lambda t: (t - n.s) / longest)) / len(kill_times) AS kt_rel, CAST((SELECT count(*) FROM points o WHERE o.stem = n.stem AND o.t >= n.s AND o.t <= n.e) AS DOUBLE) AS score_win_count
  FROM n LEFT JOIN q ON q.stem = n.stem WHERE ace)"""
_ROUNDED = ", ".join(f"round({f}, 9) AS {f}" for f in verify.FEATURES)
_LABELS = """, gt AS (SELECT * FROM aces), det AS (SELECT stem, seg AS idx, coalesce(nullif(first_kill, 0), s) AS d1, greatest(coalesce(nullif(first_kill, 0), s), coalesce(nullif(ace_sec, 0), e)) AS d2 FROM tl WHERE ace AND stem IN (SELECT stem FROM aces))""" + GREEDY + ", labelled AS (SELECT det.stem, det.idx AS seg, CAST(count(hits.hit) AS BIGINT) AS label FROM det LEFT JOIN hits ON hits.stem = det.stem AND hits.hit = det.idx GROUP BY det.stem, det.idx)"


def ace_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.ace_features(A.timelines(spark, sf_dir), A.hud_reads(spark, sf_dir), A.score_wins(spark, sf_dir))


def labelled_aces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, str]:
    """(features of all aces, of the labelled ones with ``label``, folder): written tables."""
    folder = files.scratch(spark, "verifier")
    rounds = files.written(A.timelines(spark, sf_dir), "rounds")  # features and labels take them four times
    aces = files.written(verify.ace_features(rounds, A.hud_reads(spark, sf_dir), A.score_wins(spark, sf_dir)), "aces")
    labels = verify.ace_labels(rounds, A.true_aces(spark, sf_dir))
    return aces, files.written(aces.join(labels, ["stem", "seg"]), "labelled"), folder


def rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f: F.round(f, 9) for f in verify.FEATURES})


@plan("k1_ace_features", views="hud tl points", sql=_FEATURES + f' SELECT stem, seg, start, "end", {_ROUNDED} FROM x')
def feature_rows(spark, sf_dir):
    """The 15 features of all aces of the stored rounds."""
    return rounded(ace_features(spark, sf_dir))


@plan("k2_labelled_aces", views="hud tl points aces", sql=_FEATURES + _LABELS + f' SELECT stem, seg, label, start, "end", {_ROUNDED} FROM x JOIN labelled USING (stem, seg)')
def labelled_rows(spark, sf_dir):
    """The aces of recordings with truths, labelled by the one-to-one match within 15 s."""
    labels = verify.ace_labels(A.timelines(spark, sf_dir), A.true_aces(spark, sf_dir))
    return rounded(ace_features(spark, sf_dir).join(labels, ["stem", "seg"]))


def _all_scored(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    aces, rows, _ = labelled_aces(spark, sf_dir)
    scores = verify.scored(verify.fit(rows, verify.FEATURES, kind), aces)
    return scores.join(rows.select("stem", "seg", "label"), ["stem", "seg"], "left").select("stem", "seg", "label", F.round("score", 6).alias("score"))


@plan("k3_k7_logistic_scores")
def logistic_scores(spark, sf_dir):
    """All aces, labelled or not, scored by the fit on the labelled ones."""
    return _all_scored(spark, sf_dir, "logistic")


@plan("k4_tree_scores")
def tree_scores(spark, sf_dir):
    return _all_scored(spark, sf_dir, "trees")


@plan("k5_k6_out_of_fold")
def out_of_fold(spark, sf_dir):
    """Every labelled ace scored by the regression that saw no ace of its recording."""
    _, rows, folder = labelled_aces(spark, sf_dir)
    _, out = verify.left_out(rows, verify.FEATURES, "logistic", folder)
    return out.select("stem", "seg", "label", F.round("score", 6).alias("score"))


@plan("k6_model_choice")
def model_choice(spark, sf_dir):
    """Both kinds by AUC with each recording left out in turn; the chosen one is saved."""
    _, rows, folder = labelled_aces(spark, sf_dir)
    return verify.choice_report(rows, verify.FEATURES, folder)


@plan("k6_permutation_importance")
def permutation_importance(spark, sf_dir):
    _, rows, _ = labelled_aces(spark, sf_dir)
    return verify.permutation_importance(verify.fit(rows, verify.FEATURES), rows)


@plan("k1_round_features")
def round_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and labels of the aces of the settled rounds, which are written once; a round's
    kills decide what an ace is (urgent orders are the fixture's true spans here)."""
    from . import judging, sequences

    rounds = files.written(judging.verdicts(spark, sf_dir).where("seg is not null"), "verdicts")
    wins = sequences.score_events(spark, sf_dir).where("kind = 'win'").select("stem", F.col("t_hi").alias("t"))
    urgent = A.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("idx"))
    true = A.truths(spark, sf_dir).join(urgent, "idx")
    return verify.ace_labels(rounds, true).join(verify.ace_features(rounds, A.hud_reads(spark, sf_dir), wins), ["stem", "seg"])
