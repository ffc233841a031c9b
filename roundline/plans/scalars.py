"""Scalar rules over the fixture views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import guards, labels, names, times
from ..operators import name_index
from ..sources import adapters as A
from .base import plan


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# --- times ---------------------------------------------------------------

_RAW_TIMES = """, raw AS (SELECT event_id, CAST(event_id % 7 AS INTEGER) AS kind,
  CASE event_id % 7 WHEN 0 THEN CAST(event_id % 90 AS VARCHAR) WHEN 1 THEN concat(event_id % 70, ':', lpad(CAST(event_id % 60 AS VARCHAR), 2, '0'))
   WHEN 2 THEN concat(event_id % 3, ':', event_id % 60, ':', event_id % 59) WHEN 3 THEN event_type WHEN 4 THEN concat(' ', event_id % 9, ':05 ')
   WHEN 5 THEN concat(event_id % 9, ':x') ELSE '1:2:3:4' END AS raw FROM ev)"""


def _raw_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, s = F.col("event_id"), lambda n: (F.col("event_id") % n).cast("string")
    kinds = [s(90), F.concat(s(70), F.lit(":"), F.lpad(s(60), 2, "0")), F.concat_ws(":", s(3), s(60), s(59)), F.col("event_type"), F.concat(F.lit(" "), s(9), F.lit(":05 ")), F.concat(s(9), F.lit(":x"))]
    raw = F.lit("1:2:3:4")
    for n, x in reversed(list(enumerate(kinds))):
        raw = F.when(i % 7 == n, x).otherwise(raw)
    return A.table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))


@plan("b1_parse_time", views="ev", sql=_RAW_TIMES + """
SELECT event_id, CAST(CASE WHEN regexp_full_match(trim(raw), '\\d+') THEN CAST(trim(raw) AS BIGINT)
  WHEN regexp_full_match(trim(raw), '\\d+:\\d+') THEN CAST(split_part(trim(raw), ':', 1) AS BIGINT) * 60 + CAST(split_part(trim(raw), ':', 2) AS BIGINT)
  WHEN regexp_full_match(trim(raw), '\\d+:\\d+:\\d+') THEN CAST(split_part(trim(raw), ':', 1) AS BIGINT) * 3600 + CAST(split_part(trim(raw), ':', 2) AS BIGINT) * 60 + CAST(split_part(trim(raw), ':', 3) AS BIGINT)
  END AS DOUBLE) AS sec FROM raw""")
def parse_time(spark, sf_dir):
    return _raw_times(spark, sf_dir).select("event_id", times.parse_time(F.col("raw")).alias("sec"))


@plan("b2_mss", views="ev", sql="""SELECT event_id, concat(CAST(floor(t) AS BIGINT) // 60, ':', lpad(CAST(CAST(floor(t) AS BIGINT) % 60 AS VARCHAR), 2, '0')) AS mss FROM ev""")
def mss(spark, sf_dir):
    return A.numbered_events(spark, sf_dir).select("event_id", times.mss(F.col("t")).alias("mss"))


@plan("b3_time_texts", sql="""SELECT event_id,
  concat(floor(s / 60)::BIGINT, ':', lpad(printf('%.2f', s - floor(s / 60) * 60), 5, '0')) AS mss_hundredths,
  concat(r // 3600, ':', lpad(((r % 3600) // 60)::VARCHAR, 2, '0'), ':', lpad((r % 60)::VARCHAR, 2, '0')) AS hms,
  concat(lpad((r // 3600)::VARCHAR, greatest(2, length((r // 3600)::VARCHAR))::INTEGER, '0'), 'h', lpad(((r % 3600) // 60)::VARCHAR, 2, '0'), 'm', lpad((r % 60)::VARCHAR, 2, '0'), 's') AS stamp
 FROM (SELECT event_id, s, CAST(round_even(s, 0) AS BIGINT) AS r FROM (SELECT event_id, CAST(event_id AS DOUBLE) / 4 AS s FROM events))""")
def time_texts(spark, sf_dir):
    s = F.col("event_id").cast("double") / 4
    return A.table(spark, sf_dir, "events").select("event_id", times.mss_hundredths(s).alias("mss_hundredths"), times.hms(s).alias("hms"), times.hms(s, "%02dh%02dm%02ds").alias("stamp"))


@plan("b29_frame_stride", views="ev", sql="SELECT stem, rn FROM ev WHERE (rn - 1) % greatest(1, CAST(round_even(60.0 / 8, 0) AS BIGINT)) = 0")
def frame_stride(spark, sf_dir):
    return A.numbered_events(spark, sf_dir).where((F.col("rn") - 1) % times.stride_step(60.0, 8.0) == 0).select("stem", "rn")


# --- labels and ids -------------------------------------------------------

_SPELLINGS = [" Ace ", "TRIPLE", "더블킬", "bg", "unknown", "", "clutch"]
_SPELL_SQL = "(" + "list_value(" + ", ".join(_lit(x) for x in _SPELLINGS) + ")[o_orderkey % 7 + 1])"
_ALIAS_SQL = "CASE lower(trim(raw)) " + " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in labels.ALIASES.items()) + " END"


def _spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders")
    path = F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("rec/"), F.col("o_custkey").cast("string"), F.lit(".mp4"))).otherwise("")
    t = F.when(F.col("o_orderkey") % 11 > 0, F.col("o_totalprice") / 100)
    return o.select("o_orderkey", "o_custkey", F.get(F.array(*map(F.lit, _SPELLINGS)), (F.col("o_orderkey") % 7).cast("int")).alias("raw"), path.alias("path"), t.alias("t"))


_SPELLED_SQL = f""", spelled AS (SELECT o_orderkey, o_custkey, {_SPELL_SQL} AS raw, CASE WHEN o_orderkey % 5 > 0 THEN concat('rec/', o_custkey, '.mp4') ELSE '' END AS path,
  CASE WHEN o_orderkey % 11 > 0 THEN o_totalprice / 100 END AS t FROM orders)"""


@plan("b4_label_alias", sql=f"SELECT o_orderkey, {_ALIAS_SQL} AS label FROM (SELECT o_orderkey, {_SPELL_SQL} AS raw FROM orders)")
def label_alias(spark, sf_dir):
    return _spelled(spark, sf_dir).select("o_orderkey", labels.normal_label(F.col("raw")).alias("label"))


@plan("b6_resolved_label", views="gt", sql=_SPELLED_SQL + f"""
SELECT o_orderkey, CASE WHEN trim(raw) <> '' THEN {_ALIAS_SQL} WHEN path <> '' AND t IS NOT NULL THEN 'multikill' END AS label FROM spelled""")
def resolved_label(spark, sf_dir):
    return _spelled(spark, sf_dir).select("o_orderkey", labels.resolved_label(F.col("raw"), F.col("path"), F.col("t")).alias("label"))


_ROUND_TEXTS = ["Single shot", "전체스코어, later", "Victory WIN", "게임대기실, 방송종료", "nothing", "LOADING death", "player death"]
_KEY_SQL = "CASE " + " ".join(f"WHEN contains(main, {_lit(k)}) THEN {_lit(v)}" for k, v in labels.KEYWORDS) + " END"


@plan("b5_keyword_label", sql=f"""SELECT o_orderkey, {_KEY_SQL} AS label FROM (SELECT o_orderkey, lower(trim(split_part(
  list_value({', '.join(_lit(x) for x in _ROUND_TEXTS)})[o_orderkey % 7 + 1], ',', 1))) AS main FROM orders)""")
def keyword_label(spark, sf_dir):
    raw = F.get(F.array(*map(F.lit, _ROUND_TEXTS)), (F.col("o_orderkey") % 7).cast("int"))
    return A.table(spark, sf_dir, "orders").select("o_orderkey", labels.keyword_label(raw).alias("label"))


@plan("b7_segment_id", sql="""SELECT page_id, concat('save_', substr(sha1(concat(url, '|', printf('%.3f', page_id / CAST(7 AS DOUBLE)), '|', printf('%.3f', page_id / CAST(7 AS DOUBLE) + 12), '|', 'save')), 1, 12)) AS segment_id,
  substr(sha1(url), 1, 12) AS clip_id FROM pages""")
def segment_id(spark, sf_dir):
    t = F.col("page_id") / 7
    return A.table(spark, sf_dir, "pages").select("page_id", labels.segment_id(F.col("url"), t, t + 12, F.lit("save")).alias("segment_id"), F.substring(F.sha1(F.col("url").cast("binary")), 1, 12).alias("clip_id"))


_SPLIT_SQL = "CASE WHEN h < 80 THEN 'train' WHEN h < 90 THEN 'val' ELSE 'test' END"


@plan("b8_stable_split", sql=f"""SELECT page_id, {_SPLIT_SQL} AS split FROM (SELECT page_id, CAST(concat('0x', substr(sha1(concat('42|', url)), 1, 8)) AS UBIGINT) % 100 AS h FROM pages)""")
def stable_split(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", labels.stable_split(F.col("url")).alias("split"))


@plan("b9_pick_split", sql=f"""SELECT split, count(*) AS n FROM (SELECT {_SPLIT_SQL} AS split FROM (SELECT CAST(concat('0x', substr(sha1(concat('7|', CAST(doc_id AS VARCHAR))), 1, 8)) AS UBIGINT) % 100 AS h FROM documents)) GROUP BY split""")
def pick_split(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").groupBy(labels.stable_split(F.col("doc_id").cast("string"), seed=7).alias("split")).agg(F.count("*").alias("n"))


@plan("b10_event_window", sql="SELECT o_orderkey, s AS start_sec, greatest(s + 1, t + a) AS end_sec FROM (SELECT o_orderkey, t, a, greatest(0, t - 8) AS s FROM (SELECT o_orderkey, CAST(o_orderkey % 50 AS DOUBLE) AS t, CAST(o_orderkey % 3 AS DOUBLE) - 9 AS a FROM orders))")
def event_window(spark, sf_dir):
    i = F.col("o_orderkey")
    s, e = guards.event_window((i % 50).cast("double"), F.lit(8.0), (i % 3).cast("double") - 9)
    return A.table(spark, sf_dir, "orders").select("o_orderkey", s.alias("start_sec"), e.alias("end_sec"))


def _rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    start = (i % 900).cast("double")
    first = F.when(i % 4 > 0, start + i % 31)
    return A.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", start.alias("s"), (start + 20 + i % 77).alias("e"), first.alias("f"), F.when(i % 4 > 1, first + i % 23).alias("a"))


_ROUNDS = """, r AS (SELECT o_orderkey, o_custkey, CAST(o_orderkey % 900 AS DOUBLE) AS s, CAST(o_orderkey % 900 + 20 + o_orderkey % 77 AS DOUBLE) AS e,
  CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 900 + o_orderkey % 31 AS DOUBLE) END AS f, CASE WHEN o_orderkey % 4 > 1 THEN CAST(o_orderkey % 900 + o_orderkey % 31 + o_orderkey % 23 AS DOUBLE) END AS a FROM orders)"""


@plan("b11_ace_window", views="gt", sql=_ROUNDS + """, w AS (SELECT *, greatest(0, CASE WHEN f IS NULL THEN s - 6 ELSE least(s - 6, f - 14) END) AS w1,
   CASE WHEN a IS NULL THEN e + 1.5 ELSE least(e + 1.5, greatest(a + 12, e + 0.5)) END AS w2 FROM r),
 c AS (SELECT *, CASE WHEN w2 - w1 > 55 THEN w2 - 55 ELSE w1 END AS w3 FROM w)
SELECT o_orderkey, CAST(CASE WHEN w2 - w3 < 12 THEN greatest(0, w2 - 12) ELSE w3 END AS DOUBLE) AS clip_start, CAST(w2 AS DOUBLE) AS clip_end FROM c""")
def ace_window(spark, sf_dir):
    s, e = guards.ace_window(F.col("s"), F.col("e"), F.col("f"), F.col("a"))
    return _rounds(spark, sf_dir).select("o_orderkey", s.alias("clip_start"), e.alias("clip_end"))


@plan("b12_lead_window", views="gt", sql=_ROUNDS + """, p AS (SELECT o_orderkey, s, lag(e, 1, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pe FROM r)
SELECT o_orderkey, CAST(greatest(pe, s - greatest(35, least(75, greatest(0, s - pe)))) AS DOUBLE) AS clip_start, CAST(s + 4 AS DOUBLE) AS clip_end FROM p""")
def lead_window(spark, sf_dir):
    from pyspark.sql import Window as W

    s, e = guards.lead_window(F.col("s"), F.col("pe"))
    pe = F.lag("e", 1, 0.0).over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    return _rounds(spark, sf_dir).withColumn("pe", pe).select("o_orderkey", s.alias("clip_start"), e.alias("clip_end"))


@plan("b13_review_window", views="gt", sql="SELECT stem, idx, greatest(0, g1 - 3) AS start_sec, g2 + 3 AS end_sec FROM gt")
def review_window(spark, sf_dir):
    return A.truths(spark, sf_dir).select("stem", "idx", F.greatest(F.lit(0.0), F.col("g1") - 3).alias("start_sec"), (F.col("g2") + 3).alias("end_sec"))


# --- readings -------------------------------------------------------------


@plan("b15_double_guard", views="hud", sql="""SELECT stem, rn, CASE WHEN d IS NOT NULL OR a2 IS NOT NULL THEN k END AS k,
  CASE WHEN k IS NOT NULL AND d IS NULL AND a2 IS NULL THEN 'triple_incomplete' ELSE method END AS method
 FROM (SELECT stem, rn, k, method, CASE WHEN rn % 5 > 0 THEN d END AS d, CASE WHEN rn % 3 > 0 THEN a END AS a2 FROM hud)""")
def double_guard(spark, sf_dir):
    r = A.hud_reads(spark, sf_dir).withColumns({"d": F.when(F.col("rn") % 5 > 0, F.col("d")), "a": F.when(F.col("rn") % 3 > 0, F.col("a"))})
    k, d, a = F.col("k"), F.col("d"), F.col("a")
    return r.select("stem", "rn", guards.guarded_counter(k, d, a).alias("k"), guards.guarded_method(k, d, a, F.col("method")).alias("method"))


@plan("b16_domain_guards", views="sb", sql="""SELECT stem, rn, line, CASE WHEN kills BETWEEN 0 AND 40 THEN kills END AS kills,
  CASE WHEN deaths BETWEEN 0 AND 20 AND CAST(rn % 100 AS DOUBLE) / 100 >= 0.35 THEN deaths END AS wins, CASE WHEN deaths BETWEEN 0 AND 9 THEN deaths END AS digit FROM sb""")
def domain_guards(spark, sf_dir):
    conf = (F.col("rn") % 100).cast("double") / 100
    return A.sb_rows(spark, sf_dir).select("stem", "rn", "line", guards.within(F.col("kills"), 0, 40).alias("kills"), F.when(conf >= 0.35, guards.within(F.col("deaths"), 0, 20)).alias("wins"), guards.within(F.col("deaths"), 0, 9).alias("digit"))


@plan("b17_arbitration", views="sb", sql=""", x AS (SELECT stem, rn, line, CASE WHEN rn % 6 > 0 THEN kills END AS v, CAST(rn % 100 AS DOUBLE) / 100 AS c,
  CASE WHEN rn % 7 > 0 THEN deaths % 10 END AS v2, CAST(rn % 37 AS DOUBLE) / 37 AS c2 FROM sb),
 y AS (SELECT *, coalesce(v2 BETWEEN 0 AND 40 AND c2 >= 0.45, false) AS ls, coalesce(v BETWEEN 0 AND 40 AND c >= 0.45, false) AS ws FROM x),
 z AS (SELECT *, ls AND (v IS NULL OR v >= 15 OR coalesce(v >= 8 AND v < 10 AND v2 < v AND v - v2 >= 4 AND c2 >= 0.5, false)) AS l1 FROM y)
SELECT stem, rn, line, CASE WHEN l1 THEN v2 WHEN ws THEN v WHEN ls THEN v2 ELSE v END AS value, CASE WHEN l1 THEN c2 WHEN ws THEN c WHEN ls THEN c2 ELSE c END AS conf FROM z""")
def arbitration(spark, sf_dir):
    rn = F.col("rn")
    got = guards.arbitrated(F.when(rn % 6 > 0, F.col("kills")), (rn % 100).cast("double") / 100, F.when(rn % 7 > 0, F.col("deaths") % 10), (rn % 37).cast("double") / 37)
    return A.sb_rows(spark, sf_dir).select("stem", "rn", "line", got.alias("x")).select("stem", "rn", "line", "x.value", "x.conf")


@plan("b18_glitch_filter", views="sb", sql=""", x AS (SELECT stem, rn, list(deaths ORDER BY line) FILTER (deaths IS NOT NULL) AS v, CASE WHEN rn % 3 > 0 THEN rn % 25 END AS p FROM sb GROUP BY stem, rn),
 y AS (SELECT stem, rn, v, list_filter(v, lambda d: NOT (d >= 10 AND d % 10 = 0 AND (p IS NULL OR d - p = 10))) AS f FROM x WHERE v IS NOT NULL)
SELECT stem, rn, list_sum(CASE WHEN len(f) > 0 THEN f ELSE v END)::BIGINT AS total, len(CASE WHEN len(f) > 0 THEN f ELSE v END)::BIGINT AS n FROM y""")
def glitch_filter(spark, sf_dir):
    x = A.sb_rows(spark, sf_dir).where("deaths is not null").groupBy("stem", "rn").agg(F.collect_list("deaths").alias("v"))
    kept = guards.without_tens(F.col("v"), F.when(F.col("rn") % 3 > 0, F.col("rn") % 25))
    return x.select("stem", "rn", F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("total"), F.size(kept).cast("bigint").alias("n"))


@plan("b19_elimination_state", views="score", sql="""SELECT stem, rn, CASE WHEN red >= 1 AND blue >= 1 THEN 'active' WHEN red = 0 AND blue >= 1 THEN 'red_eliminated' WHEN blue = 0 AND red >= 1 THEN 'blue_eliminated' ELSE 'unknown' END AS state FROM score""")
def elimination_state(spark, sf_dir):
    return A.score_reads(spark, sf_dir).select("stem", "rn", guards.elimination_state(F.col("red"), F.col("blue")).alias("state"))


@plan("b20_layout", sql="SELECT doc_id, CASE WHEN n_chars > 0 AND n_chars < 1800 THEN 'sponsor' ELSE 'fullscreen' END AS layout FROM documents")
def layout(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", guards.layout(F.col("n_chars")).alias("layout"))


@plan("b21_read_quality", views="hud", sql="""SELECT stem, CAST(coalesce(h / nullif(CAST(h + m + r AS DOUBLE), 0), -1) AS DOUBLE) AS quality FROM (
  SELECT stem, count(*) FILTER (k IS NOT NULL AND stem <> 'v00003') AS h, count(*) FILTER (method = 'template_miss' AND stem <> 'v00003') AS m, count(*) FILTER (method = 'row_miss' AND stem <> 'v00003') AS r FROM hud GROUP BY stem)""")
def read_quality(spark, sf_dir):
    on = F.col("stem") != "v00003"
    c = A.hud_reads(spark, sf_dir).groupBy("stem").agg(F.count_if(F.col("k").isNotNull() & on).alias("h"), F.count_if((F.col("method") == "template_miss") & on).alias("m"), F.count_if((F.col("method") == "row_miss") & on).alias("r"))
    return c.select("stem", guards.read_quality(F.col("h"), F.col("m"), F.col("r")).alias("quality"))


@plan("b22_b36_spans", views="gt", sql=_ROUNDS + """, z AS (SELECT o_orderkey, s, e, CASE WHEN o_orderkey % 12 = 0 THEN 0.0::DOUBLE ELSE f END AS f, CASE WHEN o_orderkey % 15 = 0 THEN 0.0::DOUBLE ELSE a END AS a FROM r),
 d AS (SELECT *, coalesce(nullif(f, 0), s) AS d1 FROM z)
SELECT o_orderkey, coalesce(a, f, s) AS at_sec, d1, greatest(d1, coalesce(nullif(a, 0), e)) AS d2 FROM d""")
def spans(spark, sf_dir):
    i = F.col("o_orderkey")
    r = _rounds(spark, sf_dir).withColumns({"f": F.when(i % 12 == 0, 0.0).otherwise(F.col("f")), "a": F.when(i % 15 == 0, 0.0).otherwise(F.col("a"))})
    d1 = guards.detection_start(F.col("f"), F.col("s"))
    return r.select("o_orderkey", F.coalesce("a", "f", "s").alias("at_sec"), d1.alias("d1"), guards.detection_end(d1, F.col("a"), F.col("e")).alias("d2"))


@plan("b23_b34_ace_predicate", views="det", sql=""", x AS (SELECT stem, floor(d1 / 100)::BIGINT AS part, list_sort(list(d1)) AS ts, count(*) AS n, min(idx) % 3 AS resets, max(idx) % 20 AS samples FROM det GROUP BY stem, floor(d1 / 100)::BIGINT)
SELECT stem, part, len(ts) >= 2 AND list_max(ts) = list_min(ts) AS width_zero, n = 3 AND resets = 0 AND coalesce(ts[3] - ts[1], 0) <= 90 AND samples >= 10 AS ace FROM x""")
def ace_predicate(spark, sf_dir):
    x = A.detections(spark, sf_dir).groupBy("stem", F.floor(F.col("d1") / 100).alias("part")).agg(F.sort_array(F.collect_list("d1")).alias("ts"), F.count("*").alias("n"), (F.min("idx") % 3).alias("resets"), (F.max("idx") % 20).alias("samples"))
    return x.select("stem", "part", guards.is_width_zero(F.col("ts")).alias("width_zero"), guards.is_ace(F.col("n"), F.col("resets"), F.col("ts"), F.col("samples")).alias("ace"))


@plan("b24_run_selection", views="det", sql="SELECT DISTINCT stem FROM (SELECT stem, max(d2) - min(d1) AS length FROM det WHERE stem > 'v00002' GROUP BY stem HAVING max(d2) - min(d1) >= 900 ORDER BY stem LIMIT 12)")
def run_selection(spark, sf_dir):
    runs = A.detections(spark, sf_dir).where("stem > 'v00002'").groupBy("stem").agg((F.max("d2") - F.min("d1")).alias("length"))
    return runs.where("length >= 900").orderBy("stem").limit(12).select("stem")


_PATHS = ", p AS (SELECT o_orderkey, concat(CASE o_orderkey % 4 WHEN 0 THEN 'background/' WHEN 1 THEN 'background/_chunks/' ELSE 'ace/' END, CASE o_orderkey % 3 WHEN 0 THEN 'allkill_' ELSE 'Rec 12_R' END, CASE o_orderkey % 3 WHEN 0 THEN substr(sha1(CAST(o_orderkey AS VARCHAR)), 1, 12) ELSE concat(o_orderkey % 30, '_x:y') END, '.mp4') AS path, CAST(o_orderkey % 200 AS DOUBLE) AS d FROM orders)"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    head = F.when(i % 4 == 0, "background/").when(i % 4 == 1, "background/_chunks/").otherwise("ace/")
    name = F.when(i % 3 == 0, F.concat(F.lit("allkill_"), F.substring(F.sha1(i.cast("string").cast("binary")), 1, 12))).otherwise(F.concat(F.lit("Rec 12_R"), (i % 30).cast("string"), F.lit("_x:y")))
    return A.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(head, name, F.lit(".mp4")).alias("path"), (i % 200).cast("double").alias("d"))


@plan("b25_index_eligibility", views="gt", sql=_PATHS + " SELECT o_orderkey, split_part(path, '/', 1) <> 'background' OR contains(path, '_chunks') OR coalesce(nullif(d, 0) < 90, true) AS eligible FROM p")
def index_eligibility(spark, sf_dir):
    p = _paths(spark, sf_dir).withColumn("d", F.nullif("d", F.lit(0.0)))  # some lengths are not known
    return p.select("o_orderkey", labels.eligible(F.split("path", "/")[0], F.col("path"), F.col("d")).alias("eligible"))


@plan("b26_generated_clips", views="gt", sql=_PATHS + " SELECT o_orderkey, path FROM p WHERE NOT regexp_full_match(lower(regexp_extract(path, '([^/]*)$', 1)), '(doublekill|multikill|save|allkill|background)_[a-f0-9]{12}\\.mp4')")
def generated_clips(spark, sf_dir):
    return _paths(spark, sf_dir).where(~labels.is_generated_clip(F.col("path"))).select("o_orderkey", "path")


@plan("b27_review_status", sql="""SELECT status, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus <> 'F' THEN 'skipped' WHEN o_orderkey % 9 <= o_orderkey % 4 THEN 'failed' ELSE 'extracted' END AS status FROM orders) GROUP BY status""")
def review_status(spark, sf_dir):
    i = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") != "F", "skipped").when(i % 9 <= i % 4, "failed").otherwise("extracted")
    return A.table(spark, sf_dir, "orders").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@plan("b28_read_failures", views="votes", sql="""SELECT ord, CASE WHEN mode = 'unknown' THEN CASE WHEN n = 0 THEN 'unknown_no_ocr' WHEN NOT h THEN 'unknown_no_header' ELSE 'unknown_header_ocr_garbled' END
  WHEN mode = 'scouter' AND name = '' THEN 'scouter_dot_miss' WHEN name <> '' AND conf < 0.3 THEN 'low_conf' WHEN name = '' THEN 'empty_nick' ELSE 'ok' END AS cause
 FROM (SELECT ord, conf, CASE ord % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'scouter' ELSE 'direct' END AS mode, ord % 4 AS n, ord % 5 > 1 AS h, CASE WHEN ord % 7 > 1 THEN text ELSE '' END AS name FROM votes)""")
def read_failures(spark, sf_dir):
    o = F.col("ord")
    mode = F.when(o % 3 == 0, "unknown").when(o % 3 == 1, "scouter").otherwise("direct")
    return A.votes(spark, sf_dir).select("ord", guards.read_failure(mode, o % 4, o % 5 > 1, F.when(o % 7 > 1, F.col("text")).otherwise(""), F.col("conf")).alias("cause"))


@plan("b30_filename_parts", views="gt", sql=_PATHS + r" SELECT o_orderkey, regexp_extract(path, '^(.*)_R(\d+)_', 1) AS stem, TRY_CAST(nullif(regexp_extract(path, '^(.*)_R(\d+)_', 2), '') AS BIGINT) AS round FROM p")
def filename_parts(spark, sf_dir):
    pattern = r"^(.*)_R(\d+)_"
    return _paths(spark, sf_dir).select("o_orderkey", F.regexp_extract("path", pattern, 1).alias("stem"), F.nullif(F.regexp_extract("path", pattern, 2), F.lit("")).try_cast("bigint").alias("round"))


@plan("b31_safe_stem", views="gt", sql=_PATHS + r""", c AS (SELECT o_orderkey, regexp_replace(regexp_replace(trim(path), '\s+', '_', 'g'), '[<>:"/\\|?*]', '_', 'g') AS s FROM p)
SELECT o_orderkey, CASE WHEN s = '' THEN 'video' ELSE s END AS stem FROM c""")
def safe_stem(spark, sf_dir):
    return _paths(spark, sf_dir).select("o_orderkey", labels.safe_stem(F.col("path")).alias("stem"))


_BOXES = """, b AS (SELECT l_orderkey AS k, l_linenumber AS n, (l_partkey % 100)::INTEGER AS ax1, (l_suppkey % 50)::INTEGER AS ay1, (l_partkey % 100 + l_linenumber * 9)::INTEGER AS ax2, (l_suppkey % 50 + 20)::INTEGER AS ay2,
  (l_suppkey % 100)::INTEGER AS bx1, (l_partkey % 50)::INTEGER AS by1, (l_suppkey % 100 + 30)::INTEGER AS bx2, (l_partkey % 50 + 25)::INTEGER AS by2 FROM lineitem)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    box = lambda *v: F.struct(*(x.cast("int").alias(k) for x, k in zip(v, ("x1", "y1", "x2", "y2"), strict=True)))
    return A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), n.alias("n"), box(p % 100, s % 50, p % 100 + n * 9, s % 50 + 20).alias("a"), box(s % 100, p % 50, s % 100 + 30, p % 50 + 25).alias("b"))


_IOU = "(greatest(0, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0, least(ay2, by2) - greatest(ay1, by1)))"
_IOU_SQL = f"CAST({_IOU} AS DOUBLE) / greatest(1, CAST((ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - {_IOU} AS DOUBLE))"


@plan("b32_box_iou", views="gt", sql=_BOXES + f""", c AS (SELECT *, least(greatest(ax1, 0), 79) AS cx1, least(greatest(ay1, 0), 39) AS cy1 FROM b)
SELECT k, n, {_IOU_SQL} AS iou, cx1 / CAST(80 AS DOUBLE) AS nx1, least(greatest(ax2, cx1 + 1), 80) / CAST(80 AS DOUBLE) AS nx2, least(greatest(ay2, cy1 + 1), 40) / CAST(40 AS DOUBLE) AS ny2 FROM c""")
def box_iou(spark, sf_dir):
    c = guards.clamped_box(F.col("a"), F.lit(80), F.lit(40))
    rows = _boxes(spark, sf_dir).withColumn("c", c)
    return rows.select("k", "n", guards.box_iou(F.col("a"), F.col("b")).alias("iou"), (F.col("c.x1") / 80).alias("nx1"), (F.col("c.x2") / 80).alias("nx2"), (F.col("c.y2") / 40).alias("ny2"))


@plan("d10_mean_box_iou", views="gt", sql=_BOXES + f" SELECT n, round(avg({_IOU_SQL}), 9) AS mean_iou FROM b GROUP BY n")
def mean_box_iou(spark, sf_dir):
    return _boxes(spark, sf_dir).groupBy("n").agg(F.round(F.avg(guards.box_iou(F.col("a"), F.col("b"))), 9).alias("mean_iou"))


@plan("b33_player_wins", views="sb", sql="SELECT stem, rn, line, CASE WHEN row_index < 3 THEN kills WHEN row_index >= 3 THEN deaths END AS wins, kills + deaths AS total FROM sb")
def player_wins(spark, sf_dir):
    return A.sb_rows(spark, sf_dir).select("stem", "rn", "line", guards.player_wins(F.col("row_index"), F.col("kills"), F.col("deaths")).alias("wins"), (F.col("kills") + F.col("deaths")).alias("total"))


@plan("b35_window_acceptance", views="preds", sql="SELECT doc_id FROM preds WHERE score >= 0.55 AND pred = 1 AND (label = 0 OR (doc_id % 100) / CAST(100 AS DOUBLE) >= 0.35)")
def window_acceptance(spark, sf_dir):
    kind = F.when(F.col("label") != 0, (F.col("doc_id") % 100) / 100)
    return A.predictions(spark, sf_dir).where(guards.accepted_window(F.col("score"), F.col("pred") == 1, kind)).select("doc_id")


@plan("b38_manifest_selection", sql="""SELECT page_id FROM (SELECT page_id, CAST(concat('0x', substr(sha1(concat('42|', url)), 1, 8)) AS UBIGINT) % 100 AS h FROM pages) WHERE h < 80 AND page_id % 3 IN (0, 1)""")
def manifest_selection(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").where((labels.stable_split(F.col("url")) == "train") & (F.col("page_id") % 3).isin(0, 1)).select("page_id")


@plan("b39_identity_priority", views="votes", sql="""SELECT v.stem, coalesce(m.name, s.name, v.name) AS name FROM (SELECT stem, min_by(text, ord) AS name FROM votes GROUP BY stem) v
 LEFT JOIN (SELECT stem, concat('manual_', min(ord)) AS name FROM votes WHERE weight = 0.5 AND stem > 'src5' GROUP BY stem) m ON m.stem = v.stem
 LEFT JOIN (SELECT stem, max(text) AS name FROM votes WHERE stem < 'src2' GROUP BY stem) s ON s.stem = v.stem""")
def identity_priority(spark, sf_dir):
    v = A.votes(spark, sf_dir)
    computed = v.groupBy("stem").agg(F.min_by("text", "ord").alias("computed"))
    manual = v.where("weight = 0.5 and stem > 'src5'").groupBy("stem").agg(F.concat(F.lit("manual_"), F.min("ord").cast("string")).alias("manual"))
    stored = v.where("stem < 'src2'").groupBy("stem").agg(F.max("text").alias("stored"))
    return computed.join(manual, "stem", "left").join(stored, "stem", "left").select("stem", F.coalesce("manual", "stored", "computed").alias("name"))


@plan("b40_warnings", views="hud", sql="""SELECT stem, array_to_string(list_filter([CASE WHEN max(k) < 20 THEN 'low_counter' END, CASE WHEN count(*) FILTER (method = 'row_miss') > 70 THEN 'many_misses' END, CASE WHEN count(k) = 0 THEN 'never_read' END], lambda x: x IS NOT NULL), ',') AS warnings FROM hud GROUP BY stem""")
def warning_flags(spark, sf_dir):
    c = A.hud_reads(spark, sf_dir).groupBy("stem").agg(F.max("k").alias("top"), F.count_if(F.col("method") == "row_miss").alias("miss"), F.count("k").alias("n"))
    return c.select("stem", F.array_join(guards.warnings(low_counter=F.col("top") < 20, many_misses=F.col("miss") > 70, never_read=F.col("n") == 0), ",").alias("warnings"))


@plan("b41_digits", views="sb", sql=""", x AS (SELECT stem, rn, list(CASE WHEN line % 5 > 0 OR rn % 2 = 0 THEN kills % 10 END ORDER BY line, CASE WHEN line % 5 > 0 OR rn % 2 = 0 THEN kills % 10 END NULLS FIRST) AS d, min(CAST(kills AS DOUBLE) / 50) AS conf FROM sb WHERE line <= 5 GROUP BY stem, rn)
SELECT stem, rn, CASE WHEN len(list_filter(d, lambda y: y IS NULL)) = 0 THEN CAST(array_to_string(d, '') AS BIGINT) END AS value, conf FROM x""")
def digits(spark, sf_dir):
    digit = F.when((F.col("line") % 5 > 0) | (F.col("rn") % 2 == 0), F.col("kills") % 10)
    x = A.sb_rows(spark, sf_dir).where("line <= 5").groupBy("stem", "rn").agg(F.sort_array(F.collect_list(F.struct("line", digit.alias("d")))).alias("x"), F.min(F.col("kills").cast("double") / 50).alias("conf"))
    return x.select("stem", "rn", guards.digits_value(F.transform("x", lambda s: s["d"])).alias("value"), "conf")


@plan("d29_threshold_vote", sql="SELECT vec_id, len(list_filter(embedding[1:7], lambda x: x > 0)) >= 3 AS agreed FROM embeddings")
def threshold_vote(spark, sf_dir):
    signs = F.transform(F.slice("embedding", 1, 7), lambda x: F.when(x > 0, 2).otherwise(0))
    return A.table(spark, sf_dir, "embeddings").select("vec_id", guards.voted(signs, 2).alias("agreed"))


# --- names ----------------------------------------------------------------

_STRIP = lambda x: f"regexp_replace(lower({x}), '[^0-9a-z가-힣]', '', 'g')"
_NORM = lambda x: f"replace(lower(trim({x})), ' ', '')"
_NULLS = "(" + ", ".join(map(_lit, names.NULL_NAMES)) + ")"


def _sql_contains(a: str, b: str) -> str:
    return f"(least(length({a}), length({b})) >= 4 AND CASE WHEN length({a}) <= length({b}) THEN contains({b}, {a}) ELSE contains({a}, {b}) END)"


def sql_match(a: str, b: str) -> str:
    sa, sb = _STRIP(a), _STRIP(b)
    short = f"least(length({a}), length({b}))"
    return f"""({a} <> '' AND {b} <> '' AND (({a} IN {_NULLS} AND {b} IN {_NULLS}) OR ({sa} <> '' AND {sb} <> '' AND ({sa} = {sb} OR {_sql_contains(sa, sb)}))
      OR levenshtein({a}, {b}) <= CASE WHEN {short} <= 3 THEN 1 WHEN {short} >= 6 THEN 3 ELSE 2 END))"""


def sql_cores(a: str, b: str) -> str:
    ca, cb = _STRIP(a), _STRIP(b)
    return f"""({a} <> '' AND {b} <> '' AND ({sql_match(_NORM(a), _NORM(b))} OR ({ca} <> '' AND {cb} <> '' AND ({ca} = {cb} OR {_sql_contains(ca, cb)} OR (least(length({ca}), length({cb})) >= 2 AND {sql_match(ca, cb)})))))"""


def sql_score(a: str, b: str) -> str:
    na, nb, ca, cb = _NORM(a), _NORM(b), _STRIP(a), _STRIP(b)
    return f"""CAST(CASE WHEN {a} = '' OR {b} = '' THEN 0 WHEN {sql_match(na, nb)} THEN CASE WHEN {na} = {nb} THEN 1 ELSE greatest(0, 1 - levenshtein({na}, {nb}) / CAST(greatest(length({na}), length({nb})) AS DOUBLE)) END
      WHEN {sql_cores(a, b)} THEN CASE WHEN {ca} <> '' AND {cb} <> '' THEN CAST(0.82 AS DOUBLE) + CAST(0.18 AS DOUBLE) * (least(length({ca}), length({cb})) / CAST(greatest(length({ca}), length({cb})) AS DOUBLE)) ELSE 0 END ELSE 0 END AS DOUBLE)"""


@plan("s1_s3_normal_names", views="votes", sql=f"SELECT ord, {_NORM('text')} AS normal, {_STRIP('text')} AS stripped, {_STRIP('text')} AS core FROM votes")
def normal_names(spark, sf_dir):
    t = F.col("text")
    return A.votes(spark, sf_dir).select("ord", names.normal(t).alias("normal"), names.stripped(t).alias("stripped"), names.core(t).alias("core"))


_DISTINCT = ", s AS (SELECT DISTINCT stem, " + _STRIP("text") + " AS text FROM source_votes)"


@plan("s4_levenshtein", views="source_votes", sql=_DISTINCT + " SELECT a.stem, a.text AS x, b.text AS y, levenshtein(a.text, b.text) AS distance FROM s a JOIN s b ON a.stem = b.stem AND b.text > a.text")
def levenshtein(spark, sf_dir):
    """Edits between all distinct names of a source."""
    return name_index.all_pairs(stripped_votes(spark, sf_dir)).select("stem", "x", "y", F.levenshtein("x", "y").cast("bigint").alias("distance"))


def stripped_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # of kept characters, as DuckDB's distance counts bytes
    return A.source_votes(spark, sf_dir).select("stem", names.stripped(F.col("text")).alias("text"))


_NEAR_NULL = """CASE ord % 6 WHEN 0 THEN 'nu11' WHEN 1 THEN ' Null ' WHEN 2 THEN 'nulk' WHEN 3 THEN 'nothing' WHEN 4 THEN text ELSE 'mull' END"""


@plan("s5_s9_null_names", views="votes", sql=f""", x AS (SELECT ord, {_NEAR_NULL} AS name FROM votes), y AS (SELECT *, regexp_replace({_NORM('name')}, '[^0-9a-z]', '', 'g') AS n FROM x),
 z AS (SELECT *, n <> '' AND (n IN {_NULLS} OR (length(n) <= 5 AND levenshtein(n, 'null') <= 1)) AS is_null_text FROM y)
SELECT ord, {_NORM('name')} IN {_NULLS} AS is_null_name, is_null_text, CASE WHEN is_null_text THEN 'null' ELSE trim(name) END AS canonical FROM z""")
def null_names(spark, sf_dir):
    v = A.votes(spark, sf_dir).withColumn("name", F.expr(_NEAR_NULL))
    n = F.col("name")
    return v.select("ord", names.is_null_name(names.normal(n)).alias("is_null_name"), names.is_null_text(n).alias("is_null_text"), names.canonical(n).alias("canonical"))


@plan("s6_s8_name_match", views="source_votes", sql=_DISTINCT + f""" SELECT a.stem, a.text AS x, b.text AS y, {sql_match(_NORM('a.text'), _NORM('b.text'))} AS matched, {sql_cores('a.text', 'b.text')} AS cores, round({sql_score('a.text', 'b.text')}, 9) AS score
 FROM s a JOIN s b ON a.stem = b.stem AND b.text > a.text""")
def name_match(spark, sf_dir):
    """All pairs of distinct names of a source: whether they match whole or by their cores, and how well."""
    matched, cores, score = names.pair_match(*(F.col(c) for c in ("x", "y", "nx", "ny", "cx", "cy")))
    return name_index.all_pairs(stripped_votes(spark, sf_dir)).select("stem", "x", "y", matched.alias("matched"), cores.alias("cores"), F.round(score, 9).alias("score"))


_HEADERS = ["스카우터 (L)", "스카무터2 (L)", "Scouter Z", "(L)", "player one", "  ", "[]", "K 12/3", "win", "x", "77 12", "스무무터"]


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "documents").select("doc_id", F.get(F.array(*map(F.lit, _HEADERS)), (F.col("doc_id") % len(_HEADERS)).cast("int")).alias("s"))


# DuckDB's distance counts bytes, so these Hangul texts are held against tests instead
@plan("s10_headers")
def headers(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", names.is_header(F.col("s")).alias("header"), names.is_second_header(F.col("s")).alias("second"))


@plan("s11_noise_texts")
def noise_texts(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", names.is_header_fragment(F.col("s")).alias("fragment"), names.is_noise(F.col("s")).alias("noise"))


@plan("s12_first_integer", sql=r"SELECT event_id, CAST(nullif(regexp_extract(props, '\d+'), '') AS BIGINT) AS value FROM events")
def first_integer(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select("event_id", names.first_integer(F.col("props")).alias("value"))
