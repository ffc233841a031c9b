"""Views that give the library's shapes to general fixture tables.

``reads`` and the others are the shapes that operators take; a user with tables
of these shapes needs none of the adapters.  All are projections over one scan of
the whole table; ``events`` is numbered within each recording by one window.  A
recording takes a fixed number of users, customers, suppliers or documents, so the number of
recordings grows with the tables; ``source_votes`` takes whole sources, for queries on all
names of one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import guards


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: users, suppliers, customers and documents of one recording
USERS, SUPPLIERS, CUSTOMERS, DOCUMENTS = 8, 5, 40, 200


def stem(column: str, size: int) -> Column:
    return F.concat(F.lit("v"), F.lpad(F.expr(f"{column} div {size}").cast("string"), 5, "0"))


def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``stem``, ``rn`` in time order and ``t`` in seconds."""
    e = table(spark, sf_dir, "events")
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    e = e.withColumn("stem", stem("user_id", USERS))
    rn = F.row_number().over(W.partitionBy("stem").orderBy("ts", "event_id")).cast("bigint")
    return e.select("*", rn.alias("rn"), ((F.unix_micros(F.col("ts").cast("timestamp")) - start) / F.lit(1440e6)).alias("t"))


def hud_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stem, rn, t, k, conf, method, d, a): counter readings."""
    kind, i, rn = F.col("event_type"), F.col("event_id"), F.col("rn")
    method = F.when(kind == "view", "template").when(kind == "signup", "template_miss").when(kind == "error", "row_miss").when(kind == "purchase", "triple_incomplete").otherwise("click")
    k = F.when(kind == "view", F.when(i % 17 == 0, F.lit(0).cast("bigint")).when(i % 23 == 0, F.expr("rn div 20") + 7).otherwise(F.expr("rn div 20")))
    d = F.when(kind.isin("click", "view", "purchase"), F.expr("rn div 60"))
    return numbered_events(spark, sf_dir).select("stem", "rn", "t", k.alias("k"), (0.5 + (i % 50) / 100).alias("conf"), method.alias("method"), d.alias("d"), F.when(kind == "view", i % 3).alias("a"))


def score_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stem, rn, t, red, blue): team scores."""
    kind = F.col("event_type")
    red = F.when(kind == "error", None).when(F.col("event_id") % 29 == 0, F.lit(9).cast("bigint")).otherwise(F.expr("(rn div 12) % 6"))
    return numbered_events(spark, sf_dir).select("stem", "rn", "t", red.alias("red"), F.when(kind != "signup", F.expr("(rn div 18) % 6")).alias("blue"))


def frame_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stem, rn, t, prob): probability that a frame shows the scoreboard."""
    return numbered_events(spark, sf_dir).select("stem", "rn", "t", F.least(F.lit(1.0), F.col("value") / 100).alias("prob"))


def _day(column: str) -> Column:
    return F.datediff(F.col(column).cast("date"), F.lit("1995-01-01").cast("date")).cast("double")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stem, idx, d1, d2): detected spans, up to 20 days off the order's date."""
    start = _day("o_orderdate") + F.expr("(o_orderkey * 7) % 41 - 20")
    return table(spark, sf_dir, "orders").select(stem("o_custkey", CUSTOMERS).alias("stem"), F.col("o_orderkey").alias("idx"), start.alias("d1"), (start + F.col("o_orderkey") % 9).alias("d2"))


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stem, idx, g1, g2): true spans from the order's date."""
    return table(spark, sf_dir, "orders").select(stem("o_custkey", CUSTOMERS).alias("stem"), F.col("o_orderkey").alias("idx"), _day("o_orderdate").alias("g1"), (_day("o_orderdate") + 5).alias("g2"))


def _names(spark: SparkSession, sf_dir: str, recording: Column) -> DataFrame:
    word = F.split(F.regexp_replace("text", "\n", " "), " ")[0]
    weight = F.when(F.col("lang") == "en", 2.5).when(F.col("lang") == "fr", 0.5).otherwise(1.0)
    return table(spark, sf_dir, "documents").select(recording.alias("stem"), F.col("doc_id").alias("ord"), word.alias("text"), weight.alias("weight"), ((F.col("n_chars") % 100) / 100).alias("conf"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stem, ord, text, weight, conf): readings of a name."""
    return _names(spark, sf_dir, stem("doc_id", DOCUMENTS))


def source_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``votes`` whose recordings are the whole sources, so that all of a source's names meet."""
    return _names(spark, sf_dir, F.col("source"))


def sb_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stem, rn, line, row_index, team, kills, deaths): scoreboard rows."""
    i = ((F.col("l_linenumber") - 1) % 6).cast("bigint")
    return table(spark, sf_dir, "lineitem").select(stem("l_suppkey", SUPPLIERS).alias("stem"), F.col("l_orderkey").alias("rn"), F.col("l_linenumber").cast("bigint").alias("line"), i.alias("row_index"), F.when(i < 3, "red").otherwise("blue").alias("team"), F.col("l_quantity").cast("bigint").alias("kills"), F.when(F.col("l_linenumber") != 3, F.col("l_partkey") % 30).alias("deaths"))


#: seconds of a day of the fixture's order dates
DAY = 20.0


def timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stem, seg, key, s, e, kills, kill_times, reset, k_samples, first_kill, ace_sec, ace): stored
    rounds.  An order is a round, its lines are kills and their quantities readings."""
    o = table(spark, sf_dir, "orders").select(stem("o_custkey", CUSTOMERS).alias("stem"), F.col("o_orderkey").alias("key"), (_day("o_orderdate") * DAY).alias("s"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.when(F.col("l_partkey") % 4 == 0, F.lit(0.0)).otherwise((F.col("l_partkey") % 120) / 2).alias("after"), "l_quantity")
    lines = lines.groupBy("key").agg(F.sort_array(F.collect_list("after")).alias("after"), F.sum("l_quantity").cast("bigint").alias("k_samples"))
    seg = F.row_number().over(W.partitionBy("stem").orderBy("s", "key")).cast("bigint") - 1
    r = o.join(lines, "key", "left").withColumns({"seg": seg, "e": F.col("s") + 61 + F.col("key") % 60, "reset": F.col("key") % 11 == 0, "k_samples": F.coalesce("k_samples", F.lit(0).cast("bigint"))})
    r = r.withColumn("kill_times", F.coalesce(F.transform("after", lambda t: F.col("s") + t), F.array().cast("array<double>")))
    kills = F.size("kill_times").cast("bigint")
    r = r.withColumns({"kills": kills, "first_kill": F.get("kill_times", F.lit(0)), "ace_sec": F.get("kill_times", F.lit(2)), "ace": guards.is_ace(kills, F.col("reset").cast("int"), F.col("kill_times"), F.col("k_samples"))})
    return r.select("stem", "seg", "key", "s", "e", "kills", "kill_times", "reset", "k_samples", "first_kill", "ace_sec", "ace")


def true_aces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stem, idx, g1, g2): the true aces of the recordings of ``timelines``."""
    o = table(spark, sf_dir, "orders").where("o_totalprice > 200000")
    return o.select(stem("o_custkey", CUSTOMERS).alias("stem"), F.col("o_orderkey").alias("idx"), (_day("o_orderdate") * DAY + 20).alias("g1"), (_day("o_orderdate") * DAY + 40).alias("g2"))


def score_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stem, t): score events of the recordings of ``timelines``."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(stem("o_custkey", CUSTOMERS).alias("stem"), (_day("o_orderdate") * DAY + 30).alias("t"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label, pred, score, grp): labelled predictions."""
    d, n = table(spark, sf_dir, "documents"), F.col("n_chars")
    rows = table(spark, sf_dir, "labels").join(d.select("doc_id", "n_chars"), "doc_id")
    return rows.select("doc_id", F.col("quality").cast("bigint").alias("label"), F.when(n % 5 < 3, 1).otherwise(0).cast("bigint").alias("pred"), ((n % 1000) / 1000).alias("score"), stem("doc_id", DOCUMENTS).alias("grp"))


#: the same views as DuckDB common table expressions
SQL = {
    "ev": """SELECT *, concat('v', lpad(CAST(user_id // 8 AS VARCHAR), 5, '0')) AS stem,
      row_number() OVER (PARTITION BY user_id // 8 ORDER BY ts, event_id) AS rn,
      (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / CAST(1440e6 AS DOUBLE) AS t FROM events""",
    "hud": """SELECT stem, rn, t,
      CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 17 = 0 THEN 0 WHEN event_id % 23 = 0 THEN rn // 20 + 7 ELSE rn // 20 END END AS k,
      CAST(0.5 AS DOUBLE) + CAST(event_id % 50 AS DOUBLE) / 100 AS conf,
      CASE event_type WHEN 'view' THEN 'template' WHEN 'signup' THEN 'template_miss' WHEN 'error' THEN 'row_miss' WHEN 'purchase' THEN 'triple_incomplete' ELSE 'click' END AS method,
      CASE WHEN event_type IN ('click', 'view', 'purchase') THEN rn // 60 END AS d,
      CASE WHEN event_type = 'view' THEN event_id % 3 END AS a FROM ev""",
    "score": """SELECT stem, rn, t,
      CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 29 = 0 THEN 9 ELSE (rn // 12) % 6 END AS red,
      CASE WHEN event_type <> 'signup' THEN (rn // 18) % 6 END AS blue FROM ev""",
    "probs": "SELECT stem, rn, t, least(CAST(1 AS DOUBLE), value / 100) AS prob FROM ev",
    "det": """SELECT concat('v', lpad(CAST(o_custkey // 40 AS VARCHAR), 5, '0')) AS stem, o_orderkey AS idx,
      CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + (o_orderkey * 7) % 41 - 20 AS DOUBLE) AS d1,
      CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + (o_orderkey * 7) % 41 - 20 + o_orderkey % 9 AS DOUBLE) AS d2 FROM orders""",
    "gt": """SELECT concat('v', lpad(CAST(o_custkey // 40 AS VARCHAR), 5, '0')) AS stem, o_orderkey AS idx,
      CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS g1,
      CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) + 5 AS g2 FROM orders""",
    "votes": """SELECT concat('v', lpad(CAST(doc_id // 200 AS VARCHAR), 5, '0')) AS stem, doc_id AS ord, split_part(replace(text, chr(10), ' '), ' ', 1) AS text,
      CASE lang WHEN 'en' THEN CAST(2.5 AS DOUBLE) WHEN 'fr' THEN CAST(0.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS weight,
      CAST(n_chars % 100 AS DOUBLE) / 100 AS conf FROM documents""",
    "sb": """SELECT concat('v', lpad(CAST(l_suppkey // 5 AS VARCHAR), 5, '0')) AS stem, l_orderkey AS rn, CAST(l_linenumber AS BIGINT) AS line,
      CAST((l_linenumber - 1) % 6 AS BIGINT) AS row_index, CASE WHEN (l_linenumber - 1) % 6 < 3 THEN 'red' ELSE 'blue' END AS team,
      CAST(l_quantity AS BIGINT) AS kills, CASE WHEN l_linenumber <> 3 THEN l_partkey % 30 END AS deaths FROM lineitem""",
    "preds": """SELECT l.doc_id, CAST(l.quality AS BIGINT) AS label, CAST(CASE WHEN n_chars % 5 < 3 THEN 1 ELSE 0 END AS BIGINT) AS pred,
      CAST(n_chars % 1000 AS DOUBLE) / 1000 AS score, concat('v', lpad(CAST(l.doc_id // 200 AS VARCHAR), 5, '0')) AS grp FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
}
SQL["source_votes"] = SQL["votes"].replace("concat('v', lpad(CAST(doc_id // 200 AS VARCHAR), 5, '0')) AS stem", "source AS stem")
_DAYS = "CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) * 20"
_STEM = "concat('v', lpad(CAST(o_custkey // 40 AS VARCHAR), 5, '0'))"
SQL |= {
    "tl": f"""SELECT stem, row_number() OVER (PARTITION BY stem ORDER BY s, key) - 1 AS seg, key, s, e, len(kill_times) AS kills, kill_times, reset, k_samples, kill_times[1] AS first_kill, kill_times[3] AS ace_sec, len(kill_times) = 3 AND NOT reset AND k_samples >= 10 AS ace FROM (
      SELECT {_STEM} AS stem, o_orderkey AS key, {_DAYS} AS s, {_DAYS} + 61 + o_orderkey % 60 AS e, o_orderkey % 11 = 0 AS reset, coalesce(k_samples, 0) AS k_samples, coalesce(list_transform(after, lambda t: {_DAYS} + t), []) AS kill_times
      FROM orders LEFT JOIN (SELECT l_orderkey, list_sort(list(CASE WHEN l_partkey % 4 = 0 THEN 0 ELSE CAST(l_partkey % 120 AS DOUBLE) / 2 END)) AS after, CAST(sum(l_quantity) AS BIGINT) AS k_samples FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)""",
    "aces": f"SELECT {_STEM} AS stem, o_orderkey AS idx, {_DAYS} + 20 AS g1, {_DAYS} + 40 AS g2 FROM orders WHERE o_totalprice > 200000",
    "points": f"SELECT {_STEM} AS stem, {_DAYS} + 30 AS t FROM orders WHERE o_orderstatus = 'F'",
}
_NEEDS = {"hud": ["ev"], "score": ["ev"], "probs": ["ev"]}


def with_views(names: str, body: str) -> str:
    """SQL of ``body`` after the named views; a body that begins with a comma adds more views."""
    used: list[str] = []
    for n in names.split():
        used += [x for x in [*_NEEDS.get(n, []), n] if x not in used]
    body = body.strip()
    views = ",\n".join(f"{n} AS ({SQL[n]})" for n in used)
    if not views:
        return body
    recursive = "RECURSIVE " if " UNION ALL" in body and re.search(r"\w+\([\w, ]+\) AS \(", body) else ""
    return f"WITH {recursive}{views}{'' if body.startswith(',') else chr(10)}{body}"
