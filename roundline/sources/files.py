"""Readers and writers of the library's file formats.

All go through Spark's own sources, so paths may be in any store.  Writers take
``overwrite=False`` and refuse an existing target unless told otherwise.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times

#: fixed values: one-letter codes of reading states
CODES = {"T": "template", "M": "template_miss", "R": "row_miss", "I": "triple_incomplete", "C": "click"}
_CACHE = "version int, stem string, scan_fps double, duration double, reads array<array<string>>"
_TIMELINE = "stem string, rounds array<struct<seg:bigint,s:double,e:double,kills:bigint,kill_times:array<double>,ace:boolean>>"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset a local session
    takes one of its machine, and a cluster is refused (ValueError)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.conf.get("spark.master", "local").partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: its lineage ends here and no row is computed twice."""
    path = f"{scratch(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for p in pairs.items() for x in p))


# --- readings: one JSON document a recording -------------------------------


def write_signal_cache(reads: DataFrame, path: str, scan_fps: float = 4.0, overwrite: bool = False) -> None:
    """(stem, t, k, conf, method, d, a) as documents with positional rows of six,
    times and confidences to three places."""
    code = F.try_element_at(_lookup({v: k for k, v in CODES.items()}), F.col("method"))
    text = lambda c: F.col(c).cast("string")
    row = F.array(F.format_string("%.3f", "t"), text("k"), F.format_string("%.3f", "conf"), code, text("d"), text("a"))
    docs = reads.groupBy("stem").agg(F.max("t").alias("duration"), F.sort_array(F.collect_list(F.struct("t", "rn", row.alias("row")))).alias("xs"))
    out = docs.select(F.lit(2).alias("version"), "stem", F.lit(scan_fps).alias("scan_fps"), "duration", F.transform("xs", lambda x: x["row"]).alias("reads"))
    out.write.mode(_mode(overwrite)).option("ignoreNullFields", "false").json(path)


def read_signal_cache(spark: SparkSession, path: str) -> DataFrame:
    """Readings of documents of version 1 (rows of four) and 2 (rows of six);
    absent d and a are null, an unknown code is null."""
    docs = spark.read.schema(_CACHE).json(path)
    r = docs.select("stem", F.posexplode("reads").alias("i", "r"))
    at = lambda i: F.get("r", F.lit(i))
    return r.select("stem", F.col("i").cast("bigint").alias("i"), at(0).try_cast("double").alias("t"), at(1).try_cast("bigint").alias("k"), at(2).try_cast("double").alias("conf"), F.try_element_at(_lookup(CODES), at(3)).alias("method"), at(4).try_cast("bigint").alias("d"), at(5).try_cast("bigint").alias("a"))


# --- judged rounds, truths, baselines -----------------------------------------


def write_timelines(rounds: DataFrame, path: str, overwrite: bool = False) -> None:
    """Judged rounds as one document a recording."""
    row = F.struct("seg", "s", "e", "kills", "kill_times", "ace")
    rounds.groupBy("stem").agg(F.sort_array(F.collect_list(F.struct("seg", row.alias("r")))).alias("xs")).select("stem", F.transform("xs", lambda x: x["r"]).alias("rounds")).write.mode(_mode(overwrite)).json(path)


def read_timelines(spark: SparkSession, path: str) -> DataFrame:
    """Rounds of sound documents; see ``sound_timelines``."""
    return sound_timelines(spark, path).where("sound").select("stem", F.explode("rounds").alias("r")).select("stem", "r.*")


def sound_timelines(spark: SparkSession, path: str) -> DataFrame:
    """Documents with ``sound``: parsed, and every round has its required fields."""
    docs = spark.read.schema(f"{_TIMELINE}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    ok = F.col("_corrupt_record").isNull() & F.col("rounds").isNotNull() & F.forall("rounds", lambda r: r["seg"].isNotNull() & r["kills"].isNotNull() & r["ace"].isNotNull())
    return docs.select("stem", "rounds", F.coalesce(ok, F.lit(False)).alias("sound"))


def write_truths(truths: DataFrame, path: str, overwrite: bool = False) -> None:
    """Spans as lines of {stem: {spans, source_available}}."""
    spans = F.sort_array(F.collect_list(F.array("g1", "g2")))
    body = truths.groupBy("stem").agg(spans.alias("spans"), F.lit(True).alias("source_available"))
    body.select(F.to_json(F.create_map("stem", F.struct("spans", "source_available"))).alias("value")).write.mode(_mode(overwrite)).text(path)


def read_truths(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """(stem, g1, g2, source_available); ``whole``: each file is one map over many lines."""
    kind = "map<string,struct<spans:array<array<double>>,source_available:boolean>>"
    m = spark.read.text(path, wholetext=whole).select(F.explode(F.from_json("value", kind)).alias("stem", "x"))
    return m.select("stem", F.explode("x.spans").alias("span"), "x.source_available").select("stem", F.col("span")[0].alias("g1"), F.col("span")[1].alias("g2"), "source_available")


def write_baseline(hits: DataFrame, path: str, overwrite: bool = False) -> None:
    """(gt_key, hit) as lines of {gt_key: hit}."""
    hits.select(F.to_json(F.create_map("gt_key", "hit"), {"ignoreNullFields": "false"}).alias("value")).write.mode(_mode(overwrite)).text(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.explode(F.from_json("value", "map<string,string>")).alias("gt_key", "hit"))


def read_identities(spark: SparkSession, path: str) -> DataFrame:
    """Identities with defaults for what a document leaves out."""
    d = spark.read.schema("stem string, nickname string, confidence double, mode string, samples bigint").json(path)
    return d.select("stem", F.coalesce("nickname", F.lit("")).alias("nickname"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("mode", F.lit("unknown")).alias("mode"), F.coalesce("samples", F.lit(0).cast("bigint")).alias("samples"))


# --- tables of text ------------------------------------------------------------


def write_table(df: DataFrame, path: str, places: dict[str, int] | None = None, overwrite: bool = False) -> None:
    """CSV with a header; ``places`` fixes decimals, null is an empty cell."""
    fixed = {c: F.format_string(f"%.{n}f", c) for c, n in (places or {}).items()}
    df.withColumns(fixed).write.mode(_mode(overwrite)).option("header", True).option("emptyValue", "").csv(path)


def read_spans(spark: SparkSession, path: str, start: str = "start_sec", end: str = "end_sec") -> DataFrame:
    """CSV with a header; rows without two sound numbers, or that end before they
    begin, are skipped.  A byte order mark is no hindrance."""
    rows = spark.read.option("header", True).csv(path)
    return rows.withColumns({start: F.col(start).try_cast("double"), end: F.col(end).try_cast("double")}).where(F.col(end) > F.col(start))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a list file without comments and blanks."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#')")


def parsed_timeline(lines: DataFrame) -> DataFrame:
    """Lines (value) as ranges ``M:SS - M:SS label`` or instants ``M:SS label``:
    (kind, start_sec, end_sec, label, warning).  Comments and blanks go; other
    lines are kept with a warning."""
    v = lines.select(F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#')")
    clock = r"(\d+(?::\d+){0,2})"
    part = lambda p, i: F.regexp_extract("value", p, i)
    span, instant = rf"^{clock}\s*[-~]\s*{clock}\s+(\S.*)$", rf"^{clock}\s+(\S.*)$"
    is_span, is_instant = F.col("value").rlike(span), F.col("value").rlike(instant)
    start = F.when(is_span, times.parse_time(part(span, 1))).when(is_instant, times.parse_time(part(instant, 1)))
    end = F.when(is_span, times.parse_time(part(span, 2))).when(is_instant, start)
    bad = F.when(~is_span & ~is_instant, "unreadable").when(end < start, "ends before it begins")
    return v.select(F.when(is_span, "range").when(is_instant, "instant").alias("kind"), start.alias("start_sec"), end.alias("end_sec"), F.when(is_span, part(span, 3)).when(is_instant, part(instant, 2)).alias("label"), bad.alias("warning"))


def read_timeline_text(spark: SparkSession, path: str) -> DataFrame:
    return parsed_timeline(spark.read.text(path))


def media_inventory(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("mp4", "mkv", "mov", "avi", "webm")) -> DataFrame:
    """(path, name, length, modified) of files below ``path``; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return f.where(extension.isin(*extensions)).select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", "modified")


def pending(work: DataFrame, done: DataFrame, key: str = "stem", redo: bool = False) -> DataFrame:
    """Work whose key has no output yet; all of it with ``redo``."""
    return work if redo else work.join(done.select(key).distinct(), key, "left_anti")
