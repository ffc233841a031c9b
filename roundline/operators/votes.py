"""Majorities, votes for names, and identities.

Votes are summed by text before anything else, so hot texts cost one row; what is
folded in order, or grouped in a Python function, is the short list of distinct
texts of one recording.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names
from ..sources import files
from . import name_index

CLUSTERS = "stem string, rank long, canonical string, core string, weight double, samples long, best_conf double, variants array<string>"


def majority(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Most frequent value; of equally frequent ones the first seen."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), "first")).alias("value"))


def summed(votes: DataFrame) -> DataFrame:
    """(stem, text, weight, conf, samples, first) of each distinct text."""
    return votes.groupBy("stem", "text").agg(F.sum("weight").alias("weight"), F.max("conf").alias("conf"), F.count("*").alias("samples"), F.min("ord").alias("first"))


def top_names(votes: DataFrame, others: int) -> DataFrame:
    """Most frequent name of each recording and the next ones."""
    t = votes.groupBy("stem", "text").agg(F.count("*").alias("n"), F.max("conf").alias("c"), F.min("ord").alias("f"))
    k = t.withColumn("k", F.row_number().over(W.partitionBy("stem").orderBy(F.desc("n"), "f"))).where(F.col("k") <= others + 1)
    listed = F.sort_array(F.collect_list(F.struct("k", "text", "n", "c")))
    rest = F.nullif(F.array_join(F.transform(F.slice("x", 2, others), lambda s: s["text"]), "|"), F.lit(""))
    return k.groupBy("stem").agg(listed.alias("x")).select("stem", F.col("x")[0]["text"].alias("top"), F.col("x")[0]["n"].alias("hits"), F.col("x")[0]["c"].alias("conf"), rest.alias("others"))


def confidence(vote_ratio: Column, cross: Column, mode: Column) -> Column:
    return F.least(F.lit(1.0), vote_ratio * 0.5 + cross * 0.3 + mode * 0.2)


def soft_accepted(votes: DataFrame, dominance: float = 0.38, core_least: int = 3, samples_least: int = 2) -> DataFrame:
    """Heaviest core name of each recording, if it is seen often enough and far
    enough ahead of the second."""
    c = votes.groupBy("stem", names.core(F.col("text")).alias("core")).agg(F.sum("weight").alias("w"), F.count("*").alias("n")).where(F.length("core") >= core_least)
    r = F.row_number().over(W.partitionBy("stem").orderBy(F.desc("w"), "core"))
    second = F.lead("w").over(W.partitionBy("stem").orderBy(F.desc("w"), "core"))
    top = c.withColumns({"r": r, "second": second}).where("r = 1")
    ok = (F.col("n") >= samples_least) & (F.col("second").isNull() | (F.col("w") / (F.col("w") + F.col("second")) >= dominance))
    return top.select("stem", F.when(ok, F.col("core")).alias("accepted"))


def clusters(votes: DataFrame) -> DataFrame:
    """Leader clusters of the texts of each recording: texts by falling weight join
    the first cluster whose leader they match, else lead one.

    Candidates come from the name index over the distinct texts of a recording; the fold
    sees the matched pairs only."""
    d = files.written(summed(votes), "texts").withColumn("r", F.row_number().over(W.partitionBy("stem").orderBy(F.desc("weight"), "first")))
    one_name = names.forms_match(*(F.col(c) for c in ("nx", "ny", "cx", "cy")))
    pairs = name_index.formed_candidates(d).where(one_name).select("stem", "x", "y")
    rank = lambda side, to: d.select("stem", F.col("text").alias(side), F.col("r").alias(to))
    links = pairs.join(rank("x", "__x"), ["stem", "x"]).join(rank("y", "__y"), ["stem", "y"])
    links = links.groupBy("stem", F.greatest("__x", "__y").alias("r")).agg(F.sort_array(F.collect_list(F.least("__x", "__y"))).alias("leaders"))
    rows = d.join(links, ["stem", "r"], "left").withColumns({"core": names.core(F.col("text")), "null_name": names.is_null_name(names.normal(F.col("text")))})

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        found: dict[int, list] = {}
        for x in part.sort_values("r").itertuples():
            leader = next((c for c in (x.leaders if x.leaders is not None else []) if c in found), x.r)
            found.setdefault(leader, []).append(x)
        out = []
        for members in found.values():
            lead = members[0]
            core = lead.core or lead.text
            name = "null" if any(m.null_name for m in members) else core if len(core) >= 4 else lead.text
            out.append((part.stem.iloc[0], 0, name, "null" if name == "null" else core, sum(m.weight for m in members), sum(m.samples for m in members), max(m.conf for m in members), [m.text for m in members]))
        out.sort(key=lambda c: -c[4])
        return pd.DataFrame([(c[0], i + 1, *c[2:]) for i, c in enumerate(out)], columns=[c.split()[0] for c in CLUSTERS.split(", ")])

    return rows.groupBy("stem").applyInPandas(fold, CLUSTERS)


def identities(votes: DataFrame, votes_least: int = 4, least: float = 0.35) -> DataFrame:
    """One name a recording: the heaviest cluster if it passes the gate, else the
    softly accepted core, else none."""
    c = clusters(votes)
    totals = c.groupBy("stem").agg(F.sum("weight").alias("total"), F.max("samples").alias("most"), F.sum("samples").alias("n"))
    cross = votes.groupBy("stem").agg((F.count_if(F.col("weight") == 0.5) / F.count("*")).alias("cross"))
    top = c.where("rank = 1").join(totals, "stem").join(cross, "stem").join(soft_accepted(votes), "stem", "left")
    sure = confidence(F.col("weight") / F.col("total"), F.col("cross"), F.col("most") / F.col("n"))
    passed = (F.col("samples") >= votes_least) & (sure >= least)
    name = F.when(passed, F.col("canonical")).otherwise(F.col("accepted"))
    mode = F.when(passed, "gate").when(F.col("accepted").isNotNull(), "soft").otherwise("none")
    return top.select("stem", name.alias("name"), F.round(sure, 6).alias("confidence"), mode.alias("mode"), F.col("samples"))
