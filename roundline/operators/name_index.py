"""Candidates for fuzzy name matches without comparing all pairs.

Two names can only match (``names.names_match``, ``names.cores_match``) if they are both
misreadings of "null", have equal kept characters, if one of four kept characters or
more is part of the other, or if few edits lead from one to the other.  Each way leaves a
key that both sides have:

* edits: strings that k edits take to one another share a string that is left of each
  after at most k deletions.  Names of up to ``DELETED`` characters are indexed under all
  that is left of them; of longer ones, cut into four pieces, at least one piece stands
  unchanged in the other name, at most three places off;
* containment: the shorter name is looked up by its rarest run of four characters among
  all runs of the longer ones.

So no match is missed, and the pairs that meet grow with the matches.  The texts of a
recording that has ``SMALL`` of them at most are all compared instead: that is less work than
the keys of the index.  Candidates are verified by the caller.

Exploded keys are far more than the texts' size tells Spark, so no join of them may be a
broadcast: all are hinted.
"""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import names
from ..sources import files

#: distinct texts of a side up to which a recording's pairs are all compared, and of one block of
#: them that meets another in one place
SMALL = 1000
#: most edits between matching names, the shortest run that counts as contained, and the
#: length up to which deletions are indexed (strings that differ by MOST_EDITS from it too)
MOST_EDITS, GRAM, DELETED = 3, 4, 16


def _edits(length: int) -> int:
    return 1 if length <= 3 else 2 if length <= 5 else MOST_EDITS


def deletions(name: str) -> set[str]:
    """What is left of a name after up to as many deletions as it allows edits."""
    n = len(name)
    return {"".join(name[a + 1 : b] for a, b in zip((-1, *gone), (*gone, n), strict=True)) for k in range(min(n, _edits(n)) + 1) for gone in combinations(range(n), k)}


def _cuts(length: int) -> list[tuple[int, int]]:
    parts = MOST_EDITS + 1
    return [(length * i // parts, length * (i + 1) // parts) for i in range(parts)]


def pieces(name: str) -> list[str]:
    """The pieces of a long name, with its length and their number."""
    return [f"{len(name)}/{i}/{name[a:b]}" for i, (a, b) in enumerate(_cuts(len(name)))]


def places(name: str) -> set[str]:
    """All that may be a piece of a name within MOST_EDITS edits of this one."""
    out = set()
    for length in range(max(DELETED + 1, len(name) - MOST_EDITS), len(name) + MOST_EDITS + 1):
        for i, (a, b) in enumerate(_cuts(length)):
            for start in range(max(0, a - MOST_EDITS), min(len(name) - (b - a), a + MOST_EDITS) + 1):
                out.add(f"{length}/{i}/{name[start : start + b - a]}")
    return out


@F.pandas_udf(ArrayType(StringType()))
def _left(text: pd.Series) -> pd.Series:
    return text.map(lambda t: list(deletions(t)) if isinstance(t, str) and t and len(t) <= DELETED + MOST_EDITS else [])


@F.pandas_udf(ArrayType(StringType()))
def _pieces(text: pd.Series) -> pd.Series:
    return text.map(lambda t: pieces(t) if isinstance(t, str) and len(t) > DELETED else [])


@F.pandas_udf(ArrayType(StringType()))
def _places(text: pd.Series) -> pd.Series:
    return text.map(lambda t: list(places(t)) if isinstance(t, str) and len(t) > DELETED else [])


def _grams(text: Column) -> Column:
    starts = F.sequence(F.lit(1), F.length(text) - GRAM + 1)
    return F.when(F.length(text) >= GRAM, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def _tagged(tag: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(tag), k))


def forms(texts: DataFrame, by: str, text: str) -> DataFrame:
    """(by, text, n, c): the distinct texts with their normal and kept forms."""
    return texts.select(by, text).distinct().withColumns({"n": names.normal(F.col(text)), "c": names.core(F.col(text))})


def _alike(f: DataFrame, by: str, text: str) -> DataFrame:
    """Keys that both names of a pair have."""
    null = F.when(names.is_null_name(F.col("n")) | names.is_null_name(F.col("c")), F.array(F.lit("null")))
    none = F.array().cast("array<string>")
    other = F.when(F.col("c") != F.col("n"), F.col("c"))
    keys = F.concat(_tagged("d", _left(F.col("n"))), _tagged("d", _left(other)), F.when(F.col("c") != "", F.array(F.concat(F.lit("="), F.col("c")))).otherwise(none), F.coalesce(null, none))
    return f.select(by, text, F.explode(F.array_distinct(keys)).alias("key"))


def _wide(f: DataFrame, by: str, text: str) -> DataFrame:
    """Keys under which a name is found by its shorter or other partner."""
    other = F.when(F.col("c") != F.col("n"), F.col("c"))
    return f.select(by, text, F.explode(F.array_distinct(F.concat(_tagged("g", _grams(F.col("c"))), _tagged("p", _places(F.col("n"))), _tagged("p", _places(other))))).alias("key"))


def _narrow(f: DataFrame, wide: DataFrame, by: str, text: str) -> DataFrame:
    """Keys by which a name looks for partners: its rarest run among theirs, and its pieces."""
    other = F.when(F.col("c") != F.col("n"), F.col("c"))
    counts = wide.where("key like 'g%'").groupBy(by, "key").agg(F.count("*").alias("n"))
    grams = f.select(by, text, F.explode(_tagged("g", _grams(F.col("c")))).alias("key"))
    # a run that no partner has rules containment out, so its count of none comes first
    rarest = grams.hint("merge").join(counts, [by, "key"], "left").groupBy(by, text).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("k"))
    pieces_ = f.select(by, text, F.explode(F.array_distinct(F.concat(_tagged("p", _pieces(F.col("n"))), _tagged("p", _pieces(other))))).alias("key"))
    return rarest.select(by, text, "k.key").unionByName(pieces_)


def _crossed(f: DataFrame, g: DataFrame, sizes: DataFrame, by: str, text: str) -> DataFrame:
    """(by, x, nx, cx, y, ny, cy): all texts of ``f`` with all of ``g`` in each group of ``sizes``
    (by, f_texts, g_texts).  Large groups meet in blocks, so no task or key holds one whole."""
    spark = f.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = lambda c: F.ceil(F.col(c) / SMALL).cast("int")
    own = lambda c: F.pmod(F.xxhash64(text), blocks(c)).cast("int")
    all_of = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    side = lambda d, to, i, j: d.hint("merge").join(sizes, by).select(by, F.col(text).alias(to), F.col("n").alias(f"n{to}"), F.col("c").alias(f"c{to}"), i.alias("__i"), j.alias("__j"))
    x, y = side(f, "x", own("f_texts"), F.lit(0)).drop("__j"), side(g, "y", F.lit(0), own("g_texts")).drop("__i")
    x = x.hint("merge").join(sizes.select(by, all_of("g_texts").alias("__j")), by)
    y = y.hint("merge").join(sizes.select(by, all_of("f_texts").alias("__i")), by)
    # a partition's pairs are many more than its bytes tell, so the number of partitions is fixed
    keys = [by, "__i", "__j"]
    return x.repartition(n, *keys).hint("merge").join(y.repartition(n, *keys), keys).drop("__i", "__j")


def _prepared(left: DataFrame, right: DataFrame | None, by: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Forms of both sides and (by, f_texts, g_texts) of the groups that both have: written once."""
    f = files.written(forms(left.where(F.col(text).isNotNull()), by, text), "names")
    g = f if right is None else files.written(forms(right.where(F.col(text).isNotNull()), by, text), "names")
    count = lambda d, to: d.groupBy(by).agg(F.count("*").alias(to))
    return f, g, files.written(count(f, "f_texts").join(count(g, "g_texts"), by), "sizes")


def all_pairs(texts: DataFrame, by: str = "stem", text: str = "text") -> DataFrame:
    """(by, x, y, nx, ny, cx, cy): all pairs x < y of a group's distinct texts, with the normal and
    kept forms of both."""
    f, g, sizes = _prepared(texts, None, by, text)
    return _crossed(f, g, sizes, by, text).where("x < y")


def formed_candidates(left: DataFrame, right: DataFrame | None = None, by: str = "stem", text: str = "text") -> DataFrame:
    """``candidates`` with the normal and kept forms of both texts (nx, ny, cx, cy)."""
    f, g, sizes = _prepared(left, right, by, text)
    few = F.greatest("f_texts", "g_texts") <= SMALL
    near = _crossed(f, g, sizes.where(few), by, text).where(names.forms_match(*(F.col(c) for c in ("nx", "ny", "cx", "cy"))))
    large = sizes.where(~few).select(by)
    far = _indexed(f.hint("merge").join(large, by), None if right is None else g.hint("merge").join(large, by), by, text)
    form = lambda c: {f"n{c}": names.normal(F.col(c)), f"c{c}": names.core(F.col(c))}
    return (near.where("x < y") if right is None else near).unionByName(far.withColumns(form("x") | form("y")))


def candidates(left: DataFrame, right: DataFrame | None = None, by: str = "stem", text: str = "text") -> DataFrame:
    """(by, x, y): pairs of distinct texts of ``left`` and ``right`` that may match, each once;
    with one side only, pairs with x < y.  Null texts match nothing."""
    return formed_candidates(left, right, by, text).select(by, "x", "y")


def _indexed(f: DataFrame, g: DataFrame | None, by: str, text: str) -> DataFrame:
    """(by, x, y) that share a key of the index, each once; ``g`` None: pairs of ``f`` with x < y."""
    one_side, g = g is None, f if g is None else g
    name = lambda d, to: d.withColumnRenamed(text, to)
    met = lambda a, b: a.hint("merge").join(b, [by, "key"]).select(by, "x", "y")
    wf = _wide(f, by, text)
    wg = wf if one_side else _wide(g, by, text)
    pairs = met(name(_alike(f, by, text), "x"), name(_alike(g, by, text), "y"))
    pairs = pairs.unionByName(met(name(_narrow(f, wg, by, text), "x"), name(wg, "y")))
    if not one_side:
        return pairs.unionByName(met(name(_narrow(g, wf, by, text), "y"), name(wf, "x"))).distinct()
    return pairs.where("x <> y").select(by, F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def matches(left: DataFrame, right: DataFrame | None = None, by: str = "stem", text: str = "text") -> DataFrame:
    """(by, x, y): pairs of distinct texts that are one name by ``names.texts_match``."""
    one_name = names.normal_match(*(F.col(c) for c in ("nx", "ny", "cx", "cy")))
    return formed_candidates(left, right, by, text).where(one_name).select(by, "x", "y")
