"""Steps whose cost would outgrow the tables: what is joined, broadcast or held at once."""

import random

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from roundline import registry
from roundline.streaming import live
from roundline.operators import boosting, islands, name_index, similarity, verify


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_repeats_of_rows_are_not_broadcast(spark, tmp_path):
    """A small table's estimate says nothing of the twenty repeats of its rows."""
    spark.range(50).select(F.lit("s").alias("stem"), F.col("id").alias("seg"), (F.col("id") % 2).alias("label"), F.col("id").cast("double").alias("x")).write.parquet(f"{tmp_path}/rows")
    pairs = verify._swapped(spark.read.parquet(f"{tmp_path}/rows"), ["x"], ("stem", "seg"), 3, 42)
    assert "SortMergeJoin [rank" in plan_of(pairs)
    assert sorted(r["count"] for r in pairs.groupBy("repeat").count().collect()) == [50] * 4


def test_keys_of_names_are_not_broadcast(spark, tmp_path):
    """Neither the keys of large recordings nor the pairs of small ones are broadcast."""
    spark.createDataFrame([("s", f"name{i}") for i in range(30)], "stem string, text string").write.parquet(f"{tmp_path}/names")
    t = spark.read.parquet(f"{tmp_path}/names")
    assert "BroadcastHashJoin" not in plan_of(name_index.matches(t)) + plan_of(name_index.matches(t, t))


def test_small_and_large_recordings_have_the_same_matches(spark, monkeypatch):
    rows = spark.createDataFrame([(f"s{i % 2}", t) for i, t in enumerate(["null", "nu11", "abcdef", "abcdxf", "xxabcdef", "zz", "z", "player one", "playerone", "qqqqqqqq", None] * 2)], "stem string, text string")
    found = []
    for small in (name_index.SMALL, 1):  # of two texts on, the index
        monkeypatch.setattr(name_index, "SMALL", small)
        found.append([sorted(map(tuple, d.collect())) for d in (name_index.matches(rows), name_index.matches(rows, rows.where("text > 'b'")))])
    assert found[0] == found[1] and found[0][0]


def test_all_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(name_index, "SMALL", 4)
    rows = spark.createDataFrame([("s", f"n{i % 23}") for i in range(40)] + [("t", "a")], "stem string, text string")
    assert name_index.all_pairs(rows).count() == 23 * 22 // 2


def test_stamps_of_a_hundred_hours(spark, tmp_path):
    """The SQL once cut hours to two digits."""
    spark.range(1_439_990, 1_440_010).withColumnRenamed("id", "event_id").write.parquet(f"{tmp_path}/events.parquet")
    df = registry.queries()["b3_time_texts"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    theirs = c.execute(registry.oracle_sql()["b3_time_texts"]).fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(theirs)
    assert "100h00m00s" in {r[3] for r in theirs}


def names_of_sources(spark, data):
    from roundline.functions import names
    from roundline.sources import adapters as A

    return A.source_votes(spark, data).select("stem", names.stripped(F.col("text")).alias("text")).distinct()


@pytest.mark.parametrize("name", ["s4_levenshtein", "s6_s8_name_match"])
def test_all_names_of_a_source_are_compared(spark, data, name):
    sizes = [r["count"] for r in names_of_sources(spark, data).groupBy("stem").count().collect()]
    assert registry.queries()[name](spark, data).count() == sum(n * (n - 1) // 2 for n in sizes)


def test_confirmation_looks_through_whole_sources(spark):
    stems = {r.stem for r in registry.queries()["c13_cross_confirmation"](spark, "/root/testdata/sf0.01").select("stem").distinct().collect()}
    assert stems and all(s.startswith("src") for s in stems)


def test_team_mates_are_those_of_the_whole_source(spark, data):
    stems = {r.stem for r in registry.queries()["c24_team_by_names"](spark, data).select("stem").distinct().collect()}
    assert stems and all(s.startswith("src") for s in stems)


def test_explicit_sources_come_first(spark, data):
    """Recordings numbered from v00000 never had an explicit folder."""
    assert {r.source for r in registry.queries()["a21_source_fallback"](spark, data).collect()} == {"explicit", "convention"}


def test_similar_pairs_meet_in_blocks(spark, monkeypatch):
    """Blocks of a few vectors, shifts, copies, ragged and missing bits: equal to all pairs."""
    monkeypatch.setattr(similarity, "BLOCK", 5)
    monkeypatch.setattr(similarity, "ROWS", 3)
    rng = random.Random(3)
    rows = [(i, i % 2, [rng.randrange(2) for _ in range(9 if i % 7 else 4)]) for i in range(60)]
    rows += [(100, 0, None), (101, 0, [1, None, 1, 0]), (102, 0, [0] * 9), (103, None, [1] * 9), (104, 0, rows[2][2]), (105, 0, [])]
    df = spark.createDataFrame(rows, "vec_id long, label int, bits array<int>")

    def iou(a, b):
        either = sum(map(max, a, b))
        return sum(map(min, a, b)) / either if either else 0.0

    def moved(x, s):
        return x if not s else x[1:] + [0] if s < 0 else [0] + x[:-1]

    sound = [r for r in rows if r[2] and r[1] is not None and None not in r[2]]
    for shifts in ((0,), (0, -1, 1)):
        want = {(la, a, b): max(iou(x, moved(y, s)) for s in shifts) for a, la, x in sound for b, lb, y in sound if a < b and la == lb and len(x) == len(y)}
        got = {(r.label, r.a, r.b): r.iou for r in similarity.similar_pairs(df, 0.5, shifts).collect()}
        assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items() if v >= 0.5} and got


def test_bands_are_counted_by_value(spark, data):
    """Rows of a group do not meet in pairs."""
    df = registry.queries()["c26_densest_band"](spark, data)
    assert "Join" not in plan_of(df)


def test_models_are_dealt_to_tasks(spark, tmp_path, monkeypatch):
    """A pass over one part of rows is several tasks, with the sums of one task; many models of
    several shapes by matrix products equal few models one by one."""
    rng = random.Random(5)
    rows = [(rng.randrange(1, 12), rng.randrange(2), bytes([rng.randrange(9), rng.randrange(4)])) for _ in range(300)]
    spark.createDataFrame(rows, "model int, y int, bins binary").coalesce(1).write.parquet(f"{tmp_path}/rows")
    t = spark.read.parquet(f"{tmp_path}/rows")
    own = [[sum(1 for m, y, _ in rows if m == i and y == c) for c in (0, 1)] for i in range(12)]
    counts = np.array(own, dtype=float).sum(axis=0) - np.array(own, dtype=float)
    made = []
    for models, many in ((64, 100), (3, 2)):
        monkeypatch.setattr(boosting, "_MODELS", models)
        monkeypatch.setattr(boosting, "_MANY", many)
        made.append(boosting.boosted(t, 12, 2, counts, rounds=3, bins=16))
    one, dealt = made
    for a, b in zip(one.leaf, dealt.leaf, strict=True):
        assert a == pytest.approx(b, abs=1e-12)
    assert len({tuple(f) for f in np.concatenate(one.leaf).T.round(9).tolist()}) > 1


def test_changes_of_both_sides_share_one_sort(spark, data):
    """Readings are sorted once for their number and once for all changes."""
    plan = plan_of(registry.queries()["e8_transitions"](spark, data))
    assert plan.split("Initial Plan")[-1].count("Sort [") <= 2


def test_changes_of_equal_times_and_nulls(spark):
    """Readings of one time go by ``order``; three in a row, unsure sightings of the old value count."""
    rows = [("a", 1.0, 2, 5), ("a", 1.0, 1, 5), ("a", 2.0, 3, None), ("a", 3.0, 4, 5), ("a", 4.0, 5, 7), ("a", 5.0, 6, 5), ("a", 6.0, 7, 7), ("a", 6.0, 8, 7), ("a", 6.5, 9, None), ("a", 7.0, 10, 7), ("a", 8.0, 11, 7)]
    df = spark.createDataFrame(rows, "stem string, t double, rn int, v long")
    got = islands.confirmed_changes(df, ["v"], least=3, order=("rn",)).collect()
    assert [tuple(r) for r in got] == [("a", 5.0, 6.0, 5, 7, "win", "v")]


def test_rounds_of_the_verifier_are_made_once(spark, data, monkeypatch):
    from roundline.plans import learning

    made, timelines = [], learning.A.timelines
    monkeypatch.setattr(learning.A, "timelines", lambda *a: made.append(1) or timelines(*a))
    _, rows, _ = learning.labelled_aces(spark, data)
    assert len(made) == 1 and rows.columns[-1] == "label"


def test_waiting_readings_are_packed(spark):
    """A micro-batch's readings of a recording are one element of its state, with their nulls."""
    schema = pa.schema([("at_ms", pa.int64()), ("t", pa.float64()), ("red", pa.int64()), ("s", pa.string())])
    own, kept = live._InOrder(schema, "n long", [], None, 1), []
    own._names, own._waiting = schema.names, type("State", (), {"get": lambda self: iter(kept)})()
    rows = pd.DataFrame({"at_ms": [1, 2], "t": [0.5, None], "red": [None, 7.0], "s": ["x", None]})
    assert list(own._unpacked().columns) == schema.names and not len(own._unpacked())
    kept += [own._packed(own._table(rows)), own._packed(own._table(rows[1:]))]
    got = own._unpacked()
    assert [len(kept), len(got), got["at_ms"].tolist()] == [2, 3, [1, 2, 2]]
    assert got["red"].isna().tolist() == [True, False, False] and got["red"][2] == 7 and got["s"][0] == "x" and got["s"].isna()[2]
