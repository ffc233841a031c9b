"""Operators without SQL, and edge cases."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from roundline.functions import names, times
from roundline.operators import evaluate, intervals, islands, repair, similarity, tracker, verify, votes
from roundline.sources import files
from roundline.streaming import live


def test_transitions_with_reset(spark):
    rows = [("v", float(i), v) for i, v in enumerate([0, 0, 1, 1, 2, 2, 0, 0, 1, 1])]
    got = islands.confirmed_transitions(spark.createDataFrame(rows, "stem string, t double, red long"), "red").orderBy("t_hi").collect()
    assert [(r.old, r.new, r.kind) for r in got] == [(0, 1, "win"), (1, 2, "win"), (2, 0, "reset"), (0, 1, "win")]


def test_greedy_matches_equal_a_sequential_pass(spark):
    rng = random.Random(2)
    gt = [(f"v{rng.randrange(3)}", i, float(g := rng.randrange(300)), float(g + 5)) for i in range(40)]
    det = [(f"v{rng.randrange(3)}", i, float(d := rng.randrange(300)), float(d + rng.randrange(9))) for i in range(40)]
    got = intervals.greedy_matches(spark.createDataFrame(gt, "stem string, idx long, g1 double, g2 double"), spark.createDataFrame(det, "stem string, idx long, d1 double, d2 double"), 15.0)
    used, expected = set(), {}
    for s, i, g1, g2 in gt:
        hit = next((j for t, j, d1, d2 in det if t == s and j not in used and g1 - 15 <= d2 and d1 - 15 <= g2), None)
        used.add(hit)
        expected[i] = hit
    assert {r.idx: r.hit for r in got.collect()} == expected


def test_thinning_keeps_leaders(spark):
    df = spark.createDataFrame([("v", float(t)) for t in (0, 1, 2, 3, 4, 7, 8, 20)], "stem string, t double")
    assert [r.t for r in islands.thinned(df).orderBy("t").collect()] == [0.0, 4.0, 8.0, 20.0]


def test_streak_ends(spark):
    states = ["active"] * 3 + ["red_eliminated"] * 4 + ["active"] * 3 + ["unknown"] + ["blue_eliminated"] * 3
    df = spark.createDataFrame([("v", float(i), s) for i, s in enumerate(states)], "stem string, t double, state string")
    assert [(r.t, r.eliminated) for r in islands.streak_ends(df).collect()] == [(3.0, "red")]


def told(readings):
    """Events of a tracker fed one by one."""
    held, out = tracker.Evidence(), []
    for t, k, c in readings:
        held, found = tracker.observe(held, float(t), k, c)
        out += found
    return held, out


def test_tracker_takes_a_kill_back():
    held, out = told([(0, 5, 0.9), (1, 5, 0.9), (2, 6, 0.9), (3, 6, 0.9), (4, 5, 0.9), (4.5, 5, 0.9), (5, 5, 0.9)])
    assert out == [(2.0, "kill", 5, 6), (2.0, "undo", 6, 5)] and held.value == 5


def test_tracker_counts_zeros_of_any_age_and_number():
    """Twenty zeros before the value stands on its own again: the reset is at the first of them."""
    held, out = told([(0, 5, 0.9), (1, 5, 0.9), *((10 + 9 * i, 0, 0.6) for i in range(4)), (50, 5, 0.9), (59, 0, 0.6)])
    assert out == [(10.0, "reset", 5, 0)] and held.value == 0
    # a zero does not age, any other far value does
    assert told([(0, 5, 0.9), (1, 5, 0.9), *((10 + 9 * i, 20, 0.6) for i in range(9))])[1] == []
    many = told([(0, 1, 0.9), (1, 1, 0.9), *((2 + i / 10, 0, 0.6) for i in range(4))])[0]
    assert many.zeros == 4 and many.zero_since == 2.0 and len(many.recent) == 0


def test_tracker_walks_rises_upwards():
    held, out = told([(0, 6, 0.9), (0.1, 6, 0.9), (0.2, 9, 0.5), (0.3, 9, 0.5), (0.4, 8, 0.9), (0.5, 8, 0.9), (0.6, 9, 0.5)])
    assert out == [(0.4, "kill", 6, 8), (0.2, "kill", 8, 9)] and held.value == 9
    assert told([(0, 6, 0.9), (0.1, 6, 0.9), *((1 + i / 10, 15, 0.9) for i in range(5))])[1] == [(1.0, "reset", 6, 15)]
    assert told([(0, 6, 0.5), (1, 6, 0.5)])[0].value is None and told([(0, 6, 0.5), (1, 6, 0.5), (2, 6, 0.5)])[0].value == 6


def slow_tracker(readings):
    """The rules over the whole list of readings: all sightings kept, ages compared at each."""
    value, seen, last, out = None, [], None, []
    for i, (t, k, c) in enumerate(readings):
        seen = [x for x in seen if x[0] >= t - 4 or (x[1] == 0 and value)] + [(t, k, c)]
        of = lambda v: [x for x in seen if x[1] == v]
        sure = lambda v: len(of(v)) >= 3 or (len(of(v)) >= 2 and max(x[2] for x in of(v)) >= 0.75)
        if value is None:
            if sure(k):
                value, seen = k, [x for x in seen if x[1] > k]
            continue
        if k == value:
            continue
        if last and k == last[1] and t - last[0] <= 4 and len(of(k)) >= 3 and not of(last[2]):
            out.remove((last[0], "kill", last[1], last[2]))
            value, seen, last = last[1], [], None
            continue
        while up := [v for v in range(value + 1, value + 4) if of(v) and sure(v)]:
            last = (of(up[0])[0][0], value, up[0])
            out.append((last[0], "kill", value, up[0]))
            value = up[0]
            seen = [x for x in seen if x[1] > value]
        far = [v for v in dict.fromkeys(x[1] for x in seen) if len(of(v)) >= 5 and not value <= v <= value + 3]
        if far:
            base = max(far, key=lambda v: len(of(v)))
            out.append((of(base)[0][0], "reset", value, base))
            value, seen, last = base, [], None
    return out


def noisy(rng, n):
    t, k, out = 0.0, 0, []
    for _ in range(n):
        t += rng.choice([0.25, 0.5, 1.0, 3.0])
        k = 0 if rng.random() < 0.01 else k + (rng.random() < 0.05)
        out.append((round(t, 2), rng.choice([0, k + 1, k + 2, 7]) if rng.random() < 0.2 else k, rng.choice([0.5, 0.7, 0.8, 0.9])))
    return out


def shuffled_stream(spark, rows, path, late=40.0):
    """``rows`` as a stream of files that overlap in time by less than ``late`` seconds, each
    shuffled, and at last a row of another recording far ahead, which brings the watermark on."""
    end = rows.agg(F.max("t")).first()[0]
    jitter = rows.withColumn("file", F.floor((F.col("t") + F.pmod(F.xxhash64("stem", "t"), F.lit(int(late)))) / (end / 3)))
    for i in range(5):
        part = jitter.where(F.col("file") == i).drop("file").orderBy(F.xxhash64("t", "stem"))
        if part.limit(1).count():
            part.coalesce(1).write.mode("append").parquet(str(path / "in"))
    spark.createDataFrame([("zz", end + 1e6)], "stem string, t double").join(rows.limit(0).drop("stem", "t"), F.lit(True), "left").select(rows.columns).coalesce(1).write.mode("append").parquet(str(path / "in"))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))


def test_tracker_equals_brute_force_and_its_live_twin(spark, tmp_path):
    rng = random.Random(8)
    reads = {f"v{i}": noisy(rng, 150) for i in range(30)}
    rows = spark.createDataFrame([(s, *x) for s, xs in reads.items() for x in xs], "stem string, t double, k long, conf double")
    batch = sorted((r.stem, r.t, r.kind, r.old, r.new) for r in tracker.tracked(rows).collect())
    assert batch == sorted((s, *e) for s, xs in reads.items() for e in slow_tracker(xs))
    assert {e[2] for e in batch} == {"kill", "reset"}
    stream = shuffled_stream(spark, rows, tmp_path)
    found = live.drained(spark, live.tracked(stream), f"file://{tmp_path}/live").collect()
    undone = Counter((r.stem, r.t, "kill", r.new, r.old) for r in found if r.kind == "undo")
    kept = Counter((r.stem, r.t, r.kind, r.old, r.new) for r in found if r.kind != "undo")
    assert undone and sorted((kept - undone).elements()) == batch


def states(rng, n):
    return rng.choices(["active", "red_eliminated", "blue_eliminated", "unknown"], [6, 3, 3, 1], k=n)


def test_live_twins_equal_batch(spark, tmp_path):
    """Transitions, ends and runs over shuffled micro-batches, against the batch forms."""
    rng = random.Random(3)
    rows = []
    for v in range(12):
        s, level = "active", 0
        for i in range(160):
            s = rng.choice(states(rng, 4)) if rng.random() < 0.4 else s
            level = max(0, level + rng.choice([0, 0, 0, 1, -1])) if rng.random() < 0.4 else level
            rows.append((f"v{v}", float(i), s, level if rng.random() > 0.1 else None, rng.choice(["row_miss", "template"]) if rng.random() < 0.5 else "row_miss"))
    df = spark.createDataFrame(rows, "stem string, t double, state string, red long, method string")
    stream = lambda made=shuffled_stream(spark, df, tmp_path): made
    drained = lambda made, name: live.drained(spark, made, f"file://{tmp_path}/{name}")
    plain = lambda d, *c: sorted(map(tuple, d.select(*c).collect()))
    ends = plain(islands.streak_ends(df), "stem", "t", "eliminated")
    assert ends and plain(drained(live.eliminations(stream()), "ends"), "stem", "t", "eliminated") == ends
    changes = ("stem", "t_lo", "t_hi", "old", "new", "kind")
    batch = plain(islands.confirmed_transitions(df, "red"), *changes)
    assert batch and plain(drained(live.transitions(stream(), "red"), "changes"), *changes) == batch
    runs = islands.status_runs(df, "row_miss", 3)
    closed = runs.join(df.groupBy("stem").agg(F.max("t").alias("end")), "stem").where("last < end")  # the last run may go on
    assert plain(drained(live.boundary_runs(stream(), "row_miss", 3), "runs"), "stem", "start", "last", "n") == plain(closed, "stem", "start", "last", "n")


def test_silent_recordings_are_forgotten_and_late_readings_dropped(spark, tmp_path):
    rows = [[("a", 10.0, 1), ("a", 11.0, 1), ("b", 10.0, 1)], [("a", 5000.0, 2), ("a", 5001.0, 2), ("b", 900.0, 1)], [("c", 5100.0, 1), ("b", 20.0, 1)], [("b", 9000.0, 2), ("b", 9001.0, 2)], [("z", 20000.0, 1)]]
    for part in rows:
        spark.createDataFrame(part, "stem string, t double, red long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("stem string, t double, red long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = lambda name, **kw: sorted(map(tuple, live.drained(spark, live.transitions(stream(), "red", **kw), f"file://{tmp_path}/{name}").collect()))
    kept = [("a", 11.0, 5000.0, 1, 2, "win"), ("b", 900.0, 9000.0, 1, 2, "win")]
    assert got("kept", late="30 seconds", idle="1 day") == kept
    assert got("forgotten", late="30 seconds", idle="30 minutes") == []  # both are silent for longer: their values begin anew


def test_skips_are_split_and_injected(spark):
    kills = spark.createDataFrame([("a", 50.0, 7, 9), ("b", 10.0, 6, 7), ("b", 60.0, 9, 10), ("c", 10.0, 6, 7), ("c", 60.0, 9, 10), ("d", 5.0, 1, 2)], "stem string, t double, from_k long, to_k long")
    miss = lambda s, *ts: [(s, t, None, "template_miss") for t in ts]
    reads = spark.createDataFrame(
        [("a", 10.0, 7, "template"), *miss("a", 20.0, 21.0), ("a", 22.0, None, "row_miss"), *miss("a", 30.0), ("a", 50.0, 9, "template")]
        + [("b", 10.0, 7, "template"), *miss("b", 20.0), ("b", 25.0, None, "click"), *miss("b", 30.0, 31.0), ("b", 45.0, 9, "template")]
        + [("c", 10.0, 7, "template"), ("c", 45.0, 9, "template")],
        "stem string, t double, k long, method string",
    )
    edges = spark.createDataFrame([("a", 25.0), ("b", 28.0)], "stem string, t double")
    out = repair.injected(repair.split_skips(kills, reads, edges), reads, edges)
    assert sorted(map(tuple, out.collect())) == [
        ("a", 20.0, 7, 8), ("a", 50.0, 8, 9),
        ("b", 10.0, 6, 7), ("b", 20.0, 7, 8), ("b", 45.0, 8, 9), ("b", 60.0, 9, 10),
        ("c", 10.0, 6, 7), ("c", 60.0, 9, 10), ("d", 5.0, 1, 2),
    ]
    late = repair.injected(kills.where("stem = 'b'"), reads, edges.where("stem = 'x'"))
    assert (20.0, 7, 8) in [tuple(r)[1:] for r in late.collect()]


def test_kills_after_a_boundary_go_back(spark):
    kills = spark.createDataFrame([("v", 25.0, 3, 4), ("v", 45.0, 4, 5)], "stem string, t double, from_k long, to_k long")
    cut = spark.createDataFrame([("v", 0, 0.0, 20.0), ("v", 1, 20.0, 40.0), ("v", 2, 40.0, 60.0)], "stem string, seg long, s double, e double")
    reads = spark.createDataFrame([("v", 10.0, 3, "template"), ("v", 30.0, 4, "template"), ("v", 42.0, 4, "template")], "stem string, t double, k long, method string")
    assert sorted((r.t, r.seg) for r in repair.attributed(kills, cut, reads).collect()) == [(25.0, 0), (45.0, 2)]


def test_leaders_equal_one_pass_in_order(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        base = rng.choice([[1, 1, 1, 1, 0, 0, 0, 0, 1, 0], [0, 0, 1, 1, 1, 1, 1, 0, 0, 1], [1, 0, 1, 0, 1, 0, 1, 0, 1, 1]])
        rows.append((i, i % 2, [b ^ (rng.random() < 0.2) for b in base]))
    rows += [(200, 0, [0] * 10), (201, 0, [0] * 10)]
    df = spark.createDataFrame([(i, c, [int(b) for b in x]) for i, c, x in rows], "vec_id long, label int, bits array<int>")
    same = lambda x, y: sum(map(min, x, y)) / max(1, sum(map(max, x, y)))
    expected, leaders, kept, last = {}, {0: [], 1: []}, [], {}
    for i, c, x in rows:
        best = max(((same(x, y), -j) for j, y in leaders[c]), default=(0, 0))
        expected[i] = -best[1] if best[0] >= 0.6 else i
        if expected[i] == i:
            leaders[c].append((i, x))
        if c not in last or same(x, last[c]) < 0.6:
            last[c] = x
            kept.append(i)
    assert {r.vec_id: r.leader for r in similarity.leader_clusters(df, f"file://{tmp_path}/l", 0.6).collect()} == expected
    pairs = {(r.a, r.b): r.iou for r in similarity.similar_pairs(df, 0.6).collect()}
    assert pairs == {(i, j): round(same(x, y), 9) for i, c, x in rows for j, d, y in rows if i < j and c == d and same(x, y) >= 0.6}
    slots = df.withColumn("slot", F.col("label").cast("string"))
    assert sorted(r.vec_id for r in similarity.without_near_repeats(slots, 0.6).collect()) == kept
    few = spark.createDataFrame([(0, [1, 0, 1]), (1, [0, 1, 1])], "label int, bits array<int>")
    got = similarity.claims(spark.createDataFrame([(1, [1, 0, 1]), (2, [0, 0, 1])], "vec_id long, bits array<int>"), few, 0.8, 0.15).orderBy("vec_id").collect()
    assert [(r.best, r.score, r.claimed) for r in got] == [(0, 1.0, 0), (0, 0.5, None)]


def test_round_features(spark):
    rows = [("v", 0, 0.0, 10.0, 1, [4.0], False, 5, 4.0, None, False), ("v", 1, 10.0, 50.0, 3, [10.0, 20.0, 40.0], True, 12, 10.0, 40.0, True), ("v", 2, 50.0, 50.5, 0, [], False, 0, None, None, False)]
    rounds = spark.createDataFrame(rows, "stem string, seg long, s double, e double, kills long, kill_times array<double>, reset boolean, k_samples long, first_kill double, ace_sec double, ace boolean")
    reads = spark.createDataFrame([("v", 1, "template"), ("v", None, "row_miss"), ("v", None, "template_miss"), ("v", None, "click")], "stem string, k long, method string")
    wins = spark.createDataFrame([("v", 10.0), ("v", 50.0), ("v", 90.0)], "stem string, t double")
    got = {r.seg: r for r in verify.round_features(rounds, reads, wins).collect()}
    assert [got[1][f] for f in verify.FEATURES] == pytest.approx([30.0, 0.0, 1.0, 0.0, 10.0, 40.0, 0.3, 12.0, 1.0, 1.0, 0.0, 1 / 3, 1 / 3, (0 + 10 + 30) / 40 / 3, 2.0])
    assert [got[2][f] for f in verify.FEATURES] == pytest.approx([0.0, 1.0, 0.0, -1.0, -1.0, 0.5, 0.0, 0.0, 0.0, 3.0, -1.0, 1 / 3, 2 / 3, -1.0, 1.0])
    assert {r.score_win_count for r in verify.round_features(rounds, reads, None).collect()} == {-1.0}


@pytest.mark.parametrize(("text", "header", "second"), [("스카우터 (L)", True, False), ("스카무터2 (L)", True, True), ("Scouter Z", True, True), ("player", False, False), ("", False, False)])
def test_headers(spark, text, header, second):
    r = spark.createDataFrame([(text,)], "s string").select(names.is_header(F.col("s")).alias("h"), names.is_second_header(F.col("s")).alias("t")).first()
    assert (r.h, r.t) == (header, second)


def test_noise_texts(spark):
    rows = spark.createDataFrame([(x,) for x in ("(L)", "[]", "77 12", "win now", "x", "real name")], "s string")
    assert [r.n for r in rows.select(names.is_noise(F.col("s")).alias("n")).collect()] == [True] * 5 + [False]


def test_nulls_and_empty_tables(spark):
    none = spark.createDataFrame([], "stem string, t double, k long, conf double, method string")
    assert islands.status_runs(none, "row_miss").count() == 0
    assert islands.without_false_zeros(none).count() == 0
    assert tracker.tracked(none).count() == 0
    v = spark.createDataFrame([("v", 1, "abc", 1.0, 0.5), ("v", 2, "abd", 1.0, 0.5)], "stem string, ord long, text string, weight double, conf double")
    assert votes.clusters(v.limit(0)).count() == 0 and votes.clusters(v).count() == 1
    odd = spark.createDataFrame([(None,), ("",), ("x:1",), ("1:02",)], "s string").select(times.parse_time(F.col("s")).alias("t"))
    assert [r.t for r in odd.collect()] == [None, None, None, 62.0]


def test_interval_join_makes_each_pair_once(spark):
    a = spark.createDataFrame([("v", 1, 0.0, 2000.0), ("v", 2, None, 3.0)], "stem string, i long, a1 double, a2 double")
    b = spark.createDataFrame([("v", 7, 10.0, 1500.0)], "stem string, j long, b1 double, b2 double")
    assert [(r.i, r.j) for r in intervals.overlapping(a, b, "a1", "a2", "b1", "b2", width=10.0, how="left").orderBy("i").collect()] == [(1, 7), (2, None)]


def test_ranking_ties_and_ranges(spark):
    rows = [(i % 3 % 2, round((i * 7 % 50) / 50, 2)) for i in range(300)]
    got = evaluate.ranking(spark.createDataFrame(rows, "label long, score double")).first()
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert got.auc == pytest.approx(auc, abs=1e-8)


def test_counter_steps_reject_in_order(spark):
    columns = "stem string, round int, kills long, deaths long, team_sum long, match_total int, team_wins int, play_gap double, inferred boolean, match_score double"
    row = lambda i, k, gap=45.0, deaths=1, total=None, inferred=False, score=0.9: ("v", i, k, deaths, 100 * i, i if total is None else total, i, gap, inferred, score)
    rows = [row(1, 0), row(2, 3), row(3, 6, gap=20.0), row(4, 9), row(5, 12, gap=90.0), row(6, 15, deaths=2), row(7, 18, total=9), row(8, 2), row(9, 9), row(10, None), row(11, 12), row(12, 15, inferred=True), row(13, 18, inferred=True, score=0.1)]
    got = evaluate.counter_steps(spark.createDataFrame(rows, columns)).orderBy("round").collect()
    assert [r.verdict for r in got] == ["first", "ace", "consecutive_ace", "ace", "play_gap_wide", "deaths_increased", "match_rounds", "reset", "error", "none", "candidate", "match_low"]


def test_files(spark, tmp_path):
    path = str(tmp_path / "old.json")
    (tmp_path / "old.json").write_text('{"stem":"v","scan_fps":4,"duration":9,"reads":[[0.5,3,0.9,"T"],[1.0,null,0.2,"R"]]}\n')
    got = files.read_signal_cache(spark, path).orderBy("i").collect()
    assert [(r.t, r.k, r.method, r.d) for r in got] == [(0.5, 3, "template", None), (1.0, None, "row_miss", None)]
    (tmp_path / "x.json").write_text('{"stem":"a","rounds":[{"seg":0,"kills":1,"ace":false}]}\n{"stem":"b","rounds":[{"seg":1}]}\n{broken\n')
    assert [(r.stem, r.sound) for r in files.sound_timelines(spark, str(tmp_path / "x.json")).collect()] == [("a", True), ("b", False), (None, False)]
    (tmp_path / "bom.csv").write_text("﻿start_sec,end_sec,n\n1,2,x\n3,1,y\n,5,z\n", encoding="utf-8")
    assert [r.n for r in files.read_spans(spark, str(tmp_path / "bom.csv")).collect()] == ["x"]
    (tmp_path / "media").mkdir()
    (tmp_path / "media" / "a.mp4").write_bytes(b"12")
    (tmp_path / "media" / "b.txt").write_bytes(b"1")
    assert [(r.name, r.length) for r in files.media_inventory(spark, str(tmp_path / "media")).collect()] == [("a.mp4", 2)]
    df = spark.createDataFrame([("v", 1.0)], "stem string, x double")
    files.write_table(df, str(tmp_path / "t"), {"x": 2})
    with pytest.raises(Exception, match="exists"):
        files.write_table(df, str(tmp_path / "t"))
    files.write_table(df, str(tmp_path / "t"), overwrite=True)
    (tmp_path / "gt.json").write_text('{\n "v": {"spans": [[1, 2],\n [3, 4]], "source_available": true},\n "w": {"spans": [], "source_available": false}\n}')
    assert files.read_truths(spark, str(tmp_path / "gt.json"), whole=True).count() == 2
    assert files.pending(df, df).count() == 0 and files.pending(df, df, redo=True).count() == 1
