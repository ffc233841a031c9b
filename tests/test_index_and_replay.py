"""The name index against all pairs, the signal data source, and incremental replay."""

import json
import random

import pytest
from pyspark.sql import functions as F
from roundline.functions import names
from roundline.operators import islands, name_index, replay, settle
from roundline.sources import files, signal_source


def test_deletions_and_pieces_reach_all_names_within_three_edits():
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 26)))
        b = list(a)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(b) + 1)
            edit = rng.randrange(3)
            b[at : at + (edit > 0)] = [] if edit == 2 else [rng.choice("abcd")]
        b = "".join(b)
        allowed = 1 if min(len(a), len(b)) <= 3 else 3 if min(len(a), len(b)) >= 6 else 2
        if not b or distance(a, b) > allowed:
            continue
        short = min(len(a), len(b)) <= name_index.DELETED
        assert set(name_index.deletions(a)) & set(name_index.deletions(b)) if short else set(name_index.pieces(a)) & name_index.places(b), (a, b)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _names(rng, n):
    out = ["null", "nu11", " Null ", "nuii", "mull", "", " ", "é", "abcd", "xxabcdxx", "스카우터", "스카무터", "player-one", "playerone", "PLAYER ONE", "한글이름길게쓰기"]
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 24))) for _ in range(n)]
    for b in base:
        out.append(b)
        c = list(b)
        for _ in range(rng.randrange(1, 5)):
            c[rng.randrange(len(c))] = rng.choice("abcdefgh-_ é")
        out += ["".join(c), rng.choice("xyz") * 3 + b, b[1:]]
    return out


def test_index_finds_the_matches_of_all_pairs(spark):
    rng = random.Random(4)
    rows = [(f"s{i % 2}", t) for i, t in enumerate(_names(rng, 60))] + [("s0", None), (None, "abc")]
    df = spark.createDataFrame(rows, "stem string, text string")
    some = df.where(F.col("text").isNotNull()).distinct()
    x, y = F.col("x"), F.col("y")
    every = some.select("stem", F.col("text").alias("x")).join(some.select("stem", F.col("text").alias("y")), "stem")
    plain = lambda d: sorted(map(tuple, d.select("stem", "x", "y").collect()))
    found = files.written(name_index.candidates(df), "found")
    for rule in (names.texts_match(x, y), names.cores_match(x, y), names.forms_match(names.normal(x), names.normal(y), names.core(x), names.core(y))):
        assert plain(found.where(rule)) == plain(every.where("x < y").where(rule))
    left, right = df.where("length(text) % 2 = 0"), df.where("length(text) % 3 > 0")
    two = name_index.matches(left, right)
    assert plain(two) == plain(every.where("length(x) % 2 = 0 and length(y) % 3 > 0").where(names.texts_match(x, y)))
    assert found.count() == found.distinct().count()


def test_pairs_that_meet_grow_with_the_matches(spark):
    """Twice as many unlike names do not make four times as many pairs."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14))
    counts = []
    for n in (400, 800):
        df = spark.createDataFrame([("s", word()) for _ in range(n)], "stem string, text string")
        counts.append(name_index.candidates(df).count())
    assert max(counts) < 40


# --- data source -------------------------------------------------------------


READS = "stem string, rn long, t double, k long, conf double, method string, d long, a long"


def test_signals_of_both_versions_and_damaged_files(spark, tmp_path):
    (tmp_path / "old.json").write_text(json.dumps({"stem": "old", "duration": 9, "reads": [[1.0, 3, 0.5, "T"], [2.0, None, 0.1, "R"]]}))
    (tmp_path / "new.json").write_text(json.dumps({"version": 2, "stem": "new", "scan_fps": 2.0, "duration": 9.5, "reads": [[1.5, 3, 0.5, "Z", 1, None]], "boundary_verdicts": None}))
    (tmp_path / "none.json").write_text(json.dumps({"version": 2, "stem": "none", "duration": 1.0, "reads": []}))
    for name, text in {"cut.json": '{"stem": "x", "rea', "list.json": "[1, 2]", "bytes.json": b"\xff\xfe\x00", "short.json": '{"stem": "y", "duration": 1, "reads": [[1.0]]}', "empty.json": ""}.items():
        (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    (tmp_path / "notes.txt").write_text("no document")
    rows = signal_source.read_signals(spark, str(tmp_path)).collect()
    good = sorted((r.file, r.stem, r.version, r.scan_fps, r.duration, r.i, r.t, r.k, r.conf, r.method, r.d, r.a) for r in rows if r.damage is None and r.i is not None)
    assert good == [("new.json", "new", 2, 2.0, 9.5, 0, 1.5, 3, 0.5, "Z", 1, None), ("old.json", "old", 1, 4.0, 9.0, 0, 1.0, 3, 0.5, "template", None, None), ("old.json", "old", 1, 4.0, 9.0, 1, 2.0, None, 0.1, "row_miss", None, None)]
    assert sorted(r.file for r in rows if r.damage) == ["bytes.json", "cut.json", "empty.json", "list.json", "short.json"]
    assert [r.stem for r in rows if r.i is None and r.damage is None] == ["none"]


def test_signals_round_trip_and_guard(spark, tmp_path):
    rows = [("a b", i, i / 7, i % 5 if i % 3 else None, 0.8765, "template", None, i) for i in range(50)] + [("c/d", 0, 1.0, 1, 0.5, "odd", 2, None), (None, 1, 1.0, 1, 0.5, "template", 2, None)]
    df = spark.createDataFrame(rows, READS).repartition(4)
    path = str(tmp_path / "out")
    signal_source.write_signals(df, path)
    got = signal_source.read_signals(spark, path).orderBy("stem", "i").collect()
    assert [(r.stem, r.t, r.k, r.conf, r.d, r.a) for r in got] == [(s, round(t, 3), k, round(c, 3), d, a) for s, _, t, k, c, _, d, a in rows[:-1]]
    assert {r.method for r in got} == {"template", "?"} and {r.version for r in got} == {2}
    with pytest.raises(Exception, match="holds documents"):
        signal_source.write_signals(df, path)
    signal_source.write_signals(df.where("stem = 'c/d'"), path, overwrite=True)
    assert [r.stem for r in signal_source.read_signals(spark, path).collect()] == ["c/d"]
    with pytest.raises(Exception, match="two tasks"):
        df.select("stem", "t", "k", "conf", "method", "d", "a").where("stem = 'a b'").repartition(3).write.format("signals").mode("append").save(str(tmp_path / "twice"))
    signal_source.write_signals(df.limit(0), str(tmp_path / "nothing"))
    assert signal_source.read_signals(spark, str(tmp_path / "nothing")).count() == 0


# --- replay -------------------------------------------------------------------


def _reads(rng, stems):
    return [(s, i, float(i), rng.randrange(4) + i // 20, 0.9, rng.choice(["row_miss", "template", "row_miss"]), None, None) for s in stems for i in range(60)]


def test_only_changed_recordings_are_computed_again(spark, tmp_path):
    rng = random.Random(2)
    rows = _reads(rng, ["a", "b", "c", "d"])
    df = lambda r: spark.createDataFrame(r, READS)
    seen = []

    def compute(reads):
        seen.append(sorted(r.stem for r in reads.select("stem").distinct().collect()))
        cut = spark.createDataFrame([(s, 0, 0.0, 30.0) for s in "abcde"] + [(s, 1, 30.0, 60.0) for s in "abcde"], "stem string, seg long, s double, e double")
        return settle.settled_rounds(reads, cut.join(reads.select("stem").distinct(), "stem", "left_semi"))

    folder = f"file://{tmp_path}/replay"
    plain = lambda d: sorted(str(r) for r in d.drop("run").collect())
    first = plain(replay.replayed(df(rows), compute, folder))
    assert first == plain(compute(df(rows)))
    assert plain(replay.replayed(df(rows).repartition(5), compute, folder)) == first and seen[2] == []
    changed = [(*r[:3], r[3] + 1, *r[4:]) if r[0] == "b" and r[1] == 30 else r for r in rows if r[0] != "d"] + _reads(rng, ["e"])
    made = replay.replayed(df(changed), compute, folder)
    assert seen[3] == ["b", "e"]
    assert plain(made) == plain(compute(df(changed)))
    assert {r.stem: r.run for r in made.collect()} == {"a": 1, "b": 3, "c": 1, "e": 3}
    # repeated rows count, nulls are not zeros
    twice = changed + [r for r in changed if r[0] == "c"][:1]
    replay.replayed(df(twice), compute, folder)
    assert seen[5] == ["c"]
    assert {r.run for r in replay.replayed(df(twice), compute, folder, again=True).collect()} == {5}


def test_a_failed_run_leaves_the_one_before(spark, tmp_path):
    rows = _reads(random.Random(3), ["a", "b"])
    df = spark.createDataFrame(rows, READS)
    folder = f"file://{tmp_path}/replay"
    compute = lambda reads: islands.status_runs(reads, "row_miss", 3)
    before = replay.replayed(df, compute, folder).collect()

    def broken(reads):
        return compute(reads).withColumn("n", F.raise_error(F.lit("lost")).cast("long"))

    with pytest.raises(Exception, match="lost"):
        replay.replayed(df.withColumn("conf", F.lit(0.1)), broken, folder).collect()
    assert sorted(replay.results(spark, folder, compute(df).schema).collect()) == sorted(before)
    assert {r.run for r in replay.replayed(df.withColumn("conf", F.lit(0.1)), compute, folder).collect()} == {2}
    with pytest.raises(FileNotFoundError):
        replay.results(spark, f"file://{tmp_path}/none", compute(df).schema)
