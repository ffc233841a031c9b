"""Phrases, conversation repair and licence scans against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from roundline.llm import collocations, conversation_repair, license_scan, queries, textops
from roundline.llm.common import scratch

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


# --- phrases -----------------------------------------------------------------


def _phrases(rows, least):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, " ".join(w[i : i + m])) for m in range(1, 6) for i in range(len(w) - m + 1))
    return n, {k: v for k, v in f.items() if v >= least}


def _collocations(rows, least, most):
    n, f = _phrases(rows, least)
    out = defaultdict(list)
    for (lang, phrase), a in f.items():
        w = phrase.split(" ")
        if len(w) < 2:
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        if any(x == lang and len(p) > len(phrase) and f" {phrase} " in f" {p} " and b >= a for (x, p), b in f.items()):
            continue
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, phrase.encode(), (phrase, a, left, right, n[lang], score)))
    return sorted((lang, i + 1, *x[3]) for lang, found in out.items() for i, x in enumerate(sorted(found)[:most]))


def _found(spark, df, least=3, most=5):
    phrases, totals = collocations.frequent_phrases(df, scratch(spark, "phrases"), least)
    got = collocations.collocations(phrases, totals, most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(map(tuple, got.collect()))


PHRASE_ROWS = [("en", "The end of the day. The end of the day; the END of\tthe  day!"), (None, "a b a b a b a b"), ("und", "a b, a b"), ("en", None), ("en", ""), ("fr", ".,;"), ("en", "of the, of the: of the é é é é"), ("en", "x" * 5000 + " y z " + "x" * 5000 + " y z"), ("en", "The end of the day. The end of the day; the END of\tthe  day!"), ("de", "w " * 3000)]


def test_phrases_equal_brute_force(spark):
    rng = random.Random(5)
    rows = PHRASE_ROWS + [(rng.choice(["en", "fr", None]), " ".join(rng.choice("ab c. d, e\nf é".split(" ")) for _ in range(rng.randrange(80)))) for _ in range(120)]
    df = spark.createDataFrame([(i if i % 7 else None, x, t) for i, (x, t) in enumerate(rows)], "doc_id long, lang string, text string").withColumns({"n": F.lit("clash"), "key": F.lit(1), "phrase": F.lit(2)})
    for least, most in ((3, 5), (10, 2000)):
        expected = _collocations(rows, least, most)
        assert expected and _found(spark, df.repartition(3), least, most) == expected


def test_phrases_whose_fingerprints_all_collide(spark, monkeypatch):
    """Every run has the same fingerprint: counts are of texts all the same."""
    monkeypatch.setattr(collocations.Runs, "fingerprints", lambda self, size, at, salts: np.full(len(at), 7, dtype=np.uint64))
    words = collocations.Runs([b"a b a b c", b"a b"])
    keys = words.fingerprints(2, np.array([0, 1, 2, 3, 5]), None)
    got = {(words.buf[words.start[i] : words.end[i + 1]].tobytes(), n) for _, i, n in collocations._texts(words, 2, keys, np.array([0, 1, 2, 3, 5]))}
    assert got == {(b"a b", 3), (b"b a", 1), (b"b c", 1)}


def test_phrases_of_a_table_without_rows_and_pointers(spark):
    df = spark.createDataFrame([(4, "en", "a b c"), (2, "en", "z a b"), (None, "en", "a b"), (9, "en", "q")], "doc_id long, lang string, text string")
    assert _found(spark, df.limit(0)) == []
    phrases, _ = collocations.frequent_phrases(df, scratch(spark, "phrases"), 3)
    assert {r.phrase: (r.n, r.doc_id, r.word) for r in phrases.collect()} == {"a": (3, 2, 1), "b": (3, 2, 2), "a b": (3, 2, 1)}
    with pytest.raises(ValueError, match="two words"):
        collocations.frequent_phrases(df, scratch(spark, "phrases"), 3, longest=1)


def test_phrase_scores_beyond_64_bits(spark):
    big = 10**12
    rows = [("en", "a", 1, big, 1, 0), ("en", "b", 1, big, 1, 0), ("en", "a b", 2, big - 1, 1, 0)]
    phrases = spark.createDataFrame(rows, "lang string, phrase string, words int, n long, doc_id long, word long")
    totals = spark.createDataFrame([("en", 10**15)], "lang string, n long")
    assert [r.score for r in collocations.collocations(phrases, totals).collect()] == [1000 * (big - 1) * 10**15 // big**2]


def test_bytes_that_differ():
    buf = np.frombuffer(b"abcdefghij abcdefghij abcdefghiX" + b"\0" * 64, np.uint8)
    assert textops.differs(buf, np.array([0, 0, 0, 0]), np.array([11, 22, 22, 5]), np.array([10, 10, 9, 0])).tolist() == [False, True, False, False]


# --- conversations -----------------------------------------------------------


def _repair(rows):
    """Cheapest, then least audit of rows (role, text, seen before), by whole strings."""
    blank = " \t\n\x0b\x0c\r"
    live = {0: (0, "", ())}

    def offer(to, state, cost, audit, lines):
        if state not in to or (cost, audit) < to[state][:2]:
            to[state] = (cost, audit, lines)

    def inserts(to):
        for _ in range(3):
            for state, (c, a, t) in list(to.items()):
                after = 3 if state == 2 else 2
                offer(to, after, c + 5, a + "I", (*t, ("assistant" if after == 3 else "user") + ":"))

    inserts(live)
    for role, text, again in rows:
        bare = text.rstrip(blank)
        must = not bare or again
        extra = 5 if not must and bare[-1] not in ".!?" else 0
        to = {}
        for state, (c, a, t) in live.items():
            offer(to, state, c + 2, a + "D", t)
            if must:
                continue
            after = 3 if state == 2 else 2
            own = {"s": 1, "u": 2, "a": 3}.get(role[:1])
            if own == after or (own == 1 and state == 0):
                offer(to, own, c + extra, a + "K", (*t, f"{role}:{text}"))
            offer(to, after, c + 1 + extra, a + "R", (*t, f"{'assistant' if after == 3 else 'user'}:{text}"))
        live = to
        inserts(live)
    return min(live[s] for s in (0, 3) if s in live)


def _conversation(rows, **kw):
    c, seen = conversation_repair.Conversation(**kw), set()
    marked = []
    for i, (role, text) in enumerate(rows):
        marked.append((role, text, (role, text) in seen))
        seen.add((role, text))
        c.add(i, *marked[-1])
    return c.finished(), _repair(marked)


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 1, 5])
def test_repairs_equal_brute_force(modulus):
    """With a modulus of 1 all hashes collide, with 5 many do."""
    rng = random.Random(modulus)
    roles, texts = ["system", "user", "assistant", "tool", " ", "u", ""], ["Yes.", "No!", "cut", "  ", "", "Why?\n", "a.\x0b", "é", "other.", "more."]
    for n in [*range(8), *[rng.randrange(1, 40) for _ in range(200)]]:
        rows = [(rng.choice(roles), rng.choice(texts) + rng.choice(["", str(rng.randrange(99)) + "."])) for _ in range(n)]
        got, (cost, audit, lines) = _conversation(rows, tree=conversation_repair.EditTree(modulus))
        assert (got[5], got[6]) == (cost, audit)
        assert got[7] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_edit_order_equals_order_of_strings():
    rng = random.Random(2)
    for modulus in ((1 << 61) - 1, 3):
        tree = conversation_repair.EditTree(modulus)
        for _ in range(400):
            tree.extended(rng.randrange(len(tree)), rng.choice("DIKR"))
        for a, b in itertools.islice(itertools.product(rng.sample(range(401), 60), repeat=2), 3600):
            assert tree.before(a, b) == (tree.text(a) < tree.text(b)) and tree.prefix(a, 0) == 0


def test_long_conversations_are_written_as_they_are_decided(monkeypatch):
    monkeypatch.setattr(conversation_repair, "_NODES", 50)
    rng = random.Random(3)
    for roles, texts in ((["user", "assistant"], ["ok."]), (["user", "assistant", "system"], ["cut", "x."]), (["tool"], ["cut"])):
        rows = [(rng.choice(roles), f"{rng.choice(texts)[:-1]}{i}{rng.choice(['.', ''])}") for i in range(1500)]
        got, (cost, audit, lines) = _conversation(rows)
        assert (got[5], got[6], got[7]) == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    c = conversation_repair.Conversation()
    for i in range(20_000):
        c.add(i, ("user", "assistant")[i % 2], f"well {i}.", False)
        assert len(c.tree) < 5000 and len(c._pending) < 600
    assert c.finished()[6] == "K" * 20_000


def test_repair_of_odd_tables(spark):
    rows = [(1, None, "user", "a.", "x"), (1, 3, None, None, "x"), (1, 7, "assistant", "b.", "x"), (None, 0, "user", "n.", "x"), (None, 0, "user", "n.", "x"), (2, 0, "system", "s.", "x"), (3, 1, "user", "q", "x"), (3, 1, "assistant", "p.", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, gone2 string").withColumns({"again": F.lit(1), "audit": F.lit("clash"), "code": F.lit(2)})
    marked = df.withColumn("gone", F.col("conv_id").eqNullSafe(2))
    got = {r.conv_id: r for r in conversation_repair.repaired(marked).collect()}
    assert (got[1].gaps, got[1].blank, got[1].duplicate, got[1].audit, got[1].cost) == (3, 1, 0, "KDK", 2)
    assert (got[None].duplicate, got[None].gaps, got[None].audit) == (1, 0, "DD")
    assert tuple(got[2])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert (got[3].illegal, got[3].truncated, got[3].audit) == (0, 1, "DD")  # by role: assistant first
    assert conversation_repair.repaired(marked.limit(0)).collect() == []
    assert {r.conv_id for r in conversation_repair.repaired(conversation_repair.damaged(df)).collect()} == {1, 2, 3, None}


def test_damage(spark):
    rows = [(c, t, "assistant", "a. b! c?") for c in range(40) for t in range(5)]
    got = Counter(map(tuple, conversation_repair.damaged(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()))
    expected = Counter()
    for c, t, role, text in rows:
        k = zlib.crc32(f"{c}:{t}".encode()) % 20
        expected[c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text, k == 0] += 2 if k == 3 else 1
    assert got == expected


# --- licences ----------------------------------------------------------------


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def _base(text):
    w, places, labels = _words(text), [], set()
    for t in license_scan.BASE:
        q = t.text.split()
        at = [i for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q]
        places += at
        labels |= {t.label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licences_equal_brute_force(spark, data):
    for r in queries.queries()["op13_licenses"](spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == _base(r.text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


LICENCE_TEXTS = {
    0: ("CC-BY... cc by cc  by é", "cc-by"),
    1: ("Permission is hereby granted, free of charge, to any person ... to deal in the Software without restriction", "mit"),
    2: ("to deal in the software without restriction", ""),
    3: ("permission is hereby granted free of charge " + "filler " * 60 + "to deal in the software without restriction", ""),
    4: ("under the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.", "gpl,gpl-3.0-or-later"),
    5: (None, ""),
    6: ("", ""),
    7: ("x " * 50_000 + "All Rights\tReserved. " + "y " * 5 + "Licensed under the Apache License, Version 2.0 (the License)", "apache-2.0,reserved"),
    8: ("general public licenses; all right reserved; xcc by; the license is a version of the software", ""),
    9: ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
}


def test_notices(spark):
    rows = [(i, t) for i, (t, _) in LICENCE_TEXTS.items()] + [(None, "all rights reserved"), (1, LICENCE_TEXTS[1][0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("clash"), "spans": F.lit(1), "n_words": F.lit(2)})
    made = license_scan.index(df)
    found = license_scan.scan(df, made).collect()
    assert len(found) == len(rows)
    for r in found:
        text, labels = ("all rights reserved", "reserved") if r.doc_id is None else LICENCE_TEXTS[r.doc_id]
        assert ",".join(sorted({s.label for s in r.spans})) == labels, r.doc_id
        w = _words(text)
        for s in r.spans:
            assert 0 <= s.start < s.end <= len(w) and 0 < s.share <= 1
    assert license_scan.scan(df.limit(0), license_scan.index(df.limit(0))).collect() == []


def test_rarity_counts_all_rows(spark):
    df = spark.createDataFrame([("the mit license the",), ("the cat",), (None,)], "text string").repartition(2)
    got = license_scan.rarities(df, ["license", "mit", "the"])
    assert got.tolist() == pytest.approx([math.log(4 / 2) + 1, math.log(4 / 2) + 1, math.log(4 / 3) + 1])


# --- SQL ---------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_collocations", "op12_repair"])
def test_new_queries_equal_sql(spark, data, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in got.description]
    df = queries.queries()[name](spark, data)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, df.select(names).collect()))) == sorted(map(repr, got.fetchall()))
