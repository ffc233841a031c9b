"""The corpus operators against brute force, round trips and held-out accuracy."""

import base64
import hashlib
import io
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from roundline.llm import bayes_language, block_topk, common, curve_packing, exact_digest, graph, ordinal_quality, perfect_hash, queries, sentencepiece_codec, simhash, substring_dedup, textops, token_shards, tokens, warc
from roundline.llm.common import scratch

P = pytest.importorskip("public_tokenizers")
WORD, PIECE = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "a  ", "\n", "▁", "a ▁b▁", "a　b\x1cc\x85d é ́x", "it's don't 're 'story", "<s>x</s>", "<|endoftext|>a", "a<|startoftext|>  b <|ENDOFTEXT|> c<|endoftext|>é <| |>", "İstanbul ΑΣ ß tzß", "x" * 3000, "🙂👩‍👩‍👧 è", "²½ª 12", "A" * 50_000 + " b"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(data):
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{data}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def word():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    return lambda x: t.encode(x, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls anywhere, empty and long texts, repeated rows, and extra columns with names that results use."""
    rows = [(1, "a b c", "en", 1), (1, "a b c", "en", 1), (2, None, None, 2), (3, "", "en", None), (None, "a b c", "fr", 3), (None, None, None, None), (4, "x " * 20_000, "en", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    for c in ("key", "tie", "ids", "fp", "start", "kept", "places", "label", "expected_grade"):
        df = df.withColumn(c, F.lit("clash"))
    return df


# --- helpers ---------------------------------------------------------------


def test_xxh64_equals_the_library():
    rng = random.Random(1)
    parts = [bytes(rng.randrange(256) for _ in range(n)) for n in [*range(130), 2047, 2048, 2049, 5000]]
    buf = np.frombuffer(b"".join(parts) + b"\0" * 16, np.uint8)
    end = np.cumsum([len(p) for p in parts])
    got = textops.xxh64(buf, end - np.array([len(p) for p in parts]), end, 42)
    assert [int(h) for h in got] == [xxhash.xxh64_intdigest(p, 42) for p in parts]


def test_words():
    w = textops.Words([b"a bb  ccc", b"", b" x\ty\n"])
    assert w.first.tolist() == [0, 3, 3, 5] and [w.text(i) for i in range(3)] == [b"a bb ccc", b"", b"x y"]
    assert w.text(0, np.array([True, False, True, True, True])) == b"a ccc"


@pytest.mark.parametrize("chunked", ["word", "piece"])
def test_chunk_tables_equal_the_libraries(docs, word, chunked):
    texts = ODD + [t for _, t in docs[:60]]
    sp = tokens.piece_processor(PIECE)
    table, encode = (tokens.word_table(WORD), word) if chunked == "word" else (tokens.piece_table(PIECE), sp.encode)
    for _ in range(2):  # new and known chunks
        assert [np.frombuffer(i, "<u4").tolist() for i in table.ids(texts)] == [encode(t) for t in texts]
    assert table.ids([None]) == [b""]
    small = tokens.ChunkTable(table._chunks, table._encode, capacity=3)
    assert small.ids(texts) == table.ids(texts) and len(small._known) <= 3


def test_chunks_without_and_with_several_pre_tokens(word):
    """As many pre-tokens as chunks, but not one a chunk."""
    tokens._TABLES.pop(("word", WORD), None)
    try:
        table = tokens.word_table(WORD)
        some = ["abc", "", "\u201chi", "x"]
        assert [list(i) for i in table._encode(some)] == [word(c) for c in some]
        texts = ["abc  \u201chi x", "ş  y", "\u201chi", "e\u0301  \u0301a \u201c\u201d", "İ  ΑΣ 🙂👩‍👩‍👧"]
        assert [np.frombuffer(i, "<u4").tolist() for i in table.ids(texts)] == [word(t) for t in texts]
    finally:
        tokens._TABLES.pop(("word", WORD), None)


def test_perfect_hash():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2**63, (2, 5000)).astype(np.uint64)
    p, columns = perfect_hash.load(b"".join(perfect_hash.dump(perfect_hash.PerfectHash.build(a, b), {"x": np.arange(5)})))
    assert sorted(p.slots(a, b)) == list(range(5000)) and columns["x"].tolist() == list(range(5))
    with pytest.raises(ValueError, match="distinct"):
        perfect_hash.PerfectHash.build(a[[0, 0]], b[[0, 0]])


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in edges:
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    got = {r.a: r.b for r in graph.components(spark.createDataFrame(edges, "a long, b long"), scratch(spark, "g")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


# --- 1 and 10: models ----------------------------------------------------------


def test_op1_grades(spark, data):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = ordinal_quality.graded(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = ordinal_quality.train(d, labels.where(~held))
    assert (np.diff(model.thresholds) > 0).all() and model.grades.tolist() == [0, 1, 2]
    rows = ordinal_quality.assess(d, model, 2).join(labels.where(held), "doc_id").collect()
    assert len(rows) > 50 and np.mean([r.accepted for r in rows if r.grade == 2]) > 0.95
    poor = [r for r in rows if r.grade < 2]
    assert np.mean([r.accepted for r in poor]) < 0.5 and all(0 <= r.tail <= 1 and 0 <= r.expected_grade <= 2 for r in rows)
    assert queries.queries()["op1_ordinal_quality"](spark, data).count() == 200


def test_op1_equals_brute_force(spark):
    """Features, scores and probabilities by plain Python; the thresholds are the best for their weights."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = ordinal_quality.graded(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    model = ordinal_quality.train(d, labels)
    w, space = model.weights, ordinal_quality.BUCKETS - 4 * 21

    def score(text):
        raw = (text or "").encode()
        words = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw))
        cells = {xxhash.xxh64_intdigest(x, 1) % space for x in words}
        marks = len(re.findall(rb"[^0-9A-Za-z\x80-\xff \t-\r]", raw))
        size, n = max(1, len(raw)), max(1, len(words))
        shape = (len(re.findall(rb"[A-Z]", raw)) / size, 2 * marks / size, len(cells) / n, size / n / 20)
        bands = [space + 21 * j + int(20 * min(1, x)) for j, x in enumerate(shape)]
        return sum(float(w[c]) for c in cells) / max(1, len(cells)) ** 0.5 + sum(float(w[b]) for b in bands)

    def probabilities(s, thresholds):
        below = [0.0, *(1 / (1 + np.exp(s - t)) for t in thresholds), 1.0]
        return np.diff(below)

    got = {r.doc_id: r for r in ordinal_quality.assess(d, model, 2).collect()}
    for r in list(got.values())[:80]:
        p = probabilities(score(r.text), model.thresholds)
        assert r.expected_grade == pytest.approx(p @ model.grades, abs=1e-4) and r.tail == pytest.approx(p[2], abs=1e-4)
        assert r.accepted == (r.tail >= 0.6)
    rated = [(score(got[r.doc_id].text), r.grade) for r in labels.where("grade is not null").collect()]
    fit = lambda thresholds: np.mean([np.log(max(1e-12, probabilities(s, thresholds)[g])) for s, g in rated])
    best = fit(model.thresholds)
    assert best > fit([-1.0, 1.0]) and all(fit(model.thresholds + np.array(move)) < best + 1e-3 for move in ([0.2, 0], [-0.2, 0], [0, 0.2], [0, -0.2]))


def test_op1_edges(spark, odd_docs):
    rated = spark.createDataFrame([(1, 0), (4, 2), (None, 1), (2, None), (1, 2)], "doc_id long, grade int")
    model = ordinal_quality.train(odd_docs, rated)
    got = ordinal_quality.assess(odd_docs, model, 2)
    assert got.count() == 7 and got.columns.count("expected_grade") == 1
    none = ordinal_quality.train(odd_docs, rated.limit(0))
    assert all(r.accepted and r.expected_grade is None for r in ordinal_quality.assess(odd_docs, none, 2).collect())
    assert ordinal_quality.assess(odd_docs.limit(0), model, 2).count() == 0
    same = ordinal_quality.train(odd_docs, rated.where("grade = 2"))
    assert all(r.expected_grade == 2 and r.tail == 1 for r in ordinal_quality.assess(odd_docs, same, 2).collect())


def test_op10_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "text")
    rows = queries.queries()["op10_language"](spark, d).join(truth, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_op10_edges(spark, odd_docs):
    model = bayes_language.train(odd_docs)
    got = bayes_language.identify(odd_docs, model)
    assert got.columns.count("score") == 1
    assert {r.text: r.lang_pred for r in got.collect() if not r.text} == {None: "und", "": "und"}
    assert all(r.lang_pred == "und" and r.score == 0 for r in bayes_language.identify(odd_docs, bayes_language.train(odd_docs.limit(0))).collect())
    long = "bonjour " * 400_000
    p, _, typical = model.posteriors([long, "bonjour " * 3])
    assert p.shape == typical.shape == (2, 2) and np.isfinite(p).all()
    with pytest.raises(ValueError, match="languages"):
        bayes_language.train(spark.range(300).selectExpr("id AS doc_id", "'a' AS text", "string(id) AS lang"))


def test_op10_letters_of_all_planes(spark, odd_docs):
    model = bayes_language.train(odd_docs)
    rows = [(1, "\U0001f642\U0001f469\u200d\U0001f467 12 !"), (2, "\U00010400\U00010401"), (3, "\U00020000"), (4, "\U0001f642 a"), (5, "\u0301 \u20ac")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in bayes_language.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1] == got[5] == ("und", 0.0) and all(got[i][0] in ("en", "fr") and got[i][1] > 0 for i in (2, 3, 4))


def test_op10_equals_brute_force(spark, data):
    """Counts, smoothing, priors and scores by plain dictionaries."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2

    def grams(text):
        s = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        for n in (2, 3):
            for i in range(len(s) - n + 1):
                h = n
                for c in s[i : i + n]:
                    h = (h * 0x85EBCA6B + ord(c)) % 2**32
                h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
                yield h >> 17

    counts, n = defaultdict(Counter), Counter()
    for r in docs:
        if r.lang and r.text is not None and not held(r.doc_id):
            counts[r.lang].update(grams(r.text))
            n[r.lang] += 1
    got = {r.doc_id: r for r in queries.queries()["op10_language"](spark, data).collect()}
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) + 0.5 * bayes_language.BUCKETS for x in langs}
    for r in docs[:60]:
        own = Counter(grams(r.text or ""))
        s = np.array([np.log(n[x] / n.total()) + sum(k * np.log((counts[x][c] + 0.5) / total[x]) for c, k in own.items()) for x in langs])
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        found = got[r.doc_id]
        assert found.held_out == held(r.doc_id)
        assert (found.lang_pred, found.score) == ("und", 0.0) if not any(c.isalpha() for c in r.text or "") else found.lang_pred == langs[int(p.argmax())] and abs(found.score - p.max()) < 1e-3


# --- 2, 5, 7: token ids ----------------------------------------------------------


def test_op2_round_trip(spark, data, docs, word):
    got = sorted(queries.queries()["op2_token_shards"](spark, data).collect())
    at = 0
    for (i, text), r in zip(docs, got, strict=True):
        ids = [*word(text), 2]
        assert tuple(r) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@pytest.mark.parametrize("width", [2, 4])
def test_op2_edges(spark, odd_docs, word, width):
    folder = scratch(spark, "shards")
    entries = token_shards.write_shards(odd_docs, folder, WORD, 2, width)
    parts = token_shards.index_parts(entries)
    assert token_shards.write_index(entries, folder, parts).agg(F.sum("n_keys")).first()[0] == 7
    keys = spark.createDataFrame([(None,), (1,), (2,), (4,), (99,)], "key long")
    got = defaultdict(list)
    for r in token_shards.read_back(token_shards.find(keys, folder, parts), folder, width, token_shards.shard_starts(entries)).collect():
        got[r.key].append(np.frombuffer(r.ids, "<u4").tolist())
    abc = [*word("a b c"), 2]
    assert set(got) == {None, 1, 2, 4} and got[1] == [abc, abc] and got[2] == [[2]] and len(got[4][0]) == 20_001 and sorted(got[None]) == sorted([abc, [2]])
    folder = scratch(spark, "shards")
    none = token_shards.write_shards(odd_docs.limit(0), folder, WORD, 2, width)
    assert none.count() == 0 and token_shards.find(keys, folder, token_shards.index_parts(none)).count() == 0
    assert token_shards.id_width(70_000) == 4


@pytest.mark.parametrize("block", [4, 65_536])
def test_op2_finds_all_documents_of_a_key(spark, monkeypatch, word, block):
    """Keys with many documents that lie in several shards, and the query over such a table."""
    monkeypatch.setattr(token_shards, "SHARD_BYTES", 64)
    monkeypatch.setattr(token_shards, "_BLOCK", block)
    rows = [(None, f"n {i % 17}") for i in range(40)] + [(7, "same text")] * 30 + [(8, f"x {i}") for i in range(3)] + [(9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(token_shards, "table", lambda *a: df)
    got = token_shards.op2_token_shards(spark, "").collect()
    ids = [[*word(t or ""), 2] for _, t in rows]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((k, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (k, _), i in zip(rows, ids, strict=True))
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [k for k, _ in rows]


def test_op5_lays_every_id_once(spark, data, docs, word):
    rows = queries.queries()["op5_curve_packing"](spark, data).collect()
    ids = {i: [*word(t), 1] for i, t in docs}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))

    def whole(parts):
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        return at

    assert {d: whole(p) for d, p in by_doc.items()} == {d: len(x) for d, x in ids.items()}
    sizes = [whole(p) for p in by_sequence.values()]
    assert max(sizes) == 2048 and all(n & (n - 1) == 0 for n in sizes)


def test_op5_curve_and_edges(spark, odd_docs):
    g = np.array(np.meshgrid(*[np.arange(8)] * 3, indexing="ij")).reshape(3, -1).T
    h = curve_packing.hilbert(g, 3)
    assert sorted(h) == list(range(512)) and (np.abs(np.diff(g[np.argsort(h)], axis=0)).sum(1) == 1).all()
    pieces = curve_packing.pack(odd_docs, WORD).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == {1: 2, 2: 1, 3: 1, None: 2, 4: 1}
    assert curve_packing.pack(odd_docs.limit(0), WORD).count() == 0


def test_op5_ranges(spark, monkeypatch):
    """Each row lies between the bounds around it; equal places are split by id and text."""
    rng = np.random.default_rng(2)
    rows, bounds = rng.integers(0, 4, (200, 3)), np.array(sorted(map(tuple, rng.integers(0, 4, (9, 3)))))
    got = curve_packing.ranges(bounds, rows)
    assert got.tolist() == [sum(tuple(b) <= tuple(r) for b in bounds) for r in rows]
    monkeypatch.setattr(curve_packing, "RANGE_BYTES", 200)
    df = spark.createDataFrame([(i, "the same words") for i in range(300)], "doc_id long, text string")
    spread = curve_packing.placed(df).groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) == 21 and max(r["count"] for r in spread) < 40
    pieces = curve_packing.pack(df, WORD, width=16).collect()
    assert sum(r.length for r in pieces) == 300 * 4 and Counter(r.doc_id for r in pieces if r.start == 0) == Counter(range(300))


def test_op7_equals_the_library(spark, data, docs):
    sp = tokens.piece_processor(PIECE)
    got = {r.doc_id: r for r in queries.queries()["op7_sentencepiece"](spark, data).collect()}
    for i, text in docs:
        ids = [*sp.encode(text), 2]
        r = got[i]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_op7_edges(spark, odd_docs):
    rows = sentencepiece_codec.encode_decode(odd_docs, PIECE).collect()
    assert len(rows) == 7 and all(r.n_tokens == 1 and r.decoded == "" for r in rows if r.doc_id in (2, 3))
    assert sentencepiece_codec.encode_decode(odd_docs.limit(0), PIECE).count() == 0


# --- 3: search -----------------------------------------------------------------


def test_op3_ties_and_unsound_vectors(spark, monkeypatch):
    monkeypatch.setattr(block_topk, "BLOCK_ROWS", 16)
    rows = [(i, [float(i % 3), -1.0 * (i % 2), 0.5]) for i in range(300)]
    rows += [(None, [1.0, 1.0, 1.0]), (400, None), (500, []), (501, []), (600, [1.0, None]), (601, [float("-inf")] * 3), (700, [float("nan")]), (800, [5.0]), (100, [2.0, 2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("g", F.lit("clash"))
    v = [(i, [int(np.floor(1024 * y)) for y in x] + [0] * (3 - len(x))) for i, x in rows if i is not None and x is not None and all(y is not None and np.isfinite(y) for y in x)]
    got = defaultdict(list)
    for r in block_topk.search(df, "vec_id % 100 = 0", 4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q, x in v:
        if q % 100 == 0 and q != 100:
            best = sorted(((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in v if i != q))[:4]
            assert got[q] == [(i, -s) for s, i in best]
    assert block_topk.search(df.limit(0), "vec_id % 100 = 0").count() == 0


@pytest.mark.parametrize("big", [2.0**22, 2.0**40, 1e300])
def test_op3_large_components(spark, big):
    """Finite components of any size take part; what no long holds is the nearest long."""
    rng = random.Random(7)
    rows = [(i, [rng.choice([-big, -1.5, 0.25, big, big / 2]) for _ in range(3)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    most = 2**63 - 1
    cut = lambda x: max(-most, min(most, x))
    v = [(i, [cut(int(np.floor(np.float64(1024) * y))) for y in x]) for i, x in rows]
    got = defaultdict(list)
    for r in block_topk.search(df, "vec_id % 20 = 0", 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q, x in v[::20]:
        best = sorted((-cut(sum(a * b for a, b in zip(x, y, strict=True))), i) for i, y in v if i != q)[:5]
        assert got[q] == [(i, -s) for s, i in best]


# --- 4: digests --------------------------------------------------------------------


def canon(t):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())).strip()


def op4(spark, monkeypatch, df):
    monkeypatch.setattr(exact_digest, "table", lambda *a: df)
    monkeypatch.setattr(exact_digest, "SLICE_ROWS", 3)
    return exact_digest.op4_exact_digest(spark, "").collect()


def test_op4_equals_brute_force(spark, monkeypatch, data):
    forms = ["Café x", "Café  X ", "STRASSE", "straße", "", "ﬁ a b", None, "fi A B"]
    for df in (spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text"), spark.createDataFrame([(i, forms[i % 8]) for i in range(50)], "doc_id long, text string")):
        rows = {r.doc_id: r for r in op4(spark, monkeypatch, df)}
        docs = sorted(((r.doc_id, r.text or "") for r in df.collect()), reverse=True)
        same = defaultdict(list)
        for n, (i, x) in enumerate(docs):
            y, k, r = docs[(n + 1) % len(docs)][1], len(x) // 3, rows[i]
            e = x[: len(x) - k] + y[:k]
            same[canon(x)].append(i)
            assert (r.n_chars, r.edited_sha256) == (len(x), hashlib.sha256(e.encode()).hexdigest())
            assert (r.near_edited, r.near_next) == (float(canon(e) == canon(x)), float(canon(x) == canon(y)))
        for ids in same.values():
            assert {rows[i].group_id for i in ids} == {min(ids)} and len({rows[i].fingerprint for i in ids}) == 1
        assert len({r.fingerprint for r in rows.values()}) == len(same)


def test_op4_tells_texts_of_one_digest_apart(spark, monkeypatch):
    """With digests of 3 bits most texts share a bucket: fingerprints are equal only for equal texts."""
    monkeypatch.setattr(exact_digest, "digest", lambda text: F.hex(F.pmod(F.xxhash64(text), F.lit(8))))
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    forms = ["a b", "A  b", "c d e", "", "x", "long text of words", "Long text of  words", "c d e"]
    df = spark.createDataFrame([(i, forms[i % 8] if i < 24 else f"t {i % 9} {forms[i % 5]}") for i in range(60)], "doc_id long, text string")
    rows = {r.doc_id: r for r in op4(spark, monkeypatch, df)}
    docs = sorted(((r.doc_id, r.text) for r in df.collect()), reverse=True)
    prints = defaultdict(set)
    for n, (i, x) in enumerate(docs):
        y, k, r = docs[(n + 1) % len(docs)][1], len(x) // 3, rows[i]
        e = x[: len(x) - k] + y[:k]
        prints[r.fingerprint].add(canon(x))
        prints[r.edited_fingerprint].add(canon(e))
        assert (r.near_edited, r.near_next) == (float(canon(e) == canon(x)), float(canon(x) == canon(y)))
    assert all(len(texts) == 1 for texts in prints.values()) and len(prints) == len(set().union(*prints.values()))


def test_op4_edges(spark, monkeypatch, odd_docs):
    rows = op4(spark, monkeypatch, odd_docs)
    assert Counter(r.doc_id for r in rows) == {1: 2, 2: 1, 3: 1, None: 2, 4: 1}
    assert op4(spark, monkeypatch, odd_docs.limit(0)) == []
    alone = op4(spark, monkeypatch, odd_docs.where("doc_id = 4"))
    assert [r.near_next for r in alone] == [1.0]


# --- 6: archives -------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, data, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    theirs = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in theirs.description]
    assert sorted(map(str, theirs.fetchall())) == sorted(str(tuple(r)) for r in queries.queries()[name](spark, data).select(*names).collect())


def test_op6_equals_brute_force(spark, data):
    got = {r.page_id: r for r in queries.queries()["op6_warc"](spark, data).collect()}
    first = {}
    for i, html in duckdb.sql(f"SELECT page_id, coalesce(html, '') FROM '{data}/pages.parquet' ORDER BY page_id").fetchall():
        x, r = html.encode(), got[i]
        f = first.setdefault(x, i)
        assert (r.payload_bytes, r.payload_digest) == (len(x), base64.b32encode(hashlib.sha1(x).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if f == i else ("revisit", f))


def test_op6_edges(spark):
    rows = [(1, "u\r\nv", "x"), (2, "u", "x"), (None, None, "x"), (3, "v", None), (4, "v", ""), (None, "q", None), (1, "u", "x"), (5, "w", "é" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("first", F.lit(1))
    got = warc.read_archives(warc.write_archives(df, scratch(spark, "w"))).where("not gap")
    kinds = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got.collect())
    assert kinds == {(1, "response", None, 1): 2, (2, "revisit", 1, 1): 1, (None, "revisit", 1, 1): 1, (3, "response", None, 0): 1, (4, "revisit", 3, 0): 1, (None, "revisit", 3, 0): 1, (5, "response", None, 600_000): 1}
    all_ = warc.read_archives(warc.write_archives(df, scratch(spark, "w"), min_revisit=2))
    assert all_.where("record_type = 'revisit'").count() == 0
    assert warc.read_archives(warc.write_archives(df.limit(0), scratch(spark, "w"))).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    made = []
    for i in range(30):
        body = bytes(random.Random(i).randrange(256) for _ in range(500 + i))
        r = warc.record(i, f"u{i}", body, base64.b32encode(hashlib.sha1(body).digest()).decode(), None)
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        made.append(c.compress(r) + c.flush() if packed else r)
    whole = b"".join(made)
    assert [warc._page(h["warc-record-id"]) for _, _, _, h, _ in warc.records(io.BytesIO(whole), len(whole))] == list(range(30))
    bad = bytearray(whole)
    at = sum(map(len, made[:7])) + len(made[7]) // 2
    bad[at : at + 30] = bytes(30)
    cut = bytes(bad[: sum(map(len, made[:20])) + 100]) + b"".join(made[21:]) + b"junk"
    got = list(warc.records(io.BytesIO(cut), len(cut)))
    assert [warc._page(g[3]["warc-record-id"]) for g in got if g[2] is None] == [i for i in range(30) if i not in (7, 20)]
    assert len([g for g in got if g[2]]) == 3 and sum(g[1] for g in got) == len(cut)


def archive_pages(spark, n=3000):
    """Pages whose payloads do not shrink: several MiB of archive in few files."""
    rows = [(i, f"http://a/{i}", base64.b64encode(random.Random(i // 2 if i % 10 < 2 else i).randbytes(2400)).decode()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)


def test_op6_reads_large_archives_whole(spark, monkeypatch):
    rows, pages = archive_pages(spark)
    archives = warc.write_archives(pages, scratch(spark, "w"))
    sizes = [r["bytes"] for r in archives.collect()]
    assert sum(sizes) > 5 << 20 and max(sizes) > 2 * warc.CHUNK
    got = warc.read_archives(archives).collect()
    assert not any(r.gap for r in got) and sorted(r.page_id for r in got) == list(range(len(rows)))
    assert all(bytes(r.payload).decode() == rows[r.page_id][2] for r in got if r.record_type == "response")
    monkeypatch.setattr(warc, "table", lambda *a: pages)
    assert warc.op6_warc(spark, "").count() == len(rows)
    small = warc.write_archives(pages, scratch(spark, "w"), archive_bytes=1 << 20)
    assert small.count() > archives.count() and warc.read_archives(small).where("not gap").count() == len(rows)


def test_op6_salvages_damaged_archives(spark, monkeypatch):
    _, pages = archive_pages(spark)
    folder = scratch(spark, "w")
    archives = warc.write_archives(pages, folder)
    whole = warc.read_archives(archives).collect()
    path = max(archives.collect(), key=lambda r: r["bytes"]).path
    own = sorted((r.at, r["size"], r.page_id) for r in whole if r.path == path)
    hurt = own[len(own) // 2]
    with open(path.removeprefix("file://"), "r+b") as f:
        f.seek(hurt[0] + hurt[1] // 2)
        f.write(bytes(40))
    got = warc.read_archives(archives).collect()
    assert {r.page_id for r in whole} - {r.page_id for r in got if not r.gap} == {hurt[2]}
    assert [(r.path, r.at, r["size"]) for r in got if r.gap] == [(path, *hurt[:2])]
    monkeypatch.setattr(warc, "write_archives", lambda *a: archives)
    monkeypatch.setattr(warc, "table", lambda *a: pages)
    with pytest.raises(RuntimeError, match="1 gaps"):
        warc.op6_warc(spark, "")


def test_op6_frequent_payloads(spark, monkeypatch):
    """Digests over the bound are joined by broadcast, with the same result."""
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    rows = [(i, f"u{i}", "" if i % 3 == 0 else f"p{i % 7}") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    first = {}
    for i, _, x in rows:
        first.setdefault(x, i)
    got = {r.page_id: r.refers_to for r in warc.read_archives(warc.write_archives(df, scratch(spark, "w"))).collect()}
    assert got == {i: None if first[x] == i else first[x] for i, _, x in rows}


def test_scratch_refuses_a_cluster_without_a_shared_folder():
    class Session:
        conf = {"spark.master": "spark://host:7077"}

    with pytest.raises(ValueError, match="checkpoint"):
        scratch(Session, "x")


# --- 8 and 9: duplicates -------------------------------------------------------------


def fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(ids, prints):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(prints, dtype=np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 3) + i + 1:
            x, y = find(i), find(int(j))
            parent[max(x, y)] = min(x, y)
    return [ids[find(i)] for i in range(len(ids))]


def test_op8_equals_brute_force(spark, data, docs):
    got = {r.doc_id: r for r in queries.queries()["op8_simhash"](spark, data).collect()}
    prints = [fingerprint(t) for _, t in docs]
    expected = linked([i for i, _ in docs], prints)
    assert [(got[i].fingerprint, got[i].component_id) for i, _ in docs] == [(f"{p:016x}", c) for p, c in zip(prints, expected, strict=True)]


@pytest.mark.parametrize("block_rows", [4, 16, 2048])
def test_op8_loses_no_link(spark, block_rows):
    rng = np.random.default_rng(1)
    prints = set()
    for base in rng.integers(0, 2**63, 12, dtype=np.uint64):
        x = int(base)
        for _ in range(40):
            y = x
            for k in rng.integers(0, 64, rng.integers(0, 5)):
                y ^= 1 << int(k)
            prints.add(y)
            x = y if rng.random() < 0.3 else x
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), scratch(spark, "l"), 3, block_rows)
    stars = {r.a: r.b for r in graph.components(edges, scratch(spark, "g")).collect()}
    assert [stars.get(p, p) for p in signed] == linked(signed, [p % (1 << 64) for p in signed])


def test_op8_pivot_tables():
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 2**63, 200, dtype=np.uint64)
    pivots, masks = simhash.references(simhash.PIVOTS), simhash.segments(5)
    parts = simhash.pivot_table(fp, pivots, masks)
    assert sum(masks) == 2**64 - 1
    assert (parts.sum(axis=1) == [[bin(int(x) ^ int(p)).count("1") for p in pivots] for x in fp]).all()
    near = fp ^ np.uint64(0b111)  # three bits of the first segment: all coordinates of the others are the same
    other = simhash.pivot_table(near, pivots, masks)
    assert (other[:, 1:] == parts[:, 1:]).all() and np.abs(other.sum(axis=1).astype(int) - parts.sum(axis=1)).max() <= 3


def test_op8_frequent_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = [(i, "a b c d" if i % 2 else f"w{i} x{i} y{i} z{i}") for i in range(40)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ids, prints = [i for i, _ in rows], [fingerprint(t) for _, t in rows]
    assert [got[i] for i in ids] == linked(ids, prints)


def test_op8_edges(spark, odd_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == 7
    assert {r.doc_id: r.component_id for r in rows if r.doc_id} == {1: 1, 2: 2, 3: 2, 4: 4}
    assert sorted(r.component_id for r in rows if r.doc_id is None) == [1, 2]
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0


def grams(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(rows):
    """Smallest id of each text's component: links are Jaccard similarities of 0.8 or more."""
    ids, sets = [i for i, _ in rows], [grams(t) for _, t in rows]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


@pytest.mark.parametrize("frequent", [0, 100_000])
def test_near_copies_planted_at_08_to_095(spark, monkeypatch, frequent):
    from roundline.llm import shingle_join

    monkeypatch.setattr(shingle_join, "FREQUENT", frequent or 1)
    rng = random.Random(5)
    rows, passage = [], [f"p{i}" for i in range(40)]
    for base in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 120, 300]))] + passage * (base % 3 == 0)
        for copy in range(7):
            w = list(words)
            for _ in range(rng.randrange(1 + len(w) // 45) if copy else 0):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(w)))
    near = [9 * (o := len(a & b)) / 4 / (len(a) + len(b)) >= 1 and o < 0.97 * len(a | b) for i in range(0, len(rows), 7) for a, b in [(grams(rows[i][1]), grams(rows[i + 1][1]))]]
    assert sum(near) > 5
    got = {r.doc_id: r.component_id for r in shingle_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == alike(rows)


@pytest.mark.parametrize(("few", "small", "chunk"), [(0, 2, 5), (1000, 2, 65_536), (1000, 32, 65_536)])
def test_near_copies_turns(spark, monkeypatch, few, small, chunk):
    """Chains of copies, in which one leader does not reach all, and texts of few words."""
    from roundline.llm import shingle_join

    monkeypatch.setattr(shingle_join, "FEW", few)
    monkeypatch.setattr(shingle_join, "SMALL", small)
    monkeypatch.setattr(shingle_join, "CHUNK", chunk)
    rows = [(i, " ".join(f"c{k}" for k in range(3 * i, 3 * i + 60))) for i in range(30)]
    rows += [(100 + i, " ".join([*(f"c{k}" for k in range(80)), f"y{i}"])) for i in range(20)]
    rows += [(200, "a b"), (201, "A  b"), (202, "a b c"), (203, ""), (204, None)]
    got = {r.doc_id: r.component_id for r in shingle_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == alike(rows)


@pytest.mark.parametrize("members", [6, 30])
def test_near_copies_hand_on_no_more_rows_than_heads(spark, members):
    """Classes that meet under many heads: rows in proportion to the heads, each pair once."""
    from roundline.llm import shingle_join

    rows = [(t, 1000 * (t // 5) + c, 100, t % 5) for t in range(200) for c in range(members)]
    rows += [(10_000 + t, c, 100, 5 + t) for t in range(2) for c in (70_000, 70_001)]  # fewer than SHARED heads in common
    rows += [(20_000 + t, c, n, 0) for t in range(5) for c, n in ((80_000, 100), (80_001, 200))]  # of no like sizes
    heads = spark.createDataFrame(rows, "token long, cls long, n int, pos int")
    met = shingle_join._met(heads)
    assert met.count() <= len(rows)
    got = sorted(tuple(r) for r in shingle_join._close_pairs(met).collect())
    assert got == [(1000 * g + a, 1000 * g + b) for g in range(40) for a in range(members) for b in range(a + 1, members)]


@pytest.mark.parametrize("small", [2, 3, 32])
def test_near_copies_at_the_least_similarity(spark, monkeypatch, small):
    """Sets of 4 to 14 shingles, many of just 0.8; a pair's heads lie in small and in large groups."""
    from roundline.llm import shingle_join

    monkeypatch.setattr(shingle_join, "SMALL", small)
    rng, rows = random.Random(11), []
    for base in range(40):
        words = [f"b{base}w{i}" for i in range(rng.randrange(8, 19))]
        cuts = [words, words[1:], words[:-1], words[2:], words[:-2], [*words, "z"], ["z", *words[1:]]]
        rows += [(len(rows) + i, " ".join(w)) for i, w in enumerate(cuts)]
    assert sum(9 * len(a & b) == 4 * (len(a) + len(b)) for i in range(0, len(rows), 7) for a in [grams(rows[i][1])] for j in range(i + 1, i + 7) for b in [grams(rows[j][1])]) > 5
    got = {r.doc_id: r.component_id for r in shingle_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == alike(rows)


def test_one_of_each_keeps_one_row(spark):
    """Repeated ids, rows without id and rows that share all columns: one row of each group stays."""
    from roundline.llm import shingle_join

    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, a, "x"), (1, a, "x"), (1, b, "y"), (None, a + " z", "z"), (None, "lone text of its own", "q"), (None, "lone text of its own", "q"), (2, b, "k"), (3, None, None), (4, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tie string").withColumn("component", F.lit(1))
    got = shingle_join.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(map(str, got.drop("component").collect())) == sorted(map(str, spark.createDataFrame([(1, a, "x"), (1, b, "y"), (None, "lone text of its own", "q"), (3, None, None)], "doc_id long, text string, tie string").collect()))
    assert shingle_join.one_of_each(df.limit(0)).count() == 0


def test_pipeline_removes_near_copies_beyond_three_bits(spark):
    """Of the given table's pairs at 0.8 or more, twelve differ in more than three bits."""
    import corpus_pipeline as pipeline
    from roundline.llm.common import table

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    left = {r.doc_id for r in pipeline.near_duplicates(spark, docs, "").collect()}
    assert left == {i for i, c in alike([(r.doc_id, r.text) for r in docs.collect()]).items() if i == c}
    assert not left & {56, 255, 770, 875, 944}  # kept by the three-bit rule


def repeated(docs, length):
    count, words = Counter(), []
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        words.append((i, w))
        count.update(tuple(w[k : k + length]) for k in range(len(w) - length + 1))
    out = {}
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if count[tuple(w[k : k + length])] > 1:
                gone[k : k + length] = [True] * length
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


def test_op9_equals_brute_force(spark, data, docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.queries()["op9_substring"](spark, data).collect()}
    assert got == repeated(docs, 35)


@pytest.mark.parametrize("lengths", [[3], [3, 5], [2, 4, 7]])
def test_op9_levels(spark, monkeypatch, lengths):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 30)))) for i in range(40)] + [(100, None), (101, "")]
    monkeypatch.setattr(substring_dedup, "levels", lambda window: lengths)
    monkeypatch.setattr(substring_dedup, "FLUSH_ROWS", 50)
    got = substring_dedup.cleaned(spark.createDataFrame(docs, "doc_id long, text string"), lengths[-1]).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got} == repeated(docs, lengths[-1])


def test_op9_edges(spark, odd_docs):
    assert substring_dedup.levels(35) == [18, 35] and substring_dedup.levels(100) == [13, 25, 50, 100]
    rows = substring_dedup.cleaned(odd_docs, 3).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed) for r in rows) == {(1, 3, 3): 2, (2, 0, 0): 1, (3, 0, 0): 1, (None, 3, 3): 1, (None, 0, 0): 1, (4, 20_000, 20_000): 1}
    assert substring_dedup.cleaned(odd_docs.limit(0), 3).count() == 0


# --- pipeline -------------------------------------------------------------------------


def test_pipeline(spark, word):
    import corpus_pipeline as pipeline
    from roundline.llm.common import table, written

    d, folder = "/root/testdata/sf0.01", scratch(spark, "pipeline")
    docs = table(spark, d, "documents")
    columns = docs.columns
    kept = []
    for i, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        docs = written(stage(spark, docs, d), f"{folder}/{i}")
        assert docs.columns == columns
        kept.append({r.doc_id: r.text for r in docs.collect()})
    good, spoken, unique, cut = kept
    toxic = {r.doc_id for r in table(spark, d, "labels").where("toxic = 1").collect()}
    assert len(toxic & set(good)) < 0.1 * len(toxic) and len(spoken) > 0.98 * len(good)
    assert set(unique) == {i for i, c in alike(sorted(spoken.items())).items() if i == c}
    brute = repeated(sorted(unique.items()), 35)
    assert set(cut) == {i for i, (n, gone, _) in brute.items() if n == 0 or gone < n}
    for i, text in cut.items():
        n, gone, digest = brute[i]
        assert (hashlib.sha256(text.encode()).hexdigest() == digest) if gone else text == unique[i]
    pieces = pipeline.packing(spark, docs, d).collect()
    assert sum(r.length for r in pieces) == sum(len(word(t)) + 1 for t in cut.values())


def test_pipeline_edges(spark, data):
    import corpus_pipeline as pipeline

    rows = [(1, None, "en", None, None), (None, "the and of " * 30, "en", "s", 330), (2, "", None, "s", 0), (2, "the and of " * 30, "en", "s", 330)]
    df = spark.createDataFrame(rows, DOCS)
    for part in (df, df.limit(0)):
        for _, stage in pipeline.STAGES:
            assert stage(spark, part, data).count() >= 0
