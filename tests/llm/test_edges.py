"""Bounds of memory and repeated ids in the trained operators."""

import numpy as np
from roundline.llm import bayes_language, ordinal_quality


def test_fit_takes_one_text_of_each_rated_id(spark):
    """Repeats of an id neither push other rated rows out nor count twice."""
    texts = {i: f"good words here number {i} and more" if i % 2 else f"$$ bad {i} %% ## stuff" for i in range(60)}
    rows = [(i, t) for i, t in texts.items()] + [(0, texts[0])] * 500
    ratings = spark.createDataFrame([(i, i % 2 + 1) for i in texts], "doc_id long, grade int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    fit = ordinal_quality.fit
    try:
        ordinal_quality.fit = lambda first, index, value, grade, buckets: (seen.append(sorted(grade.tolist())), fit(first, index, value, grade, buckets))[1]
        once = ordinal_quality.train(docs.dropDuplicates(), ratings, max_rows=40)
        again = ordinal_quality.train(docs.repartition(5), ratings, max_rows=40)
    finally:
        ordinal_quality.fit = fit
    assert len(seen[0]) == 40 and seen[0] == seen[1]
    assert np.array_equal(once.weights, again.weights) and np.array_equal(once.thresholds, again.thresholds)


def test_language_blocks_shrink_with_the_languages(monkeypatch):
    rng = np.random.default_rng(1)
    matrix = np.log(rng.random((bayes_language.BUCKETS + 1, 200))).astype(np.float32)
    model = bayes_language.LanguageModel([f"l{i:03d}" for i in range(200)], matrix)
    texts = ["abc def " * 400, "", "x", None, "é🙂 ü" * 90]
    whole = model.posteriors(texts)
    taken = []
    reduceat = np.add.reduceat

    class Spy:
        def __getattr__(self, name):
            return (lambda x, *a, **k: (taken.append(len(x) if x.ndim == 2 else 0), reduceat(x, *a, **k))[1]) if name == "reduceat" else getattr(np.add, name)

    class Numpy:
        add = Spy()

        def __getattr__(self, name):
            return getattr(np, name)

    monkeypatch.setattr(bayes_language, "_BLOCK_CELLS", 200 * 100)
    monkeypatch.setattr(bayes_language, "np", Numpy())
    small = model.posteriors(texts)
    assert max(taken) == 100 and len(taken) > 20
    assert np.allclose(whole[0], small[0], atol=1e-9) and (whole[1] == small[1]).all()


def test_language_pieces_count_each_ngram_once(spark, monkeypatch):
    """Texts longer than a piece: counts and scores are those of the whole text."""
    block = bayes_language._BLOCK_CHARS
    texts = [("abcdefg hij"[:k] * block)[: block + n] for n, k in zip((-3, -2, -1, 0, 1, block), (11, 10, 9, 7, 5, 3), strict=True)]
    langs = [f"l{i}" for i in range(len(texts))]
    model = bayes_language.train(spark.createDataFrame(list(zip(texts, langs, strict=True)), "text string, lang string"))
    assert model.languages == langs
    for i, text in enumerate(texts):
        chars = np.frombuffer(f" {text} ".encode("utf-32-le"), dtype="<u4")
        n = sum(np.bincount(bayes_language._hashed(chars, order), minlength=bayes_language.BUCKETS) for order in bayes_language.ORDERS) + 0.5
        assert np.abs(model.matrix[:-1, i] - np.log(n / n.sum()).astype(np.float32)).max() == 0
    few = ["abc defg hij" * 9, "a", "", "hijhij" * 40, "x" * 49, "x" * 48, "x" * 47, None]
    whole = model.posteriors(few)
    monkeypatch.setattr(bayes_language, "_BLOCK_CHARS", 50)
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(whole, model.posteriors(few), strict=True))


def test_chunk_table_over_many_tasks(spark, monkeypatch):
    """Words that several tasks have are in the table, once each; results are the library's."""
    import numpy as np
    import public_tokenizers
    from roundline.llm import sentencepiece_codec as codec
    from roundline.llm import tokens

    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = tokens.piece_processor(model)
    texts = [f"the shared words  of{' ' * (i % 3)} all own{i} é▁x {'y' * 70}" for i in range(40)] + ["", None, " ", "\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    table = codec.chunk_table(df, model)
    chunks = table.column(0).to_pylist()
    assert {"the", "shared", "words"} <= set(chunks) and not [c for c in chunks if c.startswith("own") or len(c) > tokens.LONG_CHUNK]
    assert len(set(chunks)) == len(chunks) and all(np.frombuffer(i, "<u4").tolist() == (sp.encode(c) if c else [sp.piece_to_id("▁")]) for c, i in zip(chunks, table.column(1).to_pylist(), strict=True))
    assert codec.chunk_table(df, model, most=2).num_rows == 2
    for most, own in ((codec.TABLE_CHUNKS, codec.OWN_CHUNKS), (1, 1)):
        monkeypatch.setattr(codec, "OWN_CHUNKS", own)
        monkeypatch.setattr(codec.chunk_table, "__defaults__", ("text", most))
        for r in codec.encode_decode(df, model).collect():
            ids = [*sp.encode(texts[r.doc_id] or ""), 2]
            assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded == sp.decode(ids) and r.n_tokens == len(ids)
