import zlib

import numpy as np

from copresence.llm import language_id as L

EN = "the cat and the dog were there with their other thing {}"
DE = "der hund und die katze schlafen nicht auf dem sofa {}"
FR = "le chat est dans la maison avec une souris grise {}"


def _docs(spark, n=60):
    rows = [(i, t.format(i), lang, "s") for i, (t, lang) in enumerate([(EN, "en"), (DE, "de"), (FR, "fr")] * n)]
    rows += [(1000, None, "en", "s"), (1001, "12 34 !!", "de", "s"), (1002, "", None, None), (None, EN.format(1), None, "s"), (1003, DE.format(2) * 3000, None, "s"), (0, EN.format(0), "en", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def _model_of(texts, codes):
    present = [L.grams(t, codes) for t in texts]
    known = np.unique(np.concatenate(present))
    landmarks = np.zeros((len(known), len(texts)), np.float32)
    for j, p in enumerate(present):
        landmarks[np.searchsorted(known, p), j] = L.scales(p)
    return known, landmarks


def _plain_kernel(x, y):
    def sets(t):
        s = " " + "".join(c.lower() if c.isalpha() else " " for c in t) + " "
        return [{s[i : i + n] for i in range(len(s) - n + 1)} for n in L.ORDERS]

    return sum(len(a & b) / (len(a) * len(b)) ** 0.5 for a, b in zip(sets(x), sets(y), strict=True)) / len(L.ORDERS)


def test_kernel_matches_its_definition():
    codes = L.symbol_table()
    texts = ["Hello, World", "hallo welt", "ß", "a", "Привет, мир", "你好世界", "ΑΒΓ αβγ", "x" * 5000 + " y"]
    known, landmarks = _model_of(texts, codes)
    assert np.allclose(L.kernel(texts, codes, landmarks, known), [[_plain_kernel(x, y) for y in texts] for x in texts], atol=1e-5)


def test_ridge_matches_the_normal_equations():
    """Nyström regression minimises the squared error plus the penalty of the function's norm: checked against its gradient."""
    rng = np.random.default_rng(2)
    factors = rng.normal(size=(12, 12))
    between, k = factors @ factors.T, rng.normal(size=(40, 12))
    y = np.where(rng.random((40, 3)) < 0.3, 1.0, -1.0)
    weights = L.ridge(between, k, y, 0.7)
    alpha, intercept = weights[:-1], weights[-1]
    error = k @ alpha + intercept - y
    assert np.allclose(error.sum(0), 0, atol=1e-7)
    assert np.allclose(k.T @ error + 0.7 * between @ alpha, 0, atol=1e-6)


def test_scores_match_the_model(spark):
    docs = _docs(spark)
    model, codes = L.fit(docs), L.symbol_table()
    for r in L.predict(docs, model).collect():
        if r.text and any(c.isalpha() for c in r.text):
            x = np.array([g for g in L.grams(r.text, codes)])
            k = sum(np.where(model.grams == g, 1, 0) @ model.landmarks * s for g, s in zip(x, L.scales(x), strict=True)) if len(r.text) < 200 else None
            if k is not None:
                scores = k @ model.weights[:-1] + model.weights[-1]
                assert r.lang_pred == model.languages[int(scores.argmax())] and abs(r.score - min(1, max(0, (scores.max() + 1) / 2))) < 1e-4


def test_many_rows_of_one_id_stay_within_the_bounds(spark):
    """20,000 rows of an id, equal ones and different ones, beside a few others."""
    few = [(i, t.format(i), lang) for i, (t, lang) in enumerate([(EN, "en"), (DE, "de"), (FR, "fr")] * 10)]
    settings = L.Fit(sample_rows=300, landmark_rows=30)
    for text in (lambda i: EN.format(0), lambda i: EN.format(i)):
        docs = spark.createDataFrame(few + [(4, text(i), "en") for i in range(20_000)], "doc_id long, text string, lang string")
        languages, sample = L.sampled(docs, settings)
        rows = sample.collect()
        assert languages == ["de", "en", "fr"] and len(rows) <= 300 and max(sum(r.lang == x for r in rows) for x in languages) <= 100
        assert len({(r.lang, r.text) for r in rows}) == len(rows)
        model = L.fit(docs, settings)
        assert model.landmarks.shape[1] <= 30
        assert {r.lang_pred for r in L.predict(docs.filter("lang = 'de'"), model).collect()} == {"de"}


def test_clashing_names_and_ties(spark):
    docs = spark.createDataFrame([(1, "abc", "x", "old", 2.0, 3), (2, "abc", "w", "old", 2.0, 4)], "doc_id long, text string, lang string, lang_pred string, score double, h int")
    got = L.predict(docs, L.fit(docs)).collect()
    assert [(r.h, r.lang_pred) for r in got] == [(3, "w"), (4, "w")] and got[0].score == got[1].score


def test_held_out_documents_are_told_apart(spark, tmp_path):
    _docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = L.op3_language_id(spark, str(tmp_path)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == _docs(spark).count()
    truth = {i: ("en", "de", "fr")[i % 3] for i in range(180)}
    assert all(by[i].lang_pred == truth[i] for i in truth)
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in truth)
    assert by[1000].lang_pred == by[1001].lang_pred == by[1002].lang_pred == "und" and by[1000].score == 0
    assert by[1003].lang_pred == "de" and by[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)


def test_without_labels_or_rows(spark):
    docs = _docs(spark).limit(0)
    model = L.fit(docs)
    assert model.languages == []
    assert [r.lang_pred for r in L.predict(_docs(spark).limit(2), model).collect()] == ["und", "und"]
    assert L.predict(docs, model).collect() == []


def test_postings_give_the_same_products():
    texts = ["the cat sat", "der Hund lief", "le chat noir est là", "1 2", "Über the Hund"]
    codes = L.symbol_table()
    present = [L.grams(t, codes) for t in texts[:3]]
    (known, dense), (same, sparse) = L.landmark_matrix(present), L.landmark_matrix(present, dense=0)
    assert (known == same).all() and isinstance(sparse, L.Postings)
    one, two = (L.kernel(texts, codes, m, known) for m in (dense, sparse))
    assert np.allclose(one, two, atol=1e-6)
    assert np.allclose(L._between(present, known, dense), L._between(present, known, sparse), atol=1e-6)


def test_every_one_of_many_languages_takes_part(spark):
    """Over 500 languages, each of its own letters: none is left out, and the landmarks stay small."""
    rows = [(1000 * i + k, " ".join(chr(0x4E00 + 8 * i + (k + j) % 8) * 2 for j in range(5)), f"l{i:03}") for i in range(520) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    model = L.fit(docs)
    assert len(model.languages) == 520
    held = model.landmarks
    assert (held.values.nbytes + held.landmarks.nbytes + held.starts.nbytes if isinstance(held, L.Postings) else held.nbytes) + model.weights.nbytes < 1 << 27
    got = L.predict(docs, model).collect()
    assert sum(r.lang_pred == r.lang for r in got) > 0.99 * len(got)
