"""The pipeline's stages take effect, keep clean documents, and hand on the columns of documents."""

import random

import corpus_pipeline


def _documents(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    line = lambda: " ".join(rng.choice(vocabulary) for _ in range(12)).capitalize() + "."
    text = lambda n=12: "\n".join(line() for _ in range(n))
    shared = text(6)
    clean = {i: text() for i in range(30)}
    rows = [(i, t, "en") for i, t in clean.items()]
    rows += [(100 + i, clean[i], "en") for i in range(5)]  # exact copies
    rows += [(200 + i, text(8) + "\n" + shared + "\n" + text(8), "en") for i in range(4)]  # a passage that repeats
    rows += [(300, "12 34 !!", None), (301, None, None), (302, "too short", "en"), (303, "A | B | C | D | E | F\n" * 20, "en"), (30, None, "en")]
    return clean, shared, spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, tmp_path):
    clean, shared, docs = _documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept, columns = [], docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        assert docs.columns == columns, name
        kept.append({r.doc_id: r.text for r in docs.collect()})
    assert not {300, 301, 30} & set(kept[0]) - set(clean) and set(clean) <= set(kept[0]) | {30}
    assert not {302, 303} & set(kept[1]) and set(clean) <= set(kept[1])
    assert {i: kept[1][i] for i in clean} == clean
    assert set(clean) <= set(kept[2]) and not set(range(100, 105)) & set(kept[2])
    assert {i: kept[3][i] for i in clean} == clean
    assert sum(shared in t for t in kept[3].values()) == 1 and set(kept[3]) == set(kept[2])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept[3])


def test_empty(spark, tmp_path):
    _, _, docs = _documents(spark)
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


#: Names that the operators use inside.
INSIDE = (
    "row", "body", "did", "th", "at", "first", "again", "of", "of_th", "asked", "covers", "key", "block", "meta", "kind", "start", "span", "delta", "sliced",
    "lang_pred", "score", "quality", "node", "keys", "hashes", "root", "a", "b", "piece", "length", "ids_crc32", "_salt", "_key", "_part", "_base", "_inside",
    "rank", "sequence_id", "offset", "_lang", "_score", "_quality", "_th", "_did", "_covers", "_nth", "_of", "n", "label", "kept", "a.b", "h", "c",
)


def test_stages_leave_extra_columns_alone(spark, tmp_path):
    _, _, docs = _documents(spark)
    more = docs.selectExpr("*", *(f"CAST(concat(doc_id, ' {n}') AS STRING) AS `{n}`" for n in INSIDE))
    more.write.parquet(str(tmp_path / "documents.parquet"))
    docs.write.parquet(str(tmp_path / "plain.parquet"))
    with_more, plain = spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "plain.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        for kind, rows in (("more", with_more), ("plain", plain)):
            stage(spark, rows, str(tmp_path)).write.parquet(str(tmp_path / f"{kind}{k}"))
        with_more, plain = (spark.read.parquet(str(tmp_path / f"{kind}{k}")) for kind in ("more", "plain"))
        assert with_more.columns == more.columns, name
        got = with_more.collect()
        assert sorted(tuple(r)[: len(plain.columns)] for r in got) == sorted(tuple(r) for r in plain.collect()), name
        assert all(r[len(plain.columns) + i] == f"{r.doc_id} {n}" for r in got for i, n in enumerate(INSIDE)), name
    last = [stage(spark, rows, "").collect() for rows in (with_more, plain) for _, stage in corpus_pipeline.STAGES[-1:]]
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in last[0]) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in last[1])


def test_repeated_rows_and_null_ids(spark, tmp_path):
    clean, _, docs = _documents(spark)
    text = clean[0]
    rows = [(1, text), (1, text), (None, text), (None, clean[1]), (None, clean[1]), (1, clean[2]), (2, clean[3])]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [0, 1, 1, 2]


def test_rules_are_evaluated_once(spark):
    _, _, docs = _documents(spark)
    plan = corpus_pipeline.clean_lines(spark, docs, "")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("all rights reserved") <= 3  # one evaluation names the phrases in the flags and in both uses of the line rules
