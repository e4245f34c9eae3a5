"""The pipeline's stages one after the other against brute force."""

import brute

import corpus_pipeline as pipeline


def test_stages(spark, sf_dir, rows):
    few = [(k, t) for k, t in rows if k < 120]
    docs = spark.createDataFrame([(k, t, "en" if k % 2 else "fr", "s", len(t or "")) for k, t in few], "doc_id long, text string, lang string, source string, n_chars long")
    names = [n for n, _ in pipeline.STAGES]
    kept = {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        rows_ = docs.collect()
        if name != names[-1]:
            assert docs.columns == pipeline.COLUMNS
            kept[name] = {r.doc_id: r.text for r in rows_}
            docs = spark.createDataFrame(rows_, docs.schema)
    letters = {k: t for k, t in few if t and any(c.isalpha() for c in t)}
    assert kept[names[0]] == letters
    lines = brute.dedup_lines(sorted(letters.items()))
    assert kept[names[1]] == {k: t for k, t in lines.items() if t.strip(" \t\n\r\x0b\x0c")}
    near = brute.near_duplicates(sorted(kept[names[1]].items()), n=5, part=80)
    assert kept[names[2]] == {k: t for k, t in kept[names[1]].items() if near[k][1] == k}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    order = sorted(kept[names[2]])
    bad = {k for k, (n, hit, _) in zip(order, brute.contamination([(k, kept[names[2]][k]) for k in order], items), strict=True) if hit and 20 * hit >= n}
    assert set(kept[names[3]]) == set(order) - bad
    assert {r.doc_id for r in rows_} == set(kept[names[3]]) and all(r.length > 0 for r in rows_)


def test_odd_rows(spark, sf_dir):
    text = "alpha beta gamma delta epsilon zeta"
    rows = [(None, text, None, "s", 1), (1, text, "en", "s", 1), (1, text, "en", "s", 1), (1, "other words in this line entirely", "en", "s", 1), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, "", None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("text is not null").collect()]
    bad = spark.createDataFrame([(None, max(items, key=len), "en", "s", 1), (1, "clean words only", "en", "s", 1)], docs.schema)
    seen = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    assert seen(pipeline.language_id(spark, docs, sf_dir)) == sorted([(k, t) for k, t, *_ in rows if t], key=str)
    # where no row has a language there is no model; documents with letters stay
    unknown = spark.createDataFrame([(k, t, None, s, n) for k, t, _, s, n in rows], docs.schema)
    assert seen(pipeline.language_id(spark, unknown, sf_dir)) == sorted([(k, t) for k, t, *_ in rows if t], key=str)
    assert seen(pipeline.near_dedup(spark, docs, sf_dir)) == sorted([(1, text), (1, rows[3][1]), (2, None), (3, ""), (4, "")], key=str)
    assert seen(pipeline.decontaminate(spark, bad.union(docs), sf_dir)) == sorted([(1, "clean words only"), *[(k, t) for k, t, *_ in rows]], key=str)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
