import hashlib
import math
import tracemalloc
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from portcullis.llm import html, labelled_pages, langid, media, ngrams, packing, queries, sharding


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    got = packing.pack(docs, path, ids=True).collect()
    t = Tokenizer.from_file(path)
    for key, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        own = sorted((p for p in got if p.doc_id == key), key=lambda p: p.start)
        assert [i for p in own for i in p.ids] == ids.tolist() and {p.doc_tokens for p in own} == {len(ids)}
        for p in own:
            part = ids[p.start : p.start + p.length]
            assert len(part) == p.length == len(p.ids) and zlib.crc32(part.tobytes()) == p.ids_crc32
    filled = {}
    for p in sorted(got, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == filled.get(p.sequence_id, 0)
        filled[p.sequence_id] = p.offset + p.length
    assert max(filled.values()) <= 1024


def test_tokens_of_letters_at_the_end_of_the_array_split():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from portcullis.llm import tokens

    texts = ["a\u024f b", "plain words", "\u0250", "x \u027f y", "Az\u0259rbaycan dili", "\u0280", "\u00e9t\u00e9 \u0252\u0261", "last"]
    t = Tokenizer.from_file(queries.vocabulary())
    ((_, flat, counts),) = tokens.encoded(queries.vocabulary(), pa.array(texts))
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_plan_uses_each_remainder_once():
    r = np.random.default_rng(1)
    for histogram in (r.integers(0, 50, 1024), np.bincount([500] * 7, minlength=1024), np.zeros(1024, int), np.bincount([1] * 5000 + [1023] * 3, minlength=1024)):
        used = np.zeros(1024, int)
        for lengths, times in packing.plan(histogram):
            assert sum(lengths) <= 1024
            for n in lengths:
                used[n] += times
        histogram = histogram.copy()
        histogram[0] = 0
        assert (used == histogram).all()


def test_empty_tables(spark, empty):
    assert packing.pack(empty, queries.vocabulary()).count() == 0
    assert media.load(media.store(empty)).count() == 0
    assert ngrams.score(empty, langid.held_out(folds=10)).count() == 0
    assert sharding.shard_rows(empty, ["doc_id"]).count() == 0
    assert langid.identify(empty, langid.fit(empty, F.lit(True))).count() == 0
    assert html.main_text(empty, "text").count() == 0


def test_media_round_trip(docs, rows):
    got = {r.doc_id: r for r in media.load(media.store(docs)).collect()}
    for key, text in rows:
        b = (text or "").encode()
        payload = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        assert bytes(got[key].pixels) == payload and got[key].n_bytes == len(b)
        assert b"".join(x.astype(np.uint32).__rshift__(8).astype(np.uint8).tobytes() for x in _decoded(bytes(got[key].media))) == payload


def _decoded(data):
    from portcullis.llm import webp

    return webp.decode([data[a:b] for a, b in webp.file_spans(data)])


def test_ngram_scores(docs, rows):
    got = {r.doc_id: r for r in ngrams.score(docs, langid.held_out(folds=10)).collect()}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows}
    own = {k: [*brute.words(t), None] for k, t in rows}
    counts = Counter(w for k, ws in own.items() if not held[k] for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    for k, ws in own.items():
        r = got[k]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(ws), sum(counts[w] > 0 for w in ws), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and r.score < 0


@pytest.mark.parametrize(("chunk", "parts"), [(1 << 20, 4), (1, 1), (3, 7)])
def test_ngram_scores_follow_the_counts(spark, monkeypatch, chunk, parts):
    """Scores by the written formula from exact counts, rounded as the filter rounds them, whatever the chunks and buckets."""
    texts = ["a b a b c", "a b", "b c d", "a b c", "", None, "e", "a b c", "z a b", "a q"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    own = [[*(t or "").split(), None] for t in texts]
    c1 = Counter(w for ws in own[:8] for w in ws)
    c2 = Counter(p for ws in own[:8] for p in zip([()] + ws, ws, strict=False))
    near = lambda c, gram: float(ngrams.typical(ngrams.quantise(np.array([c]), gram), gram)[0]) if c else 0.0
    total, distinct = sum(c1.values()), len(c1)
    monkeypatch.setattr(ngrams, "parts", lambda *_: parts)
    for r in ngrams.score(docs, F.col("doc_id") >= 8, chunk=chunk, bits_each=4000).collect():  # with so many bits no entry is false
        ws, want = own[r.doc_id], 0.0
        for u, w in zip([()] + ws, ws, strict=False):
            before = near(c1[None] if u == () else c1[u], 1)
            plain = (near(c1[w], 1) + 0.1) / (total + 0.1 * (distinct + 1))
            pair = min(near(c2[u, w], 2), before)
            want += math.log10(ngrams.MIX * pair / before + (1 - ngrams.MIX) * plain if before else plain)
        assert math.isclose(r.score, want, rel_tol=1e-9)
        assert (r.train_tokens, r.n_known, r.held_out) == (total, sum(c1[w] > 0 for w in ws), r.doc_id >= 8)


def test_ngrams_null_and_repeated_ids_and_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a"), (None, "a b"), (None, None), (1, "a b")], "doc_id long, text string")
    got = ngrams.score(docs, F.lit(False)).collect()
    assert sorted((r.doc_id is None, r.n_tokens, r.n_known) for r in got) == [(False, 2, 2), (False, 3, 3), (False, 3, 3), (True, 1, 1), (True, 3, 3)]
    none = ngrams.score(docs, F.lit(True)).collect()
    assert len(none) == 5 and all(r.train_tokens == 0 and r.n_known == 0 and math.isclose(r.base_score, r.score) for r in none)


def test_counts_beyond_32_bits():
    hashes, counts = np.arange(1, 5, dtype=np.uint64) << np.uint64(40), np.array([1, (1 << 40) + 7, 3, 1 << 32])
    for _ in range(2):
        hashes, counts = ngrams._merged([ngrams._unpack(ngrams._pack(hashes, counts, 1), 1), ngrams._unpack(ngrams._pack(hashes, counts, 1), 1)])
    assert counts.tolist() == [4, 4 * ((1 << 40) + 7), 12, 1 << 34]


def test_filter_never_underestimates():
    r = np.random.default_rng(2)
    hashes, counts = np.unique(r.integers(0, 1 << 63, 5000, dtype=np.uint64)), None
    counts = r.integers(1, 3000, len(hashes))
    hashes[-1] = (1 << 64) - 1
    data = ngrams._pack(hashes, counts, 1)
    h, c = ngrams._unpack(data, 1)
    pairs = hashes >> np.uint64(16) << np.uint64(16)
    assert (ngrams._unpack(ngrams._pack(pairs, counts, 2), 2)[0] == pairs).all()
    assert dict(zip(h.tolist(), c.tolist(), strict=True)) == dict(zip(hashes.tolist(), counts.tolist(), strict=True))
    few = np.arange(1, 300, dtype=np.uint64) << np.uint64(32)
    f = ngrams.Segment({1: (hashes, counts), 2: (few, np.ones(len(few), np.int64))})
    q, levels = ngrams.quantise(counts, 1), f.levels(hashes, 1)
    assert (levels >= q).all() and (levels == q).mean() > 0.98 and (f.levels(few, 2) == 1).all()
    assert (f.levels(r.integers(0, 1 << 63, 5000, dtype=np.uint64), 1) == 0).mean() > 0.98
    assert f.size == ngrams.BITS_EACH * (int(q.sum()) + len(few))
    nothing = hashes[:0], counts[:0]
    assert not ngrams.Segment({1: nothing, 2: nothing}).levels(hashes, 2).any()


def test_sharding(spark, docs, rows):
    got = sharding.shard_rows(docs, ["doc_id"], shards=8).select("doc_id", "shard", "slot", "kept").collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    again = sharding.shard_rows(docs.repartition(7), ["doc_id"], shards=8).select("doc_id", "shard", "slot", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation(spark, n):
    df = spark.range(n).select(F.col("id").alias("x"), F.lit(n).cast("long").alias("n"), F.ceil(F.sqrt(F.lit(n))).cast("long").alias("_a"))
    df = df.withColumn("_b", F.expr("(n + _a - 1) div _a"))
    assert sorted(r[0] for r in df.select(sharding.permuted("n", "x", 5)).collect()) == list(range(n))


def test_repeated_and_null_keys_get_places_of_their_own(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,), (2,)], "k long")
    assert len({(r.shard, r.slot) for r in sharding.shard_rows(df, ["k"], shards=2).collect()}) == 5


def test_language_id(spark, sf_dir):
    got = queries.op9_langid(spark, sf_dir).collect()
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == len(true) and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == true[r.doc_id] for r in held) >= 0.95 * len(held)


def test_language_of_odd_texts(spark, docs):
    model = langid.fit(docs, F.lit(True))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    assert all(got[k] == ("und", 0.0) for k in (100, 101, 102, 109)) and got[107][0] in ("en", "fr")
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}


def test_main_text_of_held_out_pages():
    model = html.trained()
    hit = wrong = lost = 0
    for source in labelled_pages.pages(150, seed=99):
        page = html.Page(source, labels=True)
        for text, label, p in zip(page.text, page.label, model.marginals(page), strict=True):
            if text:
                hit += label and p > 0.5
                wrong += not label and p > 0.5
                lost += label and p <= 0.5
    assert hit / (hit + wrong) > 0.97 and hit / (hit + lost) > 0.97


def test_marginals_match_enumeration():
    from itertools import product

    model = html.trained()
    page = html.Page("<body><nav>a</nav><article><p>Some words here.</p></article></body>")
    n = len(page.parent)
    local = [model.likelihood(f) for f in page.features()]
    sums, total = [0.0] * n, 0.0
    for z in product(range(3), repeat=n):
        if z[0] != html.OUTER:
            continue
        p = local[0][0]
        for i in range(1, n):
            p *= model.edge[bool(page.text[i])][z[page.parent[i]]][z[i]] * local[i][z[i]]
        total += p
        for i in range(n):
            sums[i] += p * (z[i] == html.ARTICLE)
    assert np.allclose(model.marginals(page), [s / total for s in sums], atol=1e-9)


def test_main_text(spark):
    page = "<html><head><title>T</title><script>if (a < b) x = '<p>no</p>'</script></head><body><nav><a href=/>Home</a></nav><article><h1>Head &amp; more</h1><p>One  two\n three, and a good deal more text here.<p>Four<br>five; six.</article><div class='comments'><p>Nice, thanks.</p></div><footer>&copy; us</footer></body></html>"
    rows = [(1, page), (2, None), (3, ""), (4, "<nav>only</nav>"), (5, "<p>" * 3000 + "deep"), (6, "<div " + "a" * 100_000), (7, page[:-60])]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got[1] == "Head & more One two three, and a good deal more text here. Four five; six." and got[2] == got[3] == got[4] == ""
    assert got[7] == got[1]


@pytest.mark.parametrize("old, new", [("</head>", ""), ("</head><body>", ""), ("</head>", "<noscript><link rel=x></noscript>"), ("</head>", "<head><noscript>"), ("<html><head>", "<HEAD>")])
def test_main_text_of_pages_that_leave_out_the_end_of_head(old, new):
    page = "<html><head><meta charset=utf-8><title>T</title><style>p {}</style></head><body><nav><a href=/>Home</a></nav><article><h1>A head line</h1><p>One two three, and a good deal more text here.</p></article></body></html>"
    blocks = html.trained().blocks
    assert blocks(page.replace(old, new)) == blocks(page) == ["A head line", "One two three, and a good deal more text here."]
    words = [t for t in html.Page("<head><title>T</title> Loose text <p>and more").text if t]
    assert words == ["Loose text", "and more"]


def test_main_text_of_tables(spark, sf_dir):
    import html as entities
    import re

    for r in queries.op4_html(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", body)]
        assert r.text == " ".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_sha_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_clashing_names(spark):
    rows = [(1, "<html><body><article><p>Some words of an article that is long enough.</p></article></body></html>", "en"), (None, None, "en"), (1, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", *[F.lit(1).alias(c) for c in ("_letters", "letters", "row", "_html", "html", "blocks", "score")])
    model = langid.fit(docs, F.lit(True))
    got = langid.identify(docs, model)
    assert got.columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score"] and got.count() == 3
    found = html.main_text(docs.withColumnRenamed("text", "page"), "page")
    assert found.columns == ["doc_id", "page", "lang", "_letters", "letters", "row", "_html", "html", "score", "blocks", "text"]
    assert sorted(r.text for r in found.collect()) == ["", "", "Some words of an article that is long enough."]


def test_language_model_equals_direct_kernel_ridge():
    """With every row a landmark, the folded matrix gives what the kernel system gives that ridge regression solves directly."""
    r = np.random.default_rng(2)
    x = (r.random((60, 400)) < r.random((60, 1)) * 0.5).astype(np.uint8)
    x[:, 7] = 1
    labels = ["a"] * 10 + ["b"] * 30 + ["c"] * 20
    names, matrix = langid.solve(x, labels, landmarks=60, ridge=0.05)
    unit = x / np.sqrt(x.sum(1, keepdims=True))
    kernel, n = unit @ unit.T, len(labels)
    weight = np.array([1 / labels.count(lab) for lab in labels])
    y = np.where(np.array(labels)[:, None] == np.array(names), 1.0, -1.0)
    # minimise sum w (y - K a - b)^2 + ridge a'Ka: ridge a = w (y - K a - b), and the a of a language add up to 0
    system = np.block([[weight[:, None] * kernel + 0.05 * np.eye(n), weight[:, None]], [np.ones((1, n)), np.zeros((1, 1))]])
    solved = np.linalg.solve(system, np.vstack([weight[:, None] * y, np.zeros((1, len(names)))]))
    assert np.allclose(unit @ matrix[:-1] + matrix[-1], kernel @ solved[:-1] + solved[-1], atol=1e-3)


@pytest.mark.parametrize("key", ["doc_id", "text"])
def test_language_sample_of_repeated_and_null_ids(spark, monkeypatch, key):
    sizes = []
    monkeypatch.setattr(langid, "solve", lambda x, labels, solve=langid.solve: sizes.append(sorted(Counter(labels).items())) or solve(x, labels))
    rows = [(None if i % 2 else 7, f"the {i} and of", "en") for i in range(900)] + [(7, f"und der {i}", "de") for i in range(90)] + [(7, "die das", "de")] * 3000 + [(1, "x", None), (2, None, "en"), (3, "1 2", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    model = langid.fit(docs, F.lit(True), key=key, per_language=100)
    assert sizes == [[("de", 91), ("en", 100)]]
    assert np.allclose(model[1], langid.fit(docs.repartition(2), F.lit(True), key=key, per_language=100)[1], atol=1e-4)
    assert {(r.text[0], r.lang_pred) for r in langid.identify(docs.where("lang is not null and doc_id = 7 or doc_id is null"), model).collect()} == {("t", "en"), ("u", "de"), ("d", "de")}


def test_ngrams_ask_in_small_memory():
    words = np.array([f"w{i}" for i in range(50_000)])
    r = np.random.default_rng(3)
    texts = [" ".join(words[r.integers(0, 50_000, 300)]) for _ in range(2000)]
    rows = pa.RecordBatch.from_pydict({"rid": pa.array(range(2000)), "id": pa.array(range(2000)), "held_out": pa.array([i % 10 == 0 for i in range(2000)]), "text": pa.array(texts)})
    tracemalloc.start()
    largest, hashes = 0, []
    for out in ngrams._asked(iter([rows]), 40, 1 << 19):
        largest = max(largest, out.nbytes)
        for bucket, held in zip(out.column("bucket").to_pylist(), out.column("pairs").to_pylist(), strict=True):
            if held is not None:
                own, counts = ngrams._unpack(held, 2)
                assert (ngrams.bucket_of(own, 40) == bucket).all() and counts.max() >= 1
                hashes.append(len(own))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(hashes) > 590_000  # all pairs of the texts, which hardly repeat
    assert largest < 2 << 20 and peak < 40 << 20, (largest, peak)


def test_batches_are_small_by_bytes(spark):
    from portcullis.llm.lineage import small_batches

    small_batches(spark)
    rows = spark.range(0, 30, 1, 1).select(F.rpad(F.lit("x"), 1_000_000, "y").alias("t"))
    sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert len(sizes) > 4 and max(r.n for r in sizes) < 6 << 20


def test_freed_native_memory_goes_back(spark):
    from portcullis.llm import lineage

    assert lineage.trim(spark)
