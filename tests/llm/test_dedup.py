import brute
import pytest
from pyspark.sql import functions as F

from portcullis.llm import components, decontamination, linking, lines, minhash, queries, substrings


def _items(rows):
    by = dict(rows)
    w = by[5].split()
    return [(1, " ".join(w[10:40])), (2, by[7]), (2, " ".join(w[100:113])), (3, "a B"), (4, None), (5, "  ..."), (None, " ".join(w[150:170]).upper()), (6, " ".join(w[10:40]))]


def test_contamination(spark, docs, rows):
    items = _items(rows)
    found = decontamination.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in found.collect()}
    assert got == {k: w for (k, _), w in zip(rows, brute.contamination(rows, items), strict=True)}


def test_contamination_keeps_repeated_rows_apart(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text), (1, text), (1, "other"), (None, text)], "doc_id long, text string")
    found = decontamination.contamination(docs, spark.createDataFrame([(9, text)], "item_id long, text string"))
    assert sorted((r.doc_id or 0, r.n_hit) for r in found.collect()) == [(0, 20), (1, 0), (1, 20), (1, 20)]
    none = decontamination.contamination(docs, spark.createDataFrame([], "item_id long, text string"))
    assert {r.n_hit for r in none.collect()} == {0}


def test_near_duplicates(docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute.near_duplicates(rows)


@pytest.mark.parametrize("small", [1, 3])
def test_long_lists_lose_no_link(docs, rows, monkeypatch, small):
    monkeypatch.setattr(linking, "SMALL", small)
    few = docs.where("doc_id < 120")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(few, part=80, size=2).collect()}
    assert got == brute.near_duplicates([x for x in rows if x[0] < 120], n=2, part=80)


def test_near_duplicates_of_null_keys(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (2, "a b c d"), (1, "A b c d"), (3, "")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in minhash.near_duplicates(docs).collect()) == [(0, 0), (1, 1), (2, 1), (3, 3)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_lines(docs, rows):
    few = [x for x in rows if x[0] < 200]
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs.where("doc_id < 200")).collect()}
    assert got == brute.dedup_lines(few)


def test_lines_in_long_lists(spark, monkeypatch):
    monkeypatch.setattr(linking, "SMALL", 2)
    rows = [(i, f"This is a longer line with the number {i % 13} in it, and it goes on and on to the end {'x' * (i % 4)}.") for i in range(40)]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.dedup_lines(rows)


def test_substrings(docs, rows):
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.sha) for r in substrings.dedup_substrings(docs).withColumn("sha", F.sha2("kept", 256)).collect())
    assert got == sorted(brute.dedup_substrings(rows))


def test_substrings_of_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, text), (1, text), (None, "a b"), (2, " ".join(f"v{i}" for i in range(50)))], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in substrings.dedup_substrings(docs).collect()) == [(0, 0), (1, 50), (1, 50), (2, 0)]


@pytest.mark.parametrize("run", [minhash.near_duplicates, lines.dedup_lines, substrings.dedup_substrings])
def test_empty(empty, run):
    assert run(empty).count() == 0


def test_queries_on_tables(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op2_minhash(spark, sf_dir).collect()}
    assert near == brute.near_duplicates(rows)
    assert sorted(tuple(r) for r in queries.op10_substrings(spark, sf_dir).collect()) == sorted(brute.dedup_substrings(rows))
