import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from portcullis.llm import periodic, queries


def brute_runs(words, least=6, times=4):
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, b, c) for (a, b), c in out.items())


def brute_kept(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def brute_best(runs):
    best = None
    for a, n, q in runs:  # by start, then period
        if best is None or n * best[2] > best[1] * q:
            best = (a, n, q)
    return best


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def hashes(words):
    known = {}
    return np.array([known.setdefault(w, len(known)) * 0x9E3779B97F4A7C15 % 2**64 for w in words], np.uint64)


@pytest.mark.parametrize("every", [1, 4, 1024])
def test_runs(monkeypatch, every):
    monkeypatch.setattr(periodic, "EVERY", every)
    r = random.Random(every)
    for _ in range(1500):
        n, kinds = r.randint(0, 70), r.choice([1, 2, 3, 30])
        w = [r.randrange(kinds) for _ in range(n)]
        if n and r.random() < 0.7:
            a = r.randrange(n)
            p = r.randint(1, max(1, (n - a) // 3))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)] + [r.randrange(kinds) for _ in range(r.choice([0, 9]))]
        assert periodic.runs_of(hashes(w)) == brute_runs(w)


def test_long_periods_and_many_lags():
    r = random.Random(5)
    base = [r.randrange(10**6) for _ in range(3000)]
    w = [r.randrange(10**6) for _ in range(777)] + base * 4 + base[:10] + ["x"] * 30 + base[:1500] * 5
    runs = periodic.runs_of(hashes(w))
    assert (777, 12010, 3000) in runs and (777 + 12010, 30, 1) in runs and (777 + 12010 + 30, 7500, 1500) in runs
    assert len(runs) == 3
    with pytest.raises(ValueError, match="four"):
        periodic.periodic_runs(None, times=3)


def test_documents(docs, rows):
    got = {r.doc_id: r for r in periodic.periodic_runs(docs).collect()}
    assert len(got) == len(rows)
    for key, text in rows:
        w = words_of(text)
        runs = brute_runs(w) if len(w) < 5000 else [tuple(x) for x in got[key].runs]
        assert got[key].n_words == len(w)
        assert [tuple(x) for x in got[key].runs] == runs
        assert got[key].kept == brute_kept(w, runs)
        assert (tuple(got[key].best) if got[key].best else None) == brute_best(runs)
    assert got[105].kept == "the" and [tuple(x) for x in got[105].runs] == [(0, 300, 1)]


def test_empty_ties_and_repeated_rows(spark, empty):
    assert periodic.periodic_runs(empty).count() == 0
    two = "a " * 8 + "- " + "b " * 8  # runs of equal exponent: the first is best
    given = spark.createDataFrame([(1, two), (1, two), (None, two), (2, None), (3, "x y x y x"), (4, "x y " * 4)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, len(r.runs), tuple(r.best) if r.best else None, r.kept) for r in periodic.periodic_runs(given).collect())
    assert got == [(0, 2, (0, 8, 1), "a - b"), (1, 2, (0, 8, 1), "a - b"), (1, 2, (0, 8, 1), "a - b"), (2, 0, None, ""), (3, 0, None, "x y x y x"), (4, 1, (0, 8, 2), "x y")]


def expected(key, text):
    w = words_of(text)
    n, h = len(w), zlib.crc32(str(key).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = brute_best(runs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (key, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(brute_kept(w, runs)))


def test_query_against_brute_force(spark, sf_dir):
    got = queries.op11_periodicity(spark, sf_dir)
    assert dict(got.dtypes) | {"doc_id": ""} == {"doc_id": "", "runs_sha256": "string", "collapsed_sha256": "string"} | dict.fromkeys(("n_runs", "start", "length", "period", "exponent_milli"), "bigint")
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    short = [(r.doc_id, r.text) for r in texts if len(words_of(r.text)) < 1500]
    assert len(short) > 0.8 * len(texts)
    assert sorted(map(tuple, got.where(F.col("doc_id").isin([k for k, _ in short])).collect())) == sorted(expected(*x) for x in short)
    assert got.count() == len(texts)
