"""ROUGE and BLEU against plain tables and counts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from portcullis import queries  # noqa: F401  registers the queries
from portcullis.operators import textmetrics as tm
from portcullis.queries import QUERIES


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def grams(x, n):
    return Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1))


def brute(text, reference):
    text, reference = text or "", reference or ""
    a, b = (re.findall(r"[^ \t\n\r\x0b\x0c]+", x) for x in (text, reference))

    def f(shared, size, wanted):
        if not size or not wanted:
            return 0.0
        p, r = shared / size, shared / wanted
        return 2 * p * r / (p + r + 1e-8)

    out = [f(sum((grams(a, n) & grams(b, n)).values()), max(0, len(a) - n + 1), max(0, len(b) - n + 1)) for n in (1, 2)] + [f(lcs(a, b), len(a), len(b))]
    p, zeros, bleu = [], 0, 0.0
    if text and reference and sum((grams(text, 1) & grams(reference, 1)).values()):
        for n in range(1, 5):
            shared, size = sum((grams(text, n) & grams(reference, n)).values()), max(1, len(text) - n + 1)
            zeros += not shared
            p.append(shared / size if shared else 1 / (2**zeros * size))
        bleu = math.exp(sum(math.log(x) / 4 for x in p)) * (1 if len(text) > len(reference) else math.exp(1 - len(reference) / len(text)))
    return [100 * x for x in (*out, bleu)]


@pytest.mark.parametrize(("text", "reference", "want"), [(None, "a", [0, 0, 0, 0]), ("", "", [0, 0, 0, 0]), ("a b c d", "a b c d", [100, 100, 100, 100]), ("  ", "a", [0, 0, 0, 0])])
def test_known_values(text, reference, want):
    assert np.allclose(tm.scores(text, reference), want, atol=1e-3)


def test_against_plain_counts():
    r = random.Random(6)
    for _ in range(400):
        kinds = r.choice([1, 2, 5, 40])
        words = [" ".join(r.choice("abcdefgé漢🙂")[: 1] * r.randint(1, 2) + str(r.randrange(kinds)) for _ in range(r.randint(0, 30))) for _ in range(2)]
        if r.random() < 0.4:
            own = words[0].split()
            r.shuffle(own) if r.random() < 0.3 else own and own.pop(r.randrange(len(own)))
            words[1] = " ".join(own)
        assert np.allclose(tm.scores(*words), brute(*words), atol=1e-3), words


def test_long_subsequences():
    r = np.random.default_rng(1)
    a = r.integers(0, 50, 3000)
    b = np.delete(a, np.arange(0, 3000, 7))
    assert tm.common_subsequence(a, b) == len(b) and tm.common_subsequence(b[:500], a[100:900]) == lcs(b[:500].tolist(), a[100:900].tolist())


def test_query_against_plain_counts(spark, sf_dir):
    got = {r.doc_id: r for r in QUERIES["text_generation_metrics"](spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert set(got) == set(texts)
    tested = 0
    for k, t in texts.items():
        if len(t) > 4000:
            continue
        other = " ".join(w for i, w in enumerate(re.findall(r"[^ \t\n\r\x0b\x0c]+", t)) if i % 7 != 3) if k % 2 == 0 else texts.get(k - 1)
        if other is not None and len(other) > 4000:
            continue
        tested += 1
        assert np.allclose([got[k][m] for m in tm.METRICS], brute(other, t), atol=1e-3), k
    assert tested > 50


def test_null_and_repeated_keys(spark):
    rows = [(None, "a b", "a b"), (1, None, "a"), (1, "a", "a b"), (2, "", None)]
    got = tm.text_metrics(spark.createDataFrame(rows, "k int, prediction string, reference string"), "k")
    assert sorted((r.k or 0, round(r.rouge_1)) for r in got.collect()) == [(0, 100), (1, 0), (1, 67), (2, 0)]
    assert tm.mean_metrics(got).first().pairs == 4 and tm.text_metrics(spark.createDataFrame([], "k int, prediction string, reference string"), "k").count() == 0
