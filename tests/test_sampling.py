"""Bottom-k samples: exact sizes, the same under any partitioning, even over keys."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from portcullis.operators import sampling


@pytest.mark.parametrize("bits", [2, 16])
def test_against_a_sorted_list(spark, monkeypatch, bits):
    monkeypatch.setattr(sampling, "CELL_BITS", bits)
    rows = [(i % 5 if i % 11 else None, i, f"v{i}") for i in range(800)] + [(9, 1, "few"), (9, 2, "few")]
    df = spark.createDataFrame(rows, "s int, k int, v string")
    by = defaultdict(list)
    for s, k, v in rows:
        by[s].append((int(hashlib.sha256(f"7:{k}".encode()).hexdigest()[:15], 16), k, v))
    want = sorted((str(s), k, v) for s, own in by.items() for _, k, v in sorted(own)[:13])
    for parts in (1, 3, 17):
        got = sampling.bottom_k(df.repartition(parts), ["s"], ["k"], 13, seed=7)
        assert sorted((str(r.s), r.k, r.v) for r in got.collect()) == want


def test_repeated_keys_and_edges(spark):
    df = spark.range(1000).select(F.lit(1).alias("s"), F.lit("same").alias("k"), "id")
    assert sampling.bottom_k(df, ["s"], ["k"], 10).count() == 10
    assert sampling.bottom_k(df.limit(0), ["s"], ["k"], 10).count() == 0
    assert sampling.bottom_k(df.withColumn("k", F.lit(None).cast("string")), ["s"], ["k"], 2000).count() == 1000
    with pytest.raises(ValueError, match="positive"):
        sampling.bottom_k(df, ["s"], ["k"], 0)


def test_samples_are_even(spark):
    df = spark.range(20000).select((F.col("id") % 2).alias("s"), "id")
    got = [r.id for r in sampling.bottom_k(df, ["s"], ["id"], 2000).collect()]
    counts = Counter(i // 2000 for i in got)
    assert len(got) == 4000 and all(300 < counts[c] < 500 for c in range(10))
