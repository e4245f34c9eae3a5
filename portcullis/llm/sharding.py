"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Everything is DataFrame functions. Row numbers come from a fixed number of hash buckets: one count a bucket
(a table of at most ``buckets`` rows, the proven bound of the only broadcast) gives each bucket's first
number, and rows are numbered inside their bucket. The permutation then sends row number x to p(x); its
shard is p(x) mod shards and its slot p(x) div shards, so shard and slot of any row number can be computed
without looking at other rows, shards differ by at most one row and slots have no gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROUNDS = 6
#: Steps of cycle walking. The Feistel domain is a x b with a = ceil(sqrt n), b = ceil(n / a): fewer than a numbers
#: too many, so a step misses with a chance under 1 / sqrt n; a row that still misses raises an error.
WALK = 48


def _feistel(x: str, seed: int) -> str:
    """SQL for one pass over Z_a x Z_b (columns ``_a`` and ``_b``): the halves take turns."""
    half = "pmod(xxhash64({seed}L, i, s.{of}), {mod})"
    left = f"pmod(s.l + {half.format(seed=seed, of='r', mod='_a')}, _a)"
    right = f"pmod(s.r + {half.format(seed=seed, of='l', mod='_b')}, _b)"
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('l', {x} div _b, 'r', {x} % _b), "
        f"(s, i) -> named_struct('l', if(i % 2 = 1, {left}, s.l), 'r', if(i % 2 = 0, {right}, s.r)), "
        f"s -> s.l * _b + s.r)"
    )


def permuted(n: str, number: str, seed: int) -> Column:
    """Image of row number ``number`` under a permutation of 0..n-1 (both names of long columns)."""
    first = _feistel(number, seed)
    return F.expr(
        f"aggregate(sequence(1, {WALK}), {first}, (x, k) -> if(x < {n}, x, {_feistel('x', seed)}), "
        f"x -> if(x < {n}, x, cast(raise_error('cycle walking did not end') as bigint)))"
    )


def shard_rows(rows: DataFrame, keys: list[str], shards: int = 8, seed: int = 20240917, buckets: int = 4096) -> DataFrame:
    """Add ``row_number``, ``shard`` and ``slot``; the same rows, keys and seed always give the same places.

    Keys may be null and may repeat: rows equal in all keys are interchangeable. An empty table gives an empty
    one. Columns that have the added names are replaced; no other column is touched, whatever its name.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    added = ("row_number", "shard", "slot")
    rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in added]).alias("_row"), *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keys)])
    names = [f"_k{i}" for i in range(len(keys))]
    bucketed = rows.withColumn("_bucket", F.pmod(F.xxhash64(*names), F.lit(buckets)).cast("int"))
    counts = bucketed.groupBy("_bucket").agg(F.count("*").alias("_c"))
    every = Window.orderBy("_bucket")
    starts = (
        counts.withColumn("_start", F.sum("_c").over(every.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c"))
        .withColumn("_n", F.sum("_c").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("_a", F.ceil(F.sqrt("_n")).cast("long"))
        .withColumn("_b", F.expr("(_n + _a - 1) div _a"))
        .drop("_c")
    )
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*[F.col(k).asc_nulls_first() for k in names]))
    numbered = bucketed.withColumn("_i", within - 1).join(F.broadcast(starts), "_bucket").withColumn("_x", F.col("_start") + F.col("_i"))
    placed = numbered.withColumn("_p", permuted("_n", "_x", seed))
    return placed.select("_row.*", F.col("_x").alias("row_number"), (F.col("_p") % shards).cast("int").alias("shard"), F.expr(f"_p div {shards}").alias("slot"))


def place_of(number: int, n: int, shards: int, permutation: list[int] | None = None) -> tuple[int, int]:
    """Shard and slot of a permuted row number, as ``shard_rows`` gives them."""
    p = permutation[number] if permutation else number
    return p % shards, p // shards
