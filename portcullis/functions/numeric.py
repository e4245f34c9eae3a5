"""Ratios, similarities and roundings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(n: Column, d: Column) -> Column:
    """n / d, and 0.0 where d is zero or null."""
    return F.when(F.coalesce(d, F.lit(0)) == 0, F.lit(0.0)).otherwise(n.cast("double") / d)


def rate4(n: Column, d: Column) -> Column:
    return F.round(ratio(n, d), 4)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0.0 for a null or a zero vector."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    norm = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    return F.coalesce(F.when(norm > 0, dot / norm), F.lit(0.0))


def alignment(cos: Column) -> Column:
    """A cosine moved to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cos + 1) / 2))


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, the estimate used where no tokenizer vocabulary is at hand."""
    return F.floor(F.char_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def spread(mean_of: Column) -> Column:
    """Population standard deviation; 0 for one value."""
    return F.coalesce(F.stddev_pop(mean_of), F.lit(0.0))
