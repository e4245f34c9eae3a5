"""ROUGE-1, ROUGE-2, ROUGE-L and BLEU-4 of texts against reference texts.

ROUGE goes by words between ASCII white space: clipped n-gram counts, and for L the longest common subsequence. BLEU goes by
characters: clipped precisions of 1 to 4 characters, where a precision of 0 is taken as half, then a quarter, ... of one
n-gram, times the brevity penalty.

The subsequence is found by bits: a row of the usual table is one big integer, whose zeros mark where the row grows, and a
word of the reference turns it into the next by an addition. That is words times words / 64 steps and memory for one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("rouge_1", "rouge_2", "rouge_l", "bleu_4")
#: Fixed value: keeps the F measure defined where nothing is shared.
_NEAR_ZERO = 1e-8


def _numbers(*sides: list) -> list[np.ndarray]:
    known: dict = {}
    return [np.array([known.setdefault(x, len(known)) for x in side], np.int64) for side in sides]


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Members that two bags of numbers share."""
    if not len(a) or not len(b):
        return 0
    size = int(max(a.max(), b.max())) + 1
    return int(np.minimum(np.bincount(a, minlength=size), np.bincount(b, minlength=size)).sum())


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    if not len(a) or not len(b):
        return 0
    n, where = len(a), {}
    for x in np.intersect1d(a, b).tolist():
        where[x] = int.from_bytes(np.packbits(a == x, bitorder="little").tobytes(), "little")
    full = (1 << n) - 1
    row = full
    for x in b.tolist():
        if m := where.get(x):
            both = row & m
            row = (row + both | row - both) & full
    return n - row.bit_count()


def _f(shared: int, size: int, wanted: int) -> float:
    if not size or not wanted:
        return 0.0
    p, r = shared / size, shared / wanted
    return 2 * (p * r) / (p + r + _NEAR_ZERO)


def _levels(a: np.ndarray, b: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The n-grams of both sides for n = 1 .. most, as small numbers that agree; an n-gram is its beginning and its last member."""
    last = (a, b)
    for n in range(1, most + 1):
        if n > 1:
            kinds = int(max(x.max(initial=0) for x in last)) + 1
            a, b = (x[: max(0, len(x) - 1)] * kinds + one[n - 1 :] for x, one in zip((a, b), last, strict=True))
        both = np.unique(np.concatenate([a, b]), return_inverse=True)[1]
        a, b = both[: len(a)], both[len(a) :]
        if n == 1:
            last = (a, b)
        yield a, b


def scores(text: str | None, reference: str | None) -> tuple[float, float, float, float]:
    """The four metrics of one pair, in percent with four digits; null counts as empty, and an empty side scores 0."""
    text, reference = text or "", reference or ""
    a, b = _numbers(*(x.encode("utf-8", "surrogatepass").split() for x in (text, reference)))
    rouge = [_f(_shared(x, y), len(x), len(y)) for x, y in _levels(a, b, 2)]
    rouge.append(_f(common_subsequence(a, b), len(a), len(b)))
    return (*(round(100 * x, 4) for x in rouge), round(100 * _bleu(text, reference), 4))


def _bleu(text: str, reference: str) -> float:
    points = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for x in (text, reference)]
    if not len(points[0]) or not len(points[1]):
        return 0.0
    total, zeros = 0.0, 0
    for n, (a, b) in enumerate(_levels(*points, 4), 1):
        shared, size = _shared(a, b), max(1, len(points[0]) - n + 1)
        if not shared:
            if n == 1:
                return 0.0
            zeros += 1
        total += 0.25 * math.log(shared / size if shared else 1 / (2**zeros * size))
    short = len(points[0]) <= len(points[1])
    return math.exp(total + (1 - len(points[1]) / len(points[0]) if short else 0.0))


def text_metrics(pairs: DataFrame, key: str, text: str = "prediction", reference: str = "reference") -> DataFrame:
    """key and the four metrics for each row of pairs. Keys may be null or repeat; no shuffle, one pair at a time in a worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scores(a.as_py(), b.as_py()) for a, b in zip(batch.column("a"), batch.column("b"), strict=True)]
            columns = zip(*found, strict=True) if found else [()] * len(METRICS)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, pa.float64()) for c in columns]], names=["id", *METRICS])

    slim = pairs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("a"), F.col(f"`{reference}`").cast("string").alias("b"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, " + ", ".join(f"{m} double" for m in METRICS)).withColumnRenamed("id", key)


def mean_metrics(found: DataFrame, *by: str, digits: int = 4) -> DataFrame:
    """Pairs and the mean of each metric, over all or by columns."""
    return found.groupBy(*by).agg(F.count("*").cast("long").alias("pairs"), *[F.round(F.avg(m), digits).alias(m) for m in METRICS])
