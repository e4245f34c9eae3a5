"""Packing of tokenised documents into windows of fixed length.

A document (its ids, then the separator) is cut into whole windows and one remainder. Whole windows are sequences by
themselves. For the remainders' histogram (one bin a length, so of fixed size) the shallow combinations of lengths
that fill a window are enumerated, their repeat counts are solved by non-negative least squares and rounded down,
and what is left is packed greedily. All of this works on the histogram; documents then find their place by their
rank among the remainders of their length, which is counted in sub-buckets so that no length is one task's work.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import blocks as B
from . import tokens
from .lineage import cut

WINDOW, SEPARATOR, SUBS = 1024, 0, 128
TRIPLES = 32  # triples are enumerated over lengths that are multiples of this


def tokenize(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, separator: int = SEPARATOR, ids: bool = False) -> DataFrame:
    """key, n (ids with the separator), crcs (crc32 of the little-endian ids of each window-sized cut) and, on request, ids.

    Null and empty texts are the separator alone. Only one block of texts is held at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, flat, counts in tokens.encoded(vocabulary, batch.column("_text")):
                ends = np.cumsum(counts)
                full = np.insert(flat.astype("<u4"), ends, separator)
                counts = counts + 1
                cuts = -(-counts // window)
                starts = np.repeat(np.cumsum(counts) - counts, cuts) + B.ragged(cuts) * window
                stops = np.minimum(starts + window, np.repeat(np.cumsum(counts), cuts))
                raw = memoryview(np.ascontiguousarray(full)).cast("B")
                crcs = np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], np.int64)
                columns = {"key": batch.column("_key").slice(block.first, block.rows), "n": pa.array(counts), "crcs": B.lists(crcs, cuts, pa.int64())}
                if ids:
                    columns["ids"] = B.lists(full.astype(np.int32), counts, pa.int32())
                yield pa.RecordBatch.from_pydict(columns)

    slim = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    kind = slim.schema["_key"].dataType.simpleString()
    return slim.mapInArrow(run, f"key {kind}, n long, crcs array<long>" + ", ids array<int>" * ids)


def combinations(window: int = WINDOW, stride: int = TRIPLES) -> list[tuple[int, ...]]:
    """Pairs of lengths that sum to the window, and triples with their first two lengths on a grid."""
    pairs = [(a, window - a) for a in range(window // 2, window)]
    triples = [(a, b, window - a - b) for a in range(stride, window, stride) for b in range(stride, a + 1, stride) if 0 < window - a - b <= b]
    return pairs + triples


def least_squares(patterns: list[tuple[int, ...]], histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative x minimising |A x - histogram|, A counting the lengths of each pattern: multiplicative updates."""
    depth = max(map(len, patterns))
    index = np.array([p + (0,) * (depth - len(p)) for p in patterns])  # length 0 is a dummy bin
    b = histogram.astype(float)
    b[0] = 0
    x = np.full(len(patterns), max(b.sum(), 1.0) / len(patterns) / 2)
    real = index > 0
    pull = (b[index] * real).sum(1)
    for _ in range(steps):
        made = np.bincount(index.ravel(), np.repeat(x, depth), len(b))
        made[0] = 0
        push = (made[index] * real).sum(1)
        x *= pull / np.maximum(push, 1e-12)
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Combinations with repeat counts that use each remainder exactly once: (lengths, repeats)."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []
    patterns = combinations(window)
    x = least_squares(patterns, left) if left.any() else np.zeros(0)
    for k in np.argsort(-x, kind="stable").tolist():
        need: dict[int, int] = {}
        for n in patterns[k]:
            need[n] = need.get(n, 0) + 1
        times = min([int(x[k]), *(int(left[n]) // m for n, m in need.items())])
        if times > 0:
            for n, m in need.items():
                left[n] -= m * times
            out.append((patterns[k], times))
    while left.any():  # each round uses up at least one length
        gap, chosen, spare = window, [], left.copy()
        while gap and spare[1 : gap + 1].any():
            n = int(np.flatnonzero(spare[: gap + 1])[-1])
            take = int(min(spare[n], gap // n))
            chosen += [n] * take
            spare[n] -= take
            gap -= take * n
        used = np.bincount(chosen, minlength=len(left))
        times = int((left[used > 0] // used[used > 0]).min())
        left -= used * times
        out.append((tuple(chosen), times))
    return out


def _slots(made: list[tuple[tuple[int, ...], int]]) -> tuple[pd.DataFrame, int]:
    """For each length: which ranks go to which sequences, at which offset. And the number of sequences."""
    rows, used, sequence = [], {}, 0
    for lengths, times in made:
        offset = 0
        for n in lengths:
            lo = used.get(n, 0)
            rows.append((n, lo, lo + times, sequence - lo, offset))
            used[n] = lo + times
            offset += n
        sequence += times
    return pd.DataFrame(rows, columns=["rest", "lo", "hi", "shift", "offset"]), sequence


def pack(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, separator: int = SEPARATOR, ids: bool = False) -> DataFrame:
    """One row a piece: key, doc_tokens, start, length, ids_crc32, sequence_id, offset, and on request ids.

    Each id of each document (repeated rows are documents of their own) lies in one piece; pieces of a sequence lie
    without gaps from offset 0 on. An empty table gives no pieces. The driver holds the histogram and the counts of
    at most window * SUBS sub-buckets.
    """
    spark = docs.sparkSession
    made = cut(tokenize(docs, vocabulary, key, text, window, separator, ids))
    placed = made.withColumn("rest", (F.col("n") % window).cast("int")).withColumn("whole", F.expr(f"n div {window}")).withColumn("sub", F.pmod(F.xxhash64("key", "crcs"), F.lit(SUBS)).cast("int"))
    counts = placed.groupBy("rest", "sub").agg(F.count("*").alias("c"), F.sum("whole").alias("w")).toPandas().sort_values(["rest", "sub"], ignore_index=True)
    histogram = np.bincount(counts["rest"].astype(int), counts["c"].astype(float), window).astype(np.int64)
    slots, sequences = _slots(plan(histogram, window))
    counts["rank0"] = counts.groupby("rest")["c"].cumsum() - counts["c"]
    counts["whole0"] = sequences + counts["w"].cumsum() - counts["w"]
    starts = spark.createDataFrame(
        list(counts[["rest", "sub", "rank0", "whole0"]].astype("int64").itertuples(index=False, name=None)), T.StructType([T.StructField(n, T.LongType()) for n in ("rest", "sub", "rank0", "whole0")])
    )
    table = spark.createDataFrame(list(slots.astype("int64").itertuples(index=False, name=None)), T.StructType([T.StructField(n, T.LongType()) for n in ("rest", "lo", "hi", "shift", "offset")]))
    order = Window.partitionBy("rest", "sub").orderBy(F.col("key").asc_nulls_first(), "crcs")
    ranked = placed.withColumn("r", F.row_number().over(order) - 1).withColumn("before", F.sum("whole").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("whole"))
    # both tables are bounded: window * SUBS rows, and a few rows for each of at most len(combinations) + window patterns
    ranked = ranked.join(F.broadcast(starts), ["rest", "sub"]).withColumn("rank", F.col("rank0") + F.col("r")).withColumn("first", F.col("whole0") + F.col("before"))
    t = table.alias("t")
    found = ranked.join(F.broadcast(t), (ranked["rest"] == F.col("t.rest")) & (F.col("rank") >= F.col("t.lo")) & (F.col("rank") < F.col("t.hi")), "left")
    slices = "slice(ids, cast(i * {w} + 1 as int), {w})".format(w=window)
    pieces = F.expr(
        f"transform(sequence(0, size(crcs) - 1), i -> named_struct('start', i * {window}L, 'length', least({window}L, n - i * {window}L), 'ids_crc32', crcs[i], "
        f"'sequence_id', if(i < whole, first + i, rank + t.shift), 'offset', if(i < whole, 0L, t.offset)" + (f", 'ids', {slices}" if ids else "") + "))"
    )
    out = found.select(F.col("key").alias(key), F.col("n").alias("doc_tokens"), F.explode(pieces).alias("p"))
    return out.select(key, "doc_tokens", "p.*")
