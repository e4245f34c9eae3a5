"""Near-duplicate documents: a MinHash signature join by inverted lists, confirmed on full shingle sets.

1. Each text becomes its set of word shingles, two 64-bit sums that identify the set, and a signature of
   ``COORDINATES`` minima. Documents of equal sets are one class from here on.
2. Classes are posted under each coordinate-value pair; pairs that only one class has are skipped.
3. Two classes above the match threshold (``matches`` of the coordinates) must meet in the first
   ``COORDINATES - matches + 1`` pairs of both when pairs are taken rarest first, so only these prefixes are merged:
   a passage that thousands of documents share fills few coordinates and stays out of the prefixes.
4. Lists are merged by collision with one centre a list, for two rounds, and what a round links is contracted; a last
   round offers the pairs that may still be linked between components (see linking), so lists of n copies cost about n
   pairs, not n * n. Pairs with enough equal coordinates are confirmed on the whole sets, and only confirmed links join.

The match threshold lies five standard deviations below what a pair at the similarity threshold has on average: a few
such pairs in a million are missed, and pairs above it less often.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .decontamination import bitmap
from .lineage import cut, small_batches
from .linking import WORDS, link, parities

COORDINATES = 64
_BITS = 1 << 26
PARITY = [f"b{i}" for i in range(WORDS)]
_SALT = B.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64))


def match_threshold(part: int, whole: int) -> int:
    t = part / whole
    return max(1, math.floor(COORDINATES * t - 5 * math.sqrt(COORDINATES * t * (1 - t))))


def shingle_sets(block: B.Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted within the row, and how many there are.

    A row of fewer than ``size`` words has one shingle, its whole sequence; a row without words has none.
    """
    found = B.words(block, B.SPACED, B.LOWER)
    hashes, whole = B.windows(found, size)
    counts = np.diff(found.bounds)
    short = np.flatnonzero((counts > 0) & (counts < size))
    for n in np.unique(counts[short]):
        at = found.bounds[short[counts[short] == n]]
        hashes[at] = B.windows(found, int(n))[0][at]
        whole[at] = True
    flat = hashes[whole]
    ends = np.cumsum(whole)[np.maximum(found.bounds, 1) - 1] * (found.bounds > 0) if len(whole) else np.zeros(block.rows + 1, np.int64)
    edges = ends.tolist()
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        flat[lo:hi].sort()
    first = np.ones(len(flat), bool)
    first[1:] = flat[1:] != flat[:-1]
    first[[e for e in edges if e < len(flat)]] = True
    kept = np.concatenate([[0], np.cumsum(first)])[ends]
    return flat[first], np.diff(kept)


def signatures(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each non-empty row its coordinate-value pairs, each hashed with the coordinate into 64 bits."""
    some = counts[counts > 0]
    starts = np.cumsum(some) - some
    out = np.empty((len(some), COORDINATES), np.uint64)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat(flat * (_SALT[k] | np.uint64(1)), starts)
    return B.mix(out ^ _SALT)


def _sketch(docs: DataFrame, size: int) -> DataFrame:
    """id, n, s1, s2 (which identify the set), sig (empty for an empty set) and parity bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in B.blocks(batch.column("text")):
                flat, counts = shingle_sets(block, size)
                some = counts > 0
                sums = np.zeros((2, block.rows), np.uint64)
                sig = np.zeros(0, np.uint64)
                words = B.signed(parities(flat, counts).T.copy())
                if some.any():
                    starts = (np.cumsum(counts) - counts)[some]
                    sums[0, some] = np.add.reduceat(flat, starts)
                    sums[1, some] = np.add.reduceat(B.mix(flat + np.uint64(0x5851F42D4C957F2D)), starts)
                    sig = signatures(flat, counts).ravel()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(block.first, block.rows), pa.array(counts), pa.array(B.signed(sums[0])), pa.array(B.signed(sums[1])), B.lists(B.signed(sig), some * COORDINATES, pa.int64()), *map(pa.array, words)],
                    names=["id", "n", "s1", "s2", "sig", *PARITY],
                )

    return docs.mapInArrow(B.released(run), f"id long, n long, s1 long, s2 long, sig array<long>, {', '.join(f'{b} long' for b in PARITY)}")


def _sets(docs: DataFrame, size: int, wanted: DataFrame) -> DataFrame:
    """id and shingles of the wanted ids; a bitmap of fixed size keeps most others from being sent on."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("id").alias("fp")), _BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            at = batch.column("h").to_numpy().view(np.uint64) % np.uint64(_BITS)
            keep = bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1) != 0
            batch = batch.filter(pa.array(keep))
            for block in B.blocks(batch.column("text")):
                flat, counts = shingle_sets(block, size)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(block.first, block.rows), B.lists(B.signed(flat), counts, pa.int64())], names=["id", "shingles"])

    found = docs.select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(B.released(run), "id long, shingles array<long>")
    return found.join(wanted, "id", "left_semi")


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The shingles of each row of a batch."""
    held = batch.column("shingles")
    yield held.flatten().to_numpy(zero_copy_only=False).view(np.uint64), pc.list_value_length(held).to_numpy(zero_copy_only=False).astype(np.int64)


def _confirmed(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """The pairs (a, b) with enough equal coordinates whose sets satisfy whole * intersection >= part * union."""
    both = lambda rows, t, c: rows.join(t.select(F.col("id").alias("a"), F.col(c).alias("ca")), "a").join(t.select(F.col("id").alias("b"), F.col(c).alias("cb")), "b")
    like = both(pairs, sigs, "sig").where(F.size(F.array_intersect("ca", "cb")) >= match_threshold(part, whole)).select("a", "b")
    met = both(like, sets, "shingles").withColumn("i", F.size(F.array_intersect("ca", "cb")))
    return met.where(F.lit(whole) * F.col("i") >= F.lit(part) * (F.size("ca") + F.size("cb") - F.col("i"))).select("a", "b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, part: int = 85, whole: int = 100) -> DataFrame:
    """key, n_shingles and component_id (least key that links reach) for each row of docs.

    Links join texts with whole * |intersection| >= part * |union| of their shingle sets; keys are integers. Rows
    without words and rows with a null key link with nothing (their component is their own key). Rows that repeat a
    key are one node. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    base = cut(_sketch(slim, size))
    real = base.where("n > 0 and id is not null")
    classes = real.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"))
    reps = classes.select(F.col("rep").alias("id"), "s1", "s2", "n")
    sigs = cut(real.join(reps, ["id", "s1", "s2", "n"], "left_semi").select("id", "sig", "n", *PARITY).dropDuplicates(["id"]))
    posted = sigs.select("id", F.explode("sig").alias("pair"))
    shared = posted.groupBy("pair").agg(F.count("*").alias("df")).where("df > 1")
    lists = posted.join(shared, "pair").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "pair"))).alias("l"))
    keep = F.size("l") - F.lit(match_threshold(part, whole)) + 1  # the pairs that nothing else has come first in the prefix
    prefix = cut(lists.where(keep > 0).select("id", F.explode(F.slice("l", F.lit(1), keep)).alias("p")).select("id", "p.pair"))
    wanted = prefix.select("id").distinct()
    sets = cut(_sets(slim, size, wanted).dropDuplicates(["id", "shingles"]))
    labels = link(prefix, sigs.drop("sig"), lambda pairs: _confirmed(pairs, sigs, sets, part, whole), (sets, _tokens), part, whole)
    members = base.select("id", "n", "s1", "s2").join(classes, ["s1", "s2", "n"], "left")
    found = members.join(labels.withColumnRenamed("id", "node"), F.col("rep") == F.col("node"), "left")
    own = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("component", "rep")).otherwise(F.col("id"))
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"))
