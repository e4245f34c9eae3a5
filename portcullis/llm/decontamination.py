"""Benchmark decontamination by winnowing.

Of every ``window`` consecutive words the least hash of ``gram`` words is a fingerprint, so two texts that
share ``window`` words share the fingerprint of that window. Fingerprints of the documents that cannot be a
benchmark's are dropped by a bitmap of fixed size (``bits``), the others are joined with the benchmark's and
each hit is extended: the window around it must equal the item's window. Items shorter than ``window`` words
are windows of their own length, compared whole.

The bitmap is the only thing that is broadcast, and its size does not depend on the data; a fuller bitmap lets
more candidates through to the join, never fewer. Nulls and empty texts have no words, hence no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

WINDOW, GRAM = 13, 7
BITS = 1 << 26
_PAGE = 1 << 19  # bits to a collected piece of the bitmap
_HIT = pa.struct([("fp", pa.int64()), ("start", pa.int32()), ("len", pa.int32()), ("hashes", pa.list_(pa.int64()))])


def _bit(fp: np.ndarray, bits: int) -> np.ndarray:
    return (fp % np.uint64(bits)).astype(np.int64)


def _winnow(found: B.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, their hashes, their fingerprints, and the fingerprints' places."""
    whole_hash, whole = B.windows(found, window)
    at = np.flatnonzero(whole)
    if not len(at):
        none = np.zeros(0, np.uint64)
        return at, none, none, at
    grams, _ = B.windows(found, gram)
    least = B.sliding_argmin(grams, window - gram + 1)[at]
    return at, whole_hash[at], grams[least], least


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row for each window of each item: fp, window_hash, len, item (id as string, null stays null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in B.blocks(batch.column("text")):
                found = B.words(block, B.ALNUM, B.LOWER)
                row = found.row_of()
                at, hashes, fps, _ = _winnow(found, window, gram)
                out = [(row[at], hashes, fps, np.full(len(at), window))]
                counts = np.diff(found.bounds)
                for n in np.unique(counts[(counts > 0) & (counts < window)]):
                    rows = np.flatnonzero(counts == n)
                    h = B.windows(found, int(n))[0][found.bounds[rows]]
                    out.append((rows, h, h, np.full(len(rows), n)))
                rows, hashes, fps, lens = (np.concatenate(x) for x in zip(*out, strict=True))
                items = batch.column("item").slice(block.first, block.rows).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(B.signed(fps)), pa.array(B.signed(hashes)), pa.array(lens.astype(np.int32)), items], names=["fp", "window_hash", "len", "item"])

    slim = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{text}`").alias("text"))
    return slim.mapInArrow(run, "fp long, window_hash long, len int, item string").distinct()


def bitmap(fps: DataFrame, bits: int = BITS) -> np.ndarray:
    """Bitmap of the column fp, gathered in at most bits / 2**19 pieces of 64 KB."""

    def run(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        page = np.zeros(_PAGE, bool)
        page[table.column("at").to_numpy()] = True
        return pa.table({"page": pa.array([key[0].as_py()], pa.int32()), "held": pa.array([np.packbits(page, bitorder="little").tobytes()], pa.binary())})

    at = F.pmod(F.expr(f"cast(cast(conv(hex(fp), 16, 10) as decimal(20,0)) % {bits} as long)") if bits & (bits - 1) else F.col("fp").bitwiseAND(F.lit(bits - 1)), F.lit(bits))
    pages = fps.select(at.alias("bit")).distinct().select(F.expr(f"cast(bit div {_PAGE} as int)").alias("page"), F.expr(f"cast(bit % {_PAGE} as int)").alias("at"))
    out = np.zeros(max(bits, _PAGE) // 8, np.uint8)
    for r in pages.groupBy("page").applyInArrow(run, "page int, held binary").toLocalIterator():
        out[r["page"] * _PAGE // 8 : (r["page"] + 1) * _PAGE // 8] = np.frombuffer(r["held"], np.uint8)
    return out


def _held(bitmap: np.ndarray, fp: np.ndarray, bits: int) -> np.ndarray:
    at = _bit(fp, bits)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) != 0


def candidates(docs: DataFrame, wanted, lengths: list[int], key: list[str], text: str, window: int, gram: int, bits: int) -> DataFrame:
    """Each row's keys with n_words and its hits: fingerprints that the bitmap may hold, with the windows they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = wanted.value
        for batch in batches:
            for block in B.blocks(batch.column("_text")):
                found = B.words(block, B.ALNUM, B.LOWER)
                row = found.row_of()
                at, hashes, fps, places = _winnow(found, window, gram)
                keep = _held(held, fps, bits)
                at, hashes, fps, places = at[keep], hashes[keep], fps[keep], places[keep]
                first = np.ones(len(at), bool)
                first[1:] = (places[1:] != places[:-1]) | (at[1:] != at[:-1] + 1)
                heads = np.flatnonzero(first)
                hits = [(row[at[heads]], fps[heads], at[heads], np.full(len(heads), window), hashes, np.diff(np.append(heads, len(at))))]
                for n in lengths:
                    h, whole = B.windows(found, n)
                    at = np.flatnonzero(whole & _held(held, h, bits))
                    hits.append((row[at], h[at], at, np.full(len(at), n), h[at], np.ones(len(at), np.int64)))
                rows, fp, at, lens, hashes, counts = (np.concatenate(x) for x in zip(*hits, strict=True))
                starts = np.cumsum(counts) - counts
                order = np.argsort(rows, kind="stable")
                gather = np.repeat(starts[order], counts[order]) + B.ragged(counts[order])
                inner = B.lists(B.signed(hashes[gather]), counts[order], pa.int64())
                flat = pa.StructArray.from_arrays([pa.array(B.signed(fp[order])), pa.array((at - found.bounds[rows])[order].astype(np.int32)), pa.array(lens[order].astype(np.int32)), inner], fields=list(_HIT))
                offsets = np.zeros(block.rows + 1, np.int32)
                np.cumsum(np.bincount(rows, minlength=block.rows), out=offsets[1:])
                own = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays(
                    [*[own.column(f"_k{i}") for i in range(len(key))], pa.array(np.diff(found.bounds)), pa.ListArray.from_arrays(pa.array(offsets), flat)],
                    names=[*[f"_k{i}" for i in range(len(key))], "n_words", "hits"],
                )

    slim = docs.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(key)], F.col(f"`{text}`").alias("_text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(run, f"{fields}, n_words long, hits array<struct<fp: long, start: int, len: int, hashes: array<long>>>")


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, bits: int = BITS
) -> DataFrame:
    """For each row of docs: the key, n_words, spans (sorted word spans ``start, end`` that are hit, disjoint),
    n_hit (words in them) and items (sorted ids of the items with occurring windows).

    Rows are kept apart even where keys repeat or are null. Items without words have no window; an item whose
    id is null hits words but is not listed. An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    test = item_windows(benchmark, item_id, item_text, window, gram)
    lengths = sorted(r["len"] for r in test.where(F.col("len") < window).select("len").distinct().collect())  # under ``window`` rows
    wanted = spark.sparkContext.broadcast(bitmap(test.select("fp"), bits))
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("body"))
    found = candidates(numbered, wanted, lengths, ["rid", "id"], "body", window, gram, bits)
    hits = found.select("_k0", "_k1", "n_words", F.explode_outer("hits").alias("h")).select("_k0", "_k1", "n_words", "h.*")
    right = test.select(F.col("fp").alias("t_fp"), "window_hash", F.col("len").alias("t_len"), "item")
    met = hits.join(right, (F.col("fp") == F.col("t_fp")) & (F.col("len") == F.col("t_len")) & F.array_contains("hashes", F.col("window_hash")), "left")
    start = (F.col("start") + F.array_position("hashes", F.col("window_hash")) - 1).cast("int")
    span = F.when(F.col("t_fp").isNotNull(), F.struct(start.alias("start"), (start + F.col("len")).cast("int").alias("end")))
    gathered = met.groupBy("_k0").agg(F.first("_k1").alias(key), F.first("n_words").alias("n_words"), F.array_sort(F.collect_set(span)).alias("raw"), F.array_sort(F.collect_set("item")).alias("items"))
    merged = F.expr(
        "aggregate(raw, cast(array() as array<struct<start: int, end: int>>), (a, s) -> "
        "if(size(a) > 0 and element_at(a, -1).end >= s.start, "
        "concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end)))), concat(a, array(s))))"
    )
    hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    return gathered.withColumn("spans", merged).select(key, "n_words", "spans", hit.alias("n_hit"), "items")


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit", share: int = 20):
    """The contract's rule: any word hit, and at least one in ``share``."""
    return (F.col(n_hit) > 0) & (F.lit(share) * F.col(n_hit) >= F.col(n_words))
