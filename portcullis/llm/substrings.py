"""Exact substring dedup: words covered by a window of words that starts elsewhere too are removed.

Each window of ``window`` words has an anchor, its least hash of ``gram`` words, and equal windows have equal
anchors, so anchors occur at least as often as their windows. A count-min sketch of the anchors, merged from sparse
sketches of the partitions, overestimates those counts: a window whose anchor it shows once is not repeated.
The second pass groups the windows of all other anchors exactly. Windows that follow each other under one anchor
travel as one run; runs are pre-aggregated by content, so a passage of a million documents is a few rows a
partition, and what a run's windows turn out to be goes back to its occurrences by a join that Spark can split.

The sketch that is broadcast has a fixed size (two rows of ``CELLS`` bits); a fuller sketch lets more windows
through to the exact pass and loses none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .lineage import cut, forget, small_batches
from .sketches import count_min, repeated

WINDOW, GRAM = 35, 20
CELLS = 1 << 27


def _runs(found: B.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window hashes on end, and of each run of windows with one anchor: the anchor, the first window's word and the windows."""
    hashes, whole = B.windows(found, window)
    at = np.flatnonzero(whole)
    if not len(at):
        none = np.zeros(0, np.int64)
        return hashes[:0], hashes[:0], none, none
    grams, _ = B.windows(found, gram)
    place = B.sliding_argmin(grams, window - gram + 1)[at]
    first = np.ones(len(at), bool)
    first[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(first)
    return hashes[at], grams[place[heads]], at[heads], np.diff(np.append(heads, len(at)))


def _chosen(found: B.Words, bits: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs with an anchor estimated repeated: window hashes, their first places, content hash, first word and windows."""
    hashes, anchors, heads, counts = _runs(found, window, gram)
    starts = np.cumsum(counts) - counts
    content = B.mix(np.add.reduceat(B.mix(hashes * (B.ragged(counts).astype(np.uint64) * np.uint64(2) + np.uint64(1))), starts) + counts.astype(np.uint64)) if len(starts) else hashes
    keep = np.flatnonzero(repeated(bits, anchors))
    return hashes, starts[keep], content[keep], heads[keep], counts[keep]


def repeated_spans(docs: DataFrame, key: list[str], text: str, window: int, gram: int) -> DataFrame:
    """The keys and hits (array of first word and bit mask of repeated windows from there on) of rows that have any."""

    def anchors(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for block in B.blocks(batch.column("text")):
            yield _runs(B.words(block), window, gram)[1]

    held = docs.sparkSession.sparkContext.broadcast(count_min(docs.select(F.col(f"`{text}`").alias("text")), anchors, CELLS))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in B.blocks(batch.column("text")):
                hashes, starts, content, _, counts = _chosen(B.words(block), held.value, window, gram)
                run, one, n = np.unique(content, return_index=True, return_counts=True)
                own = hashes[np.repeat(starts[one], counts[one]) + B.ragged(counts[one])]
                yield pa.RecordBatch.from_arrays([pa.array(B.signed(run)), B.lists(B.signed(own), counts[one], pa.int64()), pa.array(n)], names=["run", "windows", "n"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in B.blocks(batch.column("text")):
                found = B.words(block)
                _, _, content, heads, _ = _chosen(found, held.value, window, gram)
                row = found.row_of()[heads]
                own = batch.drop_columns(["text"]).slice(block.first, block.rows).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*[own.column(f"k{i}") for i in range(len(key))], pa.array((heads - found.bounds[row]).astype(np.int32)), pa.array(B.signed(content))], names=[*[f"k{i}" for i in range(len(key))], "start", "run"])

    slim = docs.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(key)], F.col(f"`{text}`").alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    # read three times below, so written once: the texts are hashed for it only once
    runs = cut(slim.select("text").mapInArrow(contents, "run long, windows array<long>, n long").groupBy("run", "windows").agg(F.sum("n").alias("n")))
    counted = runs.select("n", F.explode("windows").alias("window")).groupBy("window").agg(F.sum("n").alias("c")).where("c > 1").select("window")
    # every window of a run that occurs twice is repeated; a run that occurs once asks for each of its windows
    once = runs.where("n = 1").select("run", F.posexplode("windows").alias("i", "window")).join(counted, "window").groupBy("run").agg(F.sum(F.expr("shiftleft(1L, i)")).alias("mask"))
    masks = cut(once.unionByName(runs.where("n > 1").select("run", F.expr("shiftleft(1L, size(windows)) - 1").alias("mask"))))
    forget(runs)
    at = slim.mapInArrow(places, f"{kinds}, start int, run long").join(masks, "run")
    return at.groupBy(*[f"k{i}" for i in range(len(key))]).agg(F.collect_list(F.struct("start", "mask")).alias("hits"))


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """key, n_words, n_removed and kept (the other words, joined by one space) for each row of docs.

    Words are runs without ASCII white space. Windows are judged on the input, those of the row itself included, and
    repeated rows count as occurrences. Null and empty texts have no words; texts shorter than a window lose none.
    """
    if window - gram + 1 > 62:
        raise ValueError("a run of windows must fit a mask of 62 bits")
    small_batches(docs.sparkSession)
    body = docs.select(F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("th"), F.col(f"`{text}`").alias("body"))
    hits = repeated_spans(body, ["id", "th"], "body", window, gram).withColumnRenamed("k0", "hid").withColumnRenamed("k1", "hth")
    joined = body.join(hits, F.col("id").eqNullSafe(F.col("hid")) & (F.col("th") == F.col("hth")), "left").select("id", "body", "hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in B.blocks(batch.column("body")):
                found = B.words(block)
                mine = batch.column("hits").slice(block.first, block.rows)
                size = mine.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = mine.flatten()
                start = flat.field("start").to_numpy(zero_copy_only=False) + np.repeat(found.bounds[:-1], size)
                mask = flat.field("mask").to_numpy(zero_copy_only=False)
                edge = np.zeros(len(found.hashes) + 1, np.int64)
                for i in range(window - gram + 1):
                    s = start[(mask >> i & 1) == 1] + i
                    edge += np.bincount(s, minlength=len(edge)) - np.bincount(s + window, minlength=len(edge))
                gone = np.cumsum(edge)[:-1] > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = np.diff(total[found.bounds])
                # bytes of the kept words, each with the byte after it, which becomes a space; then no space at a row's end
                keep = np.flatnonzero(~gone)
                inside = np.zeros(len(block.data) + 2, np.int8)
                ends = np.repeat(block.offsets[1:], np.diff(found.bounds))[keep]
                stop = np.minimum(found.ends[keep] + 1, ends)
                inside[found.starts[keep]] += 1
                np.subtract.at(inside, stop, 1)
                data = block.data.copy()
                spaces = found.ends[keep][found.ends[keep] < ends]
                data[spaces] = 32
                taken = np.cumsum(inside[:-2], dtype=np.int8) > 0
                row = np.searchsorted(found.bounds, keep, side="right") - 1
                last = np.flatnonzero(np.diff(row, append=-1))
                tail = found.ends[keep][last]
                taken[tail[tail < ends[last]]] = False
                size = np.concatenate([[0], np.cumsum(taken)])[block.offsets]
                kept = pa.LargeStringArray.from_buffers(block.rows, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(data[taken])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(block.first, block.rows), pa.array(np.diff(found.bounds)), pa.array(removed), kept], names=["id", "n_words", "n_removed", "kept"])

    kind = body.schema["id"].dataType.simpleString()
    return joined.mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept string").withColumnRenamed("id", key)
