"""A count-min sketch over a whole table: two saturating rows of cells, merged from sparse sketches of the partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B

ROWS = 2
_PAGE = 1 << 19
_FLUSH = 1 << 20
_MERGERS = 32
_SALTS = B.mix(np.arange(101, 101 + ROWS, dtype=np.uint64))


def _cells(keys: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (B.mix(keys ^ _SALTS[row]) % np.uint64(cells)).astype(np.int64)


def count_min(rows: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]], cells: int) -> np.ndarray:
    """For each row of the sketch a bitmap of the cells that count two or more.

    ``keys`` yields the 64-bit keys of a batch, one for each occurrence. The bitmaps take ROWS * cells / 8 bytes on
    the driver and wherever they are broadcast, whatever the input.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not sum(map(len, kept)):
                return
            own = np.concatenate(kept)
            kept.clear()
            for row in range(ROWS):
                cell, n = np.unique(_cells(own, row, cells), return_counts=True)
                value = ((cell % _PAGE) << 1 | (n > 1)).astype("<i4")
                page = cell // _PAGE
                cut = np.flatnonzero(np.diff(page, prepend=-1))
                held = [value[lo:hi].tobytes() for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(cell)], strict=True)]
                yield pa.RecordBatch.from_pydict({"row": pa.array([row] * len(cut), pa.int32()), "page": pa.array(page[cut], pa.int32()), "cells": pa.array(held, pa.binary())})

        for batch in batches:
            for own in keys(batch):
                kept.append(own)
                if sum(map(len, kept)) > _FLUSH:
                    yield from flush()
        yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row, page, held in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                counts = pages.setdefault((row, page), np.zeros(_PAGE, np.uint8))
                value = np.frombuffer(held, "<i4")
                cell = value >> 1
                counts[cell] = np.minimum(2, counts[cell] + 1 + (value & 1))
        for (row, page), counts in pages.items():
            yield pa.RecordBatch.from_pydict({"row": pa.array([row], pa.int32()), "page": pa.array([page], pa.int32()), "held": pa.array([np.packbits(counts > 1, bitorder="little").tobytes()], pa.binary())})

    merged = rows.mapInArrow(local, "row int, page int, cells binary").repartition(_MERGERS, "row", "page").mapInArrow(merge, "row int, page int, held binary")
    out = np.zeros((ROWS, max(cells, _PAGE) // 8), np.uint8)
    for r in merged.collect():
        out[r["row"], r["page"] * _PAGE // 8 : (r["page"] + 1) * _PAGE // 8] = np.frombuffer(r["held"], np.uint8)
    return out


def repeated(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the estimated count is two or more; never false for a key that occurs twice."""
    out = np.ones(len(keys), bool)
    cells = 8 * bits.shape[1]
    for row in range(ROWS):
        at = _cells(keys, row, cells)
        out &= bits[row][at >> 3] >> (at & 7).astype(np.uint8) & np.uint8(1) != 0
    return out
