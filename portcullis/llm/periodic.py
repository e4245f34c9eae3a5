"""Periodic stretches of words, by bit-parallel lags.

The words of a text get small ids, and bit ``b`` of all ids is one big integer, a plane. For a lag ``q`` each plane is
XORed with itself shifted by ``q`` and the results are ORed: a zero bit ``i`` says that words ``i`` and ``i + q`` are the
same. A run of period ``q`` is a stretch of such zeros, and AND with shifted copies, doubled each time, leaves the
beginnings of the stretches that are long enough. Everything about one text is a few operations on integers as long as
the text, so a lag costs words / 64 machine steps a plane.

Lags up to ``EVERY`` are all tried. A longer one is tried where it can hold a run at all: a run of period q, with
B <= q < 2B, has four periods, so it holds a window of 2B words that begins at a multiple of B and whose next occurrence
from B words on begins exactly q words later (no sooner, for q is its smallest period). Those next occurrences are
looked up by the windows' hashes for B = EVERY, 2 EVERY, ..., so no run is lost and the work for a text of n words does
not grow with n squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .lineage import small_batches

LEAST, TIMES = 6, 4
EVERY = 1024
#: Planes after which a lag without a long stretch is left.
FEW = 4


def _planes(ids: np.ndarray) -> list[int]:
    bits = range(int(ids.max()).bit_length())
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in bits]


def _beginnings(same: int, need: int) -> int:
    """Bits from which on ``need`` bits are set."""
    have = 1
    while have < need and same:
        step = min(have, need - have)
        same &= same >> step
        have += step
    return same


def _long_lags(hashes: np.ndarray, times: int) -> set[int]:
    """The lags from EVERY on at which a run is possible."""
    n, out = len(hashes), set()
    step = EVERY
    while step * times <= n:
        sums, down = B.prefix(hashes)
        last = n - 2 * step + 1
        window = (sums[2 * step :] - sums[:last]) * down[:last]
        heads = np.arange(0, last, step)
        values, mine = np.unique(window[heads], return_inverse=True)
        slot = np.minimum(np.searchsorted(values, window), len(values) - 1)
        at = np.flatnonzero(values[slot] == window)
        places = np.sort(slot[at] * np.int64(n) + at)  # by value, then place
        asked = mine * np.int64(n) + heads + step
        next_one = np.searchsorted(places, asked)
        inside = next_one < len(places)
        gap = places[next_one[inside]] - asked[inside] + step
        out.update(gap[gap < 2 * step].tolist())
        step *= 2
    return out


def runs_of(hashes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run among the words with these hashes, by start, then period."""
    n = len(hashes)
    if n < least:
        return []
    ids = np.unique(hashes, return_inverse=True)[1]
    planes, full = _planes(ids), (1 << n) - 1
    lags: list[int] | range = range(1, min(n // times, EVERY) + 1)
    if n // times > EVERY:
        lags = sorted({*lags, *(q for q in _long_lags(hashes, times) if q * times <= n)})
    found: dict[tuple[int, int], int] = {}
    for q in lags:
        need = max(least, times * q) - q
        if n - q < need:
            break
        mask, differ, begins = full >> q, 0, 0
        for some in (planes[:FEW], planes[FEW:]):
            for p in some:
                differ |= p ^ (p >> q)
            begins = _beginnings(mask & ~differ, need)
            if not begins:
                break
        if not begins:
            continue
        bits = np.unpackbits(np.frombuffer(begins.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little").astype(np.int8)
        edges = np.diff(bits, prepend=np.int8(0), append=np.int8(0))
        for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
            found.setdefault((a, b - a + need - 1 + q), q)  # lags rise, so the first that has this stretch is its smallest period
    return sorted((start, length, q) for (start, length), q in found.items())


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest exact length / period; of those the first, then the one of smallest period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None


def _repeats(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Words that lie in a run behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge)[:-1] > 0


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Some words of a text, in order, joined by one space."""
    if not len(starts):
        return b""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    taken = np.cumsum(inside[:-1], dtype=np.int8) > 0
    data = data.copy()
    data[ends[:-1]] = 32
    taken[ends[:-1]] = True
    return data[taken].tobytes()


def _structs(rows: list[tuple[int, int, int] | None]) -> pa.StructArray:
    flat = np.array([r or (0, 0, 0) for r in rows], np.int64).reshape(-1, 3)
    return pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=["start", "length", "period"], mask=pa.array([r is None for r in rows], pa.bool_()))


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """key, n_words, runs (array of start, length, period), best (the most periodic run) and kept, for each row of docs.

    Words are runs without ASCII white space, numbered from 0; words are the same if their 64-bit hashes are. A run is a
    stretch of words of smallest period q and at least ``max(least, times * q)`` words that no neighbour extends; runs of
    different periods may overlap or lie within each other. kept holds the words that no run has behind its first period,
    joined by one space. best is the run of greatest length / period, then smallest start and period; null without runs.

    Null and empty texts have no words, no runs and an empty kept; fewer than ``least`` words hold no run. Rows are
    independent: keys may be null or repeat, and other columns, whatever their names, are not read. No shuffle: a text is
    one worker's, in memory of some 20 bytes a word.
    """
    if times < 4:
        raise ValueError("a run has at least four periods, or long lags could be missed")
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in B.blocks(batch.column("text")):
                found = B.words(block)
                runs, best, kept = [], [], []
                for i in range(block.rows):
                    lo, hi = found.bounds[i], found.bounds[i + 1]
                    mine = runs_of(found.hashes[lo:hi], least, times)
                    first, last = block.offsets[i], block.offsets[i + 1]
                    if mine:
                        stay = np.flatnonzero(~_repeats(hi - lo, mine)) + lo
                        kept.append(_joined(block.data[first:last], found.starts[stay] - first, found.ends[stay] - first))
                    else:
                        kept.append(b" ".join(block.data[first:last].tobytes().split()))
                    runs.append(mine)
                    best.append(_best(mine))
                edges = np.zeros(block.rows + 1, np.int32)
                np.cumsum([len(x) for x in runs], out=edges[1:])
                listed = pa.ListArray.from_arrays(pa.array(edges), _structs([r for x in runs for r in x]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(block.first, block.rows), pa.array(np.diff(found.bounds)), listed, _structs(best), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["id", "n_words", "runs", "best", "kept"],
                )

    kind, one = slim.schema["id"].dataType.simpleString(), "struct<start:bigint,length:bigint,period:bigint>"
    return slim.mapInArrow(run, f"id {kind}, n_words long, runs array<{one}>, best {one}, kept string").withColumnRenamed("id", key)
