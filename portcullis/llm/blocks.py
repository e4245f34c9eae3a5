"""Words, lines and rolling hashes of Arrow text columns, as flat numpy arrays.

All functions work on UTF-8 bytes: the separators of every operator are ASCII, so no decoding is needed.
A null text counts as an empty one. Memory is bounded by ``CHUNK`` bytes of text plus eight bytes a word,
however long a single document is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text turned into arrays at once; a longer document is one block but is hashed chunk by chunk.
BLOCK = 1 << 20
CHUNK = (1 << 20) - 1

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


_BASE_INV = np.uint64(_inverse(int(_BASE)))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(12, (n - 1).bit_length())
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiplications, three shifts); a bijection."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def byte_table(separators: bytes) -> np.ndarray:
    """Boolean table of 256: True for bytes that belong to words."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: ``[^\x20\x09-\x0D]+``
SPACED = byte_table(bytes([0x20, *range(0x09, 0x0E)]))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z; so the upper-case letters belong to words here.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Lines: everything but LF.
LINES = byte_table(b"\n")

SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 32


@dataclass
class Block:
    """Some whole rows of a batch: their bytes on end, and where each begins."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[Block]:
    """Cut a text column into runs of rows of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, where, held = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        lo, hi = offsets[first], offsets[last]
        yield Block(first, data[lo:hi], offsets[first : last + 1] - lo)
        first = last


@dataclass
class Words:
    """The words of a block in order: byte spans, 64-bit hashes, and ``bounds[i]:bounds[i+1]`` for row i."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def _chunk_ends(data: np.ndarray, table: np.ndarray, chunk: int) -> Iterator[tuple[int, int]]:
    lo, n = 0, len(data)
    while lo < n:
        hi = min(lo + chunk, n)
        if hi < n:
            gaps = np.flatnonzero(~table[data[lo:hi]])
            if len(gaps):
                hi = lo + int(gaps[-1]) + 1
            else:  # one word longer than a chunk: to its end
                while hi < n:
                    more = np.flatnonzero(~table[data[hi : hi + chunk]])
                    if len(more):
                        hi += int(more[0]) + 1
                        break
                    hi = min(hi + chunk, n)
        yield lo, hi
        lo = hi


def prefix(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of ``values[i] * base**i`` and the inverse powers that move a difference to the origin."""
    up, down = _POWERS.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return sums, down


def words(block: Block, table: np.ndarray = SPACED, fold: np.ndarray = SAME, chunk: int = CHUNK) -> Words:
    """Words of each row (runs of bytes where ``table`` holds); a word never spans two rows."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    edges = block.offsets
    for lo, hi in _chunk_ends(block.data, table, chunk):
        seg = block.data[lo:hi]
        inside = table[seg]
        before = np.zeros(len(seg), bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(seg), bool)
        after[:-1] = inside[1:]
        cuts = edges[(edges > lo) & (edges < hi)] - lo
        before[cuts] = False
        after[cuts - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        sums, down = prefix(fold[seg].astype(np.uint64) + np.uint64(1))
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        parts.append((starts + lo, ends + lo, hashes))
    if parts:
        starts, ends, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    else:
        starts, ends, hashes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return Words(starts, ends, hashes, np.searchsorted(starts, edges, side="left"))


def windows(found: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``k`` words from each word on, and whether the row has that many left."""
    n = len(found.hashes)
    whole = np.zeros(n, bool)
    out = np.zeros(n, np.uint64)
    if n < k:
        return out, whole
    sums, down = prefix(found.hashes)
    m = n - k + 1
    out[:m] = mix((sums[k:] - sums[:m]) * down[:m] + np.uint64(k))
    ends = np.repeat(found.bounds[1:], np.diff(found.bounds))
    whole[:m] = np.arange(k, n + 1) <= ends[:m]
    return out, whole


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least of ``values[i:i+width]``, for each i with that many left."""
    best = np.arange(len(values))
    have = 1
    while have < width:
        step = min(have, width - have)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        have += step
    return best


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over a partition, after which Arrow's free memory goes back to the system, so that idle workers stay small."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return whole


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, on end."""
    total = int(counts.sum())
    first = np.repeat(np.cumsum(counts) - counts, counts)
    return np.arange(total) - first


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and a count for each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return x.view(np.int64)
