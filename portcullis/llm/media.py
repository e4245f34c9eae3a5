"""Media columns: texts stored as lossless WebP sample planes and read back.

A payload is the bytes of a text with 255s up to a positive multiple of 576. It is cut into planes of 48 columns
and at most 48 rows, one byte a pixel; the files of a payload lie on end in one binary value. Working memory is
bounded by ``GROUP`` planes read and ``ENCODED`` planes written at a time, however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import webp

PAD = 255
PLANE = webp.SIDE * webp.SIDE
GROUP = 4096
ENCODED = 512  # planes encoded at once
_BLOCK = 1 << 23


def _payload_sizes(n: np.ndarray) -> np.ndarray:
    return np.maximum(1, -(-n // webp.UNIT)) * webp.UNIT


def _runs(sizes: np.ndarray) -> Iterator[slice]:
    for lo in range(0, len(sizes), ENCODED):
        yield slice(lo, lo + ENCODED)


def _joined(parts: list[np.ndarray], kind: type = np.uint8) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def encode_block(block: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """Media of the rows of a block, on end, and the bytes of each."""
    own = np.diff(block.offsets)
    padded = _payload_sizes(own)
    payload = np.full(int(padded.sum()), PAD, np.uint8)
    at = np.cumsum(padded) - padded
    for lo, n, to in zip(block.offsets[:-1].tolist(), own.tolist(), at.tolist(), strict=True):
        payload[to : to + n] = block.data[lo : lo + n]
    planes = -(-padded // PLANE)
    sizes = np.full(int(planes.sum()), PLANE)
    last = np.cumsum(planes) - 1
    sizes[last] = padded - (planes - 1) * PLANE
    tails = np.zeros(len(sizes), np.int64)
    tails[last] = padded - own
    starts = np.cumsum(sizes) - sizes
    out, lengths = [], []
    for run in _runs(sizes):
        lo = starts[run][0]
        data, n = webp.encode_planes(payload[lo : lo + int(sizes[run].sum())], sizes[run], tails[run])
        out.append(data)
        lengths.append(n)
    return _joined(out), np.add.reduceat(_joined(lengths, np.int64), np.cumsum(planes) - planes)


def decode_block(block: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """Samples of the media of a block's rows, on end, and the number of each."""
    data = block.data
    spans, files = [], []
    for lo, hi in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True):
        own = webp.file_spans(data[lo:hi])
        spans += [(lo + a, lo + b) for a, b in own]
        files.append(len(own))
    out, counts = [], []
    for lo in range(0, len(spans), GROUP):
        part = spans[lo : lo + GROUP]
        first, end = part[0][0], part[-1][1]
        samples, n = webp.decode_planes(data[first:end], [(a - first, b - first) for a, b in part])
        out.append(samples)
        counts.append(n)
    total = np.zeros(len(spans) + 1, np.int64)
    np.cumsum(_joined(counts, np.int64), out=total[1:])
    edge = np.zeros(len(files) + 1, np.int64)
    np.cumsum(files, out=edge[1:])
    return _joined(out), np.diff(total[edge])


def _with(batch: pa.RecordBatch, block: B.Block, **more: pa.Array) -> pa.RecordBatch:
    own = batch.slice(block.first, block.rows)
    kept = [i for i, name in enumerate(own.schema.names) if not name.startswith("_in")]
    return pa.RecordBatch.from_arrays([*[own.column(i) for i in kept], *more.values()], names=[*[own.schema.names[i] for i in kept], *more])


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (of the text) and media (WebP files on end) for each row; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in B.blocks(batch.column("_in"), _BLOCK):
                yield _with(batch, block, n_bytes=pa.array(np.diff(block.offsets)), media=_binary(*encode_block(block)))

    slim = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_in"))
    return slim.mapInArrow(run, f"`{key}` {slim.schema[key].dataType.simpleString()}, n_bytes long, media binary")


def load(stored: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """key, pixels (the samples, row by row) and feature (shares of sixteen brightness bands, two hex digits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in B.blocks(batch.column("_in"), _BLOCK):
                samples, counts = decode_block(block)
                bands = np.zeros((len(counts), 16), np.int64)
                at = 0
                for i, n in enumerate(counts.tolist()):
                    bands[i] = np.bincount(samples[at : at + n] >> 4, minlength=16)
                    at += n
                shares = (255 * bands // np.maximum(1, counts)[:, None]).astype(np.uint8)
                yield _with(batch, block, media=batch.column("_in").slice(block.first, block.rows), pixels=_binary(samples, counts), feature=pa.array([r.tobytes().hex() for r in shares]))

    others = [c for c in stored.columns if c not in (media, "pixels", "feature")]
    slim = stored.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{media}`").alias("_in"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(run, f"{kinds}, media binary, pixels binary, feature string")
