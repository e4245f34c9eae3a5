"""JSON arrays of objects, read in splits.

A split begins anywhere, perhaps inside a string, so what its braces mean is not known until everything before it is read.
But a piece of text only changes a small state: whether it is in a string, whether the next character is escaped, and how
deep it is. What a split does to each state is found for all splits at once, those effects are composed in order (one short
row a split), and then every split knows the state in which it begins and can cut its records.

Splits are cut at closing braces, the only place where a record can end, by the text source's own line separator. Records
within a split go out at once; the pieces of a record that lies over several splits are put together by number.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
_STRING = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*', re.S)
_MARK = re.compile(r'["{}\[\]]')
_DEEPER = {"{": 1, "[": 1, "}": -1, "]": -1}


def scan(text: str, state: int, depth: int) -> tuple[int, int]:
    """State and depth behind a text."""
    at = 0
    if state == ESCAPED and text:
        at, state = 1, INSIDE
    while at < len(text):
        if state == INSIDE:
            at = _STRING.match(text, at).end()
            if at == len(text):
                return INSIDE, depth
            if text[at] == "\\":  # the last character
                return ESCAPED, depth
            at, state = at + 1, OUTSIDE
        elif m := _MARK.search(text, at):
            at = m.end()
            if m[0] == '"':
                state = INSIDE
            else:
                depth += _DEEPER[m[0]]
        else:
            break
    return state, depth


def file_key(path: str) -> tuple[int, str]:
    """What files sort by: numbered parts by their number, then names."""
    m = re.match(r"part-(\d+)", path.rsplit("/", 1)[-1])
    return (int(m[1]) if m else -1), path


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[str, int, str]]:
    """File, split and text of each row, with the brace that ended it. What stands behind the last one gets a brace too many, which ends nothing."""
    for file, at, text in zip(batch.column("file").to_pylist(), batch.column("at").to_pylist(), batch.column("value").to_pylist(), strict=True):
        yield file, at, text + "}"


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each split: for each of the three states what it becomes, how the depth grows, and how many rows end at which depth outside strings."""
    key: tuple[str, int] | None = None
    now: list[list] = []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([json.dumps(now)])], names=["file", "at", "effect"])

    for batch in batches:
        for file, at, text in _rows(batch):
            if (file, at) != key:
                if key is not None:
                    yield row()
                key, now = (file, at), [[s, 0, {}] for s in (OUTSIDE, INSIDE, ESCAPED)]
            for one in now:
                one[0], one[1] = scan(text, one[0], one[1])
                if one[0] == OUTSIDE:
                    one[2][one[1]] = one[2].get(one[1], 0) + 1
    if key is not None:
        yield row()


def _composed(rows: list) -> tuple[dict[tuple[str, int], tuple[int, int, int]], dict[str, tuple[int, int]]]:
    """State, depth and records so far at the beginning of each split; each file's first number and how many records it has."""
    starts, files, state, depth, total = {}, {}, OUTSIDE, 0, 0
    for r in sorted(rows, key=lambda r: (file_key(r["file"]), r["at"])):
        if r["file"] not in files:
            files[r["file"]], state, depth = (total, 0), OUTSIDE, 0
        first, own = files[r["file"]]
        starts[r["file"], r["at"]] = state, depth, own
        after, deeper, ends = json.loads(r["effect"])[state]
        ended = ends.get(str(1 - depth), 0)  # an object in the array has ended where the depth is 1
        files[r["file"]], total = (first, own + ended), total + ended
        state, depth = after, depth + deeper
    return starts, files


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """(source_index, record): the texts of the objects in JSON arrays, numbered over all files.

    ``path`` is a file, a folder or a pattern; numbered parts go by number, other files by name. Blank files and empty
    arrays hold no records. A file that is no array, or whose array holds anything but objects, is an error.
    """
    text = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    held = spark.sparkContext.broadcast(_composed(text.mapInArrow(_effects, "file string, at long, effect string").collect()))  # one row a split

    def pieces(inner: bool) -> DataFrame:
        """Records that lie within a split, or the pieces of those that may not: each split's first and last."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            starts, files = held.value
            key: tuple[str, int] | None = None
            state = depth = number = 0
            parts: list[str] = []
            first = True
            out: list[tuple[int, int, str]] = []

            def flushed() -> pa.RecordBatch:
                columns = list(zip(*out, strict=True)) if out else [(), (), ()]
                out.clear()
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["source_index", "at", "record"])

            def ended() -> None:
                begin, count = files[key[0]]
                if parts and number < count:  # behind the last record stands the end of the array
                    out.append((begin + number, key[1], "".join(parts)))

            for batch in batches:
                for file, at, body in _rows(batch):
                    if (file, at) != key:
                        if not inner and key is not None:
                            ended()
                        key, parts, first = (file, at), [], True
                        state, depth, number = starts[key]
                        if at == 0 and body.lstrip("\ufeff \t\r\n")[:1] not in ("[", "}"):
                            raise ValueError(f"a JSON array expected in {file}")
                    state, depth = scan(body, state, depth)
                    parts.append(body)
                    if state == OUTSIDE and depth == 1:
                        if inner != first:
                            ended()
                        number, parts, first = number + 1, [], False
                yield flushed()
            if not inner and key is not None:
                ended()
            yield flushed()

        return text.mapInArrow(run, "source_index long, at long, record string")

    joined = pieces(False).groupBy("source_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "record"))), lambda x: x["record"]), "").alias("record"))  # one record
    bare = F.regexp_replace("record", "^[\ufeff\\s\\[,]+", "")
    every = pieces(True).select("source_index", "record").unionByName(joined)
    return every.select("source_index", F.when(bare.startswith("{"), bare).otherwise(F.raise_error(F.lit("only objects are expected in the array")).cast("string")).alias("record"))
