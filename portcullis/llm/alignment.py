"""Tokens of two tokenizers aligned: which ids of one stand beside which of the other, and in how many documents.

Byte offsets where a token of A and one of B both end cut a text's tokens into groups, and all pairs of an A and a B
token of one group are linked. In how many documents a pair of ids is linked is a count over the whole corpus; a document
then asks for the counts of its own pairs.

That is done by a cogroup of postings. A worker aligns its documents a chunk at a time (at most ``CHUNK_DOCS`` documents
and about ``CHUNK_POSTINGS`` pairs) and posts, for each pair of the chunk, the documents that hold it with their
multiplicities, packed. Postings and pre-aggregated counts are shuffled by pair as sorted streams that spill and meet in a
merge join: the join takes a posting at a time, and Spark may split the postings of a frequent pair over many tasks, so
no pair is a task's burden. The greatest count of an A id is found beside it, over at most as many rows as B has ids.
Postings then go back to their chunk, where the contributions are summed by document.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from . import blocks as B
from .lineage import cut, small_batches
from .tokens import Encoder

CHUNK_DOCS = 1 << 14
CHUNK_POSTINGS = 1 << 21
#: A posting is its document's number in the chunk and a multiplicity of up to 16 bits; a greater one is several postings.
_MOST = (1 << 16) - 1
#: Distinct pieces of B kept by a worker.
KEPT = 1 << 19


class _Plain(Encoder):
    """Ids of A; strings of special tokens are plain text."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True


def _byte_level() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte: itself if printable, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class _Pieces:
    """Ids of B, each distinct piece of text encoded once a worker.

    The model puts a space before a text and no entry of its vocabulary has a space behind another character, so no merge
    crosses the beginning of a run of spaces and the ids of a text are those of its pieces on end. A vocabulary that has
    such an entry, or a model that changes its input, is asked for whole texts.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        crossing = any("▁" in x.lstrip("▁") for x in names)
        same = " a  bﬁ ½ "
        self.whole = crossing or self.model.decode(self.model.encode(same)) != same
        self.space = [self.model.piece_to_id("▁")]
        self._empty()

    def _empty(self) -> None:
        self.place: dict[int, int] = {}  # by hash, the number of a known piece; its ids are flat[edges[i] : edges[i + 1]]
        self.edges, self.flat = array("q", [0]), array("i")

    def encode(self, block: B.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows on end, and how many each has. Each row begins with a space."""
        data, edges = block.data, block.offsets
        space = data == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        if self.whole:
            begins[:] = False
        begins[edges[:-1]] = True
        at = np.flatnonzero(begins)
        ends = np.append(at[1:], len(data))
        sums, down = B.prefix(data.astype(np.uint64) + np.uint64(1))
        hashes = B.mix((sums[ends] - sums[at]) * down[at] + (ends - at).astype(np.uint64))
        values, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.place) > KEPT:
            self._empty()
        held = data.tobytes()
        new = [(i, h) for i, h in enumerate(values.tolist()) if h not in self.place]
        if new:
            places = one[[i for i, _ in new]]
            texts = [held[a + 1 : b].decode("utf-8", "replace") for a, b in zip(at[places].tolist(), ends[places].tolist(), strict=True)]
            for (_, h), text, ids in zip(new, texts, self.model.encode(texts, num_threads=1), strict=True):
                self.place[h] = len(self.edges) - 1
                self.flat.extend(ids if text else self.space)  # asked for nothing, the model leaves out the space
                self.edges.append(len(self.flat))
        mine = np.array([self.place[h] for h in values.tolist()], np.int64)
        known, kept = np.frombuffer(self.edges, np.int64), np.frombuffer(self.flat, np.int32)
        first, counts = known[mine], known[mine + 1] - known[mine]
        each = counts[back]
        flat = kept[np.repeat(first[back], each) + B.ragged(each)].astype(np.int64)
        del known, kept  # the arrays grow again
        row = np.searchsorted(edges, at, side="right") - 1
        return flat, np.bincount(row, each, block.rows).astype(np.int64)


class _Lengths:
    """Bytes of the ids of one vocabulary."""

    def __init__(self, entries: list[bytes]) -> None:
        self.size = np.array([len(x) for x in entries], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        each = self.size[ids]
        return self.flat[np.repeat(self.first[ids], each) + B.ragged(each)]


class Aligner:
    """Aligns blocks of texts; made once a worker."""

    def __init__(self, a: str, b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = _Plain(a), _Pieces(b)
        byte_of = _byte_level()
        vocab = self.a.tokenizer.get_vocab(with_added_tokens=False)
        names = [""] * (max(self.a.tokenizer.get_vocab().values()) + 1)
        for name, i in vocab.items():
            names[i] = name
        self.bytes_a, self.bytes_b = _Lengths([bytes(byte_of[c] for c in x) for x in names]), _Lengths(self.b.bytes)
        self.width = len(self.b.bytes)
        most = max(len(names), self.width)
        text = [str(i).encode() for i in range(most)]
        self.digits = np.array([len(x) for x in text], np.int64)
        self.decimal = np.zeros((most, int(self.digits.max()) + 1), np.uint8)
        for i, x in enumerate(text):
            self.decimal[i, : len(x)] = list(x)

    def _same(self, block: B.Block, lengths: _Lengths, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each row's ids give its bytes back, and where each id ends in its own row."""
        total = np.concatenate([[0], np.cumsum(lengths.size[ids])])
        first = np.cumsum(count) - count
        size = total[first + count] - total[first]
        want = np.diff(block.offsets)
        good = size == want
        if good.all():
            wrong = np.flatnonzero(lengths.of(ids) != block.data)
            good[np.searchsorted(block.offsets, wrong, side="right") - 1] = False
        else:
            for i in np.flatnonzero(good):
                good[i] = np.array_equal(lengths.of(ids[first[i] : first[i] + count[i]]), block.data[block.offsets[i] : block.offsets[i + 1]])
        return good, total[1:] - np.repeat(total[first], count)

    def align(self, block: B.Block, asked: np.ndarray) -> tuple[dict[str, np.ndarray | list[str]], np.ndarray, np.ndarray, np.ndarray]:
        """Figures of the block's rows, and of each row's linked pairs the row, the pair and its links. Rows not ``asked`` for have no tokens."""
        rows = block.rows
        ids_a, n_a = self.a.encode(block)
        ids_b, n_b = self.b.encode(block)
        ids_a = ids_a.astype(np.int64)
        good_a, end_a = self._same(block, self.bytes_a, ids_a, n_a)
        good_b, end_b = self._same(block, self.bytes_b, ids_b, n_b)
        good = good_a & good_b & asked
        row_a, row_b = np.repeat(np.arange(rows), n_a), np.repeat(np.arange(rows), n_b)
        keep_a, keep_b = good[row_a], good[row_b]
        ids_a, row_a, end_a = ids_a[keep_a], row_a[keep_a], end_a[keep_a] + block.offsets[row_a[keep_a]]
        ids_b, row_b, end_b = ids_b[keep_b], row_b[keep_b], end_b[keep_b] + block.offsets[row_b[keep_b]]
        n_a, n_b = n_a * good, n_b * good
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        row_of = np.searchsorted(block.offsets, cuts, side="left") - 1
        figures = {
            "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(row_of, minlength=rows), "n_links": _summed(row_of, in_a * in_b, rows),
            "groups_sha256": self._digests(ids_a, group_a, n_a, ids_b, group_b, n_b, in_a, in_b),
        }
        # linked pairs, from the distinct ids of each group and side, so that a long group of few ids stays small
        sides = []
        for ids, group, width in ((ids_a, group_a, len(self.bytes_a.size)), (ids_b, group_b, self.width)):
            both, times = np.unique(group * width + ids, return_counts=True)
            sides.append((both // width, both % width, times))
        (ga, a, ta), (gb, b, tb) = sides
        partners = np.bincount(gb, minlength=len(cuts))
        first = np.cumsum(partners) - partners
        each = partners[ga]
        other = np.repeat(first[ga], each) + B.ragged(each)
        span = len(self.bytes_a.size) * self.width
        pairs = np.repeat(row_of[ga] * span + a * self.width, each) + b[other]
        links = np.repeat(ta, each) * tb[other]
        order = np.argsort(pairs, kind="stable")
        pairs, links = pairs[order], links[order]
        heads = np.flatnonzero(np.diff(pairs, prepend=-1))
        links = np.add.reduceat(links, heads) if len(heads) else links
        pairs = pairs[heads]
        return figures, pairs // span, pairs % span, links

    def _digests(self, ids_a, group_a, n_a, ids_b, group_b, n_b, in_a, in_b) -> list[str]:
        """Of each row SHA-256 of ``a1,a2|b1;a3|b2,b3``; empty for rows without tokens."""
        if not len(ids_a):
            return [""] * len(n_a)
        done_a, done_b = np.cumsum(in_a), np.cumsum(in_b)
        place_a = np.arange(len(ids_a)) + (done_b - in_b)[group_a]
        place_b = np.arange(len(ids_b)) + done_a[group_b]
        ids = np.empty(len(ids_a) + len(ids_b), np.int64)
        ids[place_a], ids[place_b] = ids_a, ids_b
        mark = np.full(len(ids), ord(","), np.uint8)
        mark[place_a[done_a - 1]] = ord("|")
        mark[place_b[done_b - 1]] = ord(";")
        size = self.digits[ids] + 1
        ends = np.cumsum(size)
        whole = np.empty(int(ends[-1]), np.uint8)
        step = 1 << 17
        for lo in range(0, len(ids), step):
            part = ids[lo : lo + step]
            written, n = self.decimal[part], self.digits[part]
            written[np.arange(len(part)), n] = mark[lo : lo + step]
            begin = int(ends[lo] - size[lo])
            flat = written[np.arange(written.shape[1]) <= n[:, None]]
            whole[begin : begin + len(flat)] = flat
        held, tokens = memoryview(whole), n_a + n_b
        last = np.concatenate([[0], ends])[np.cumsum(tokens)]  # byte behind each row's last token
        first = np.concatenate([[0], last[:-1]])
        return [hashlib.sha256(held[lo : hi - 1]).hexdigest() if n else "" for lo, hi, n in zip(first.tolist(), last.tolist(), tokens.tolist(), strict=True)]


def _summed(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of 64-bit integers by place."""
    out = np.zeros(size, np.int64)
    np.add.at(out, at, values)
    return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    if (a, b) not in _ALIGNERS:
        _ALIGNERS[a, b] = Aligner(a, b)
    return _ALIGNERS[a, b]


_FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def _posted(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a chunk in order, documents that hold each, entries of each, and the entries (document and links packed)."""
    row, pair, links = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(pair, kind="stable")
    row, pair, links = row[order], pair[order], links[order]
    heads = np.flatnonzero(np.diff(pair, prepend=-1))
    documents = np.diff(heads, append=len(pair))
    pieces = (links + _MOST - 1) // _MOST
    part = np.minimum(np.repeat(links, pieces) - B.ragged(pieces) * _MOST, _MOST)
    entries = (np.repeat(row, pieces) << 16 | part).astype(np.int32)
    return pair[heads], documents, np.add.reduceat(pieces, heads) if len(heads) else pieces, entries


def _encoded(a: str, b: str, kind: pa.DataType, docs: int, postings: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of two kinds: documents with their figures (pair is null) and the chunk's postings (row is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, number, row, count, parts = aligner(a, b), TaskContext.get().partitionId() << 32, 0, 0, []

        def flushed() -> Iterator[pa.RecordBatch]:
            if not parts:
                return
            pair, documents, size, entries = _posted(parts)
            edge = np.concatenate([[0], np.cumsum(size)])
            for lo in range(0, len(pair), 1 << 15):
                hi = min(lo + (1 << 15), len(pair))
                n = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, number)), pa.nulls(n, pa.int32()), pa.nulls(n, kind), *[pa.nulls(n, pa.int64()) for _ in _FIGURES], pa.nulls(n, pa.string()), pa.array(pair[lo:hi]), pa.array((pair[lo:hi] // tool.width).astype(np.int32)), pa.array(documents[lo:hi]), B.lists(entries[edge[lo] : edge[hi]], size[lo:hi], pa.int32())],
                    names=["chunk", "row", "id", *_FIGURES, "groups_sha256", "pair", "a", "documents", "entries"],
                )

        for batch in batches:
            asked = batch.column("asked").to_numpy(zero_copy_only=False)
            for block in B.blocks(batch.column("text")):
                if row and (row + block.rows > docs or count > postings):
                    yield from flushed()
                    number, row, count, parts = number + 1, 0, 0, []
                n = block.rows
                figures, rows, pairs, links = tool.align(block, asked[block.first : block.first + n])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, number)), pa.array(np.arange(row, row + n, dtype=np.int32)), batch.column("id").slice(block.first, n).cast(kind), *[pa.array(figures[x].astype(np.int64)) for x in _FIGURES], pa.array(figures["groups_sha256"]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32()))],
                    names=["chunk", "row", "id", *_FIGURES, "groups_sha256", "pair", "a", "documents", "entries"],
                )
                parts.append((rows + row, pairs, links))
                row, count = row + n, count + len(rows)
        yield from flushed()

    return run


def _contributions(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of a chunk with the sums over their links."""
    n = left.num_rows
    row = left.column("row").to_numpy()
    best, total = np.zeros(int(row.max()) + 1 if n else 0, np.int64), np.zeros(int(row.max()) + 1 if n else 0, np.int64)
    for batch in right.to_batches():
        entries = batch.column("entries")
        size = entries.value_lengths().to_numpy(zero_copy_only=False)
        flat = entries.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        at, links = flat >> 16, flat & _MOST
        np.add.at(total, at, links * np.repeat(batch.column("count").to_numpy(), size))
        np.add.at(best, at, links * np.repeat(batch.column("best").to_numpy(zero_copy_only=False), size))
    return pa.table([left.column("id"), *[left.column(x) for x in _FIGURES], pa.array(best[row]), pa.array(total[row]), left.column("groups_sha256")], names=["id", *_FIGURES, "n_best", "count_sum", "groups_sha256"])


def pair_counts(postings: DataFrame) -> DataFrame:
    """pair, a, count (documents that hold it) and best (whether no pair of its A id has a greater count)."""
    counted = postings.groupBy("a", "pair").agg(F.sum("documents").alias("count"))
    return counted.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))


def align(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text", chunk_docs: int = CHUNK_DOCS, chunk_postings: int = CHUNK_POSTINGS) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for each row of docs.

    a is the file of a byte-level BPE for ``tokenizers``, b a ``sentencepiece`` model that puts a space before its text;
    both are read by the workers. Texts are a space and the text; null and empty ones, and those that the bytes of either
    side's tokens do not give back, have no tokens: zeros and an empty groups_sha256. n_best counts links whose pair's
    count no other pair of the same A id exceeds (ties all count), count_sum adds up the pairs' counts over the links.
    Rows are documents of their own, so repeated rows count each and keys may be null or repeat; other columns, whatever
    their names, are not read. An empty table gives an empty one. A very long text is one worker's.
    """
    if not 0 < chunk_docs <= 1 << 15:
        raise ValueError("documents of a chunk are numbered by 15 bits")
    small_batches(docs.sparkSession)
    body = F.col(f"`{text}`")
    slim = docs.select(F.col(f"`{key}`").alias("id"), F.concat(F.lit(" "), F.coalesce(body, F.lit(""))).alias("text"), F.coalesce(body != "", F.lit(False)).alias("asked"))
    kind = slim.schema["id"].dataType
    name = kind.simpleString()
    figures = ", ".join(f"{x} long" for x in _FIGURES)
    made = cut(slim.mapInArrow(_encoded(a, b, to_arrow_type(kind), chunk_docs, chunk_postings), f"chunk long, row int, id {name}, {figures}, groups_sha256 string, pair long, a int, documents long, entries array<int>"))
    postings = made.where("pair is not null")
    counts = pair_counts(postings).select(F.col("pair").alias("of"), "count", "best")
    answered = postings.select("chunk", "pair", "entries").join(counts.hint("merge"), F.col("pair") == F.col("of")).select("chunk", "count", "best", "entries")
    held = made.where("pair is null").select(F.col("chunk").alias("within"), "row", "id", *_FIGURES, "groups_sha256")
    out = held.groupBy("within").cogroup(answered.groupBy("chunk")).applyInArrow(_contributions, f"id {name}, {figures}, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("id", key)
