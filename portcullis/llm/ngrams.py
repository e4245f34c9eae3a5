"""Language-model scoring with a log-frequency Bloom filter.

The filter holds, for each word and each word pair of the training rows, the entries (n-gram, 1) .. (n-gram, q) with q
the quantised logarithm of its count; a count is read back by probing q = 1, 2, ... until an entry is missing, so it is
never underestimated. It has ``BITS_EACH`` bits an entry, so it grows with the corpus and no n-gram is left out. No bound
on its size exists, so it isn't broadcast whole: it is cut by hash into buckets, each worker holds the segments of its own
buckets, and the probes travel to them.

Rows are read in chunks of about ``CHUNK`` tokens. A chunk sends every bucket the sorted hashes of the distinct words
and pairs it has there, with their counts in its training rows. The bucket adds the counts, fills its segment, probes it
for all the chunks asked, and answers with a byte an n-gram, and with the exact counts of words. The chunk's texts meet
the answers: the buckets are ranges of the hashes, so the answers in their order belong to the chunk's sorted hashes.

p(w | u) = MIX * c(u w) / c(u) + (1 - MIX) * (c(w) + 0.1) / (N + 0.1 (V + 1)), counts from the filter;
p(w | u) is the second term's fraction alone where u has no entry. The base score takes the exact counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .lineage import cut, parts, small_batches

MIX = 0.2
BITS_EACH, PROBES = 12, 4
CHUNK = 1 << 20
END, START = (B.mix(np.array([x], np.uint64))[0] for x in (0x656E64, 0x7374617274))
#: Steps of the quantised logarithm to each doubling: words are finer than pairs.
STEPS = {1: 2, 2: 1}
#: Bytes of text hashed at once, and bytes of packed n-grams handed on at once.
_BYTES, _SENT = (1 << 18) - 1, 1 << 20
#: How a sorted hash is packed: bits let go from its low end, and bytes of its distance from the one before.
_PACKED = {1: (0, 6), 2: (16, 4)}


def tokens(block: B.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of the rows with an end after each row, the pairs' hashes of 48 bits, and the rows' bounds."""
    found = B.words(block, B.SPACED, B.LOWER, _BYTES)
    own = np.insert(found.hashes, found.bounds[1:], END)
    bounds = found.bounds + np.arange(block.rows + 1)
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[bounds[:-1]] = START
    return own, B.mix(before * np.uint64(0xD6E8FEB86659FD93) + own) >> np.uint64(16) << np.uint64(16), bounds


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _narrow(values: np.ndarray, width: int) -> tuple[bytes, np.ndarray]:
    """Values in ``width`` bytes each, and apart those that need more."""
    top = np.uint64((1 << 8 * width) - 1)
    return np.minimum(values, top).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), values[values >= top].astype("<u8")


def _wide(data: bytes, at: int, n: int, width: int, more: np.ndarray) -> np.ndarray:
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(-1, width)
    out = raw.view("<u8").ravel()
    out[out == np.uint64((1 << 8 * width) - 1)] = more
    return out


def _pack(hashes: np.ndarray, counts: np.ndarray, gram: int) -> bytes:
    """Sorted hashes as distances, in 6 bytes or 4, and counts in one, with what needs more apart."""
    drop, width = _PACKED[gram]
    steps, far = _narrow(np.diff(hashes >> np.uint64(drop), prepend=np.uint64(0)), width)
    few, many = _narrow(counts.astype(np.uint64), 1)
    return np.array([len(hashes), len(far), len(many)], "<u4").tobytes() + far.tobytes() + many.tobytes() + steps + few


def _unpack(data: bytes, gram: int) -> tuple[np.ndarray, np.ndarray]:
    drop, width = _PACKED[gram]
    n, far, many = np.frombuffer(data, "<u4", 3).tolist()
    at = 12 + 8 * (far + many)
    steps = _wide(data, at, n, width, np.frombuffer(data, "<u8", far, 12))
    counts = _wide(data, at + n * width, n, 1, np.frombuffer(data, "<u8", many, 12 + 8 * far))
    return np.cumsum(steps, dtype=np.uint64) << np.uint64(drop), counts.astype(np.int64)


def _merged(parts_: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and their summed counts."""
    hashes, counts = (np.concatenate(x) for x in zip(*parts_, strict=True))
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], np.add.reduceat(counts[order], first) if len(hashes) else counts


def quantise(counts: np.ndarray, gram: int) -> np.ndarray:
    return 1 + np.floor(STEPS[gram] * np.log2(counts) + 1e-9).astype(np.int64)


def typical(q: np.ndarray, gram: int) -> np.ndarray:
    """The geometric middle of the counts that have a quantised count; 0 for 0."""
    low = 2.0 ** ((q - 1) / STEPS[gram])
    high = np.maximum(low, np.ceil(2.0 ** (q / STEPS[gram]) - 1e-9) - 1)
    return np.where(q > 0, np.sqrt(np.ceil(low - 1e-9) * high), 0.0)


def _places(hashes: np.ndarray, level: int, gram: int, size: int) -> Iterator[np.ndarray]:
    """Bits of the entries (n-gram, level) within a segment of ``size`` bits."""
    key = B.mix((hashes >> np.uint64(16)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level * 4 + gram))
    step = B.mix(key) | np.uint64(1)
    for k in range(PROBES):
        yield ((key + np.uint64(k) * step) % np.uint64(size)).astype(np.int64)


class Segment:
    """The part of the filter that holds the words (gram 1) and pairs (gram 2) of one bucket; counts are 1 or more."""

    def __init__(self, grams: dict[int, tuple[np.ndarray, np.ndarray]], bits_each: int = BITS_EACH) -> None:
        quantised = {gram: quantise(counts, gram) for gram, (_, counts) in grams.items()}
        self.size = max(64, bits_each * sum(int(q.sum()) for q in quantised.values()))
        self.top = {gram: int(q.max(initial=0)) for gram, q in quantised.items()}
        bits = np.zeros(self.size, bool)
        for gram, q in quantised.items():
            for level in range(1, self.top[gram] + 1):
                for place in _places(grams[gram][0][q >= level], level, gram, self.size):
                    bits[place] = True
        self.bits = np.packbits(bits, bitorder="little")

    def levels(self, hashes: np.ndarray, gram: int) -> np.ndarray:
        """Quantised counts by repeated probes; 0 for an n-gram without entries."""
        out = np.zeros(len(hashes), np.uint8)
        live, level = np.arange(len(hashes)), 0
        while len(live) and level < self.top[gram]:  # no count is quantised higher
            level += 1
            own = hashes[live]
            there = np.ones(len(live), bool)
            for place in _places(own, level, gram, self.size):
                there &= self.bits[place >> 3] >> (place & 7).astype(np.uint8) & np.uint8(1) != 0
            live = live[there]
            out[live] = level
        return out


def _found(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Index of each hash in a sorted table, or -1."""
    if not len(table):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return np.where(table[at] == hashes, at, -1)


def log10(own: np.ndarray, pairs: np.ndarray, bounds: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """log10 p of each row, from the quantised counts of its tokens and pairs."""
    c1 = typical(own.astype(np.int64), 1)
    before = np.empty(len(own))
    before[1:] = c1[:-1]
    before[bounds[:-1]] = c1[bounds[1:] - 1]  # rows begin as often as they end
    c2 = np.minimum(typical(pairs.astype(np.int64), 2), before)
    p = (c1 + 0.1) / (total + 0.1 * (distinct + 1))
    p = np.where(before > 0, MIX * c2 / np.maximum(before, 1e-9) + (1 - MIX) * p, p)
    return np.add.reduceat(np.log10(p), bounds[:-1])


#: A row holds packed documents of a chunk, or what a chunk and a bucket have for each other.
_ROW = "bucket int, chunk long, docs binary, words binary, pairs binary"
#: So do the buckets' answers; with chunk -1 a bucket's distinct words and their occurrences.
_MET = f"{_ROW}, n long, total long"


def _rows(bucket: list[int], chunk: list[int], **more: list) -> pa.RecordBatch:
    columns = {"bucket": pa.array(bucket, pa.int32()), "chunk": pa.array(chunk, pa.int64())}
    return pa.RecordBatch.from_pydict(columns | {k: pa.array(more.get(k, [None] * len(bucket)), pa.int64() if k in ("n", "total") else pa.binary()) for k in ("docs", "words", "pairs", *(k for k in ("n", "total") if k in more))})


def _folded(rows: pa.RecordBatch) -> bytes:
    """Documents as one compressed value."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_batch(rows)
    return out.getvalue().to_pybytes()


def _counted(flagged: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, sorted, and their occurrences in training rows, which have the lowest bit set; ``flagged`` is used up."""
    flagged.sort()
    counts = (flagged & np.uint64(1)).astype(np.int64)
    flagged &= ~np.uint64(1)
    first = np.flatnonzero(np.concatenate([[True], flagged[1:] != flagged[:-1]]))
    return flagged[first], np.add.reduceat(counts, first)


def _asked(batches: Iterator[pa.RecordBatch], buckets: int, size: int) -> Iterator[pa.RecordBatch]:
    words: list[tuple[np.ndarray, np.ndarray]] = []  # distinct ones of a block, and their counts
    pairs: list[np.ndarray] = []
    held, chunk = 0, -1
    least = np.array([-(-(b << 32) // buckets) << 32 for b in range(buckets)], np.uint64)  # of each bucket's hashes

    def flush() -> Iterator[pa.RecordBatch]:
        made = {1: _merged(words)}
        words.clear()
        flagged = np.concatenate(pairs)
        pairs.clear()
        made[2] = _counted(flagged)
        del flagged
        edges = {gram: [*np.searchsorted(hashes, least).tolist(), len(hashes)] for gram, (hashes, _) in made.items()}
        some: list[int] = []
        packed: dict[int, list[bytes]] = {1: [], 2: []}
        waiting = 0
        for bucket in range(buckets):
            spans = {gram: slice(*edges[gram][bucket : bucket + 2]) for gram in made}
            if all(x.start == x.stop for x in spans.values()):
                continue
            some.append(bucket)
            for gram, (hashes, counts) in made.items():
                packed[gram].append(_pack(hashes[spans[gram]], counts[spans[gram]], gram))
                waiting += len(packed[gram][-1])
            if waiting >= _SENT:
                yield _rows(some, [chunk] * len(some), words=packed[1], pairs=packed[2])
                some, packed, waiting = [], {1: [], 2: []}, 0
        if some:
            yield _rows(some, [chunk] * len(some), words=packed[1], pairs=packed[2])

    for batch in batches:
        for block in B.blocks(batch.column("text")):
            mine = batch.slice(block.first, block.rows)
            if not held:
                chunk = mine.column("rid")[0].as_py()
            own, two, bounds = tokens(block)
            held += len(own)
            train = np.repeat(pc.fill_null(pc.invert(mine.column("held_out")), False).to_numpy(zero_copy_only=False), np.diff(bounds))
            words.append(_merged([(own, train.astype(np.int64))]))
            two |= train.astype(np.uint64)
            pairs.append(two)
            at = int(B.mix(np.array([chunk], np.uint64))[0] % np.uint64(buckets))
            yield _rows([at], [chunk], docs=[_folded(mine.select(["id", "held_out", "text"]))])
            del own, two, train, mine
            if held >= size:
                yield from flush()
                held = 0
    if held:
        yield from flush()


def _answered(batches: Iterator[pa.RecordBatch], bits_each: int) -> Iterator[pa.RecordBatch]:
    """In a bucket: the segment of its n-grams, probed for every chunk. Documents pass, as of bucket -1."""
    got: dict[int, list[tuple[int, bytes, bytes]]] = {}
    for batch in batches:
        plain = batch.filter(batch.column("docs").is_valid())
        if plain.num_rows:
            none = [None] * plain.num_rows
            yield _rows([-1] * plain.num_rows, plain.column("chunk").to_pylist(), docs=plain.column("docs").to_pylist(), n=none, total=none)
        own = batch.filter(batch.column("words").is_valid())
        for bucket, *rest in zip(*(own.column(n).to_pylist() for n in ("bucket", "chunk", "words", "pairs")), strict=True):
            got.setdefault(bucket, []).append(tuple(rest))
        del plain, own
    for bucket in sorted(got):
        chunks, *held = zip(*got.pop(bucket), strict=True)
        grams = {}
        for gram in (1, 2):  # unpacked here and again for the probes, so that it need not be held meanwhile
            hashes, counts = _merged([_unpack(x, gram) for x in held[gram - 1]])
            grams[gram] = hashes[counts > 0], counts[counts > 0]
        del hashes, counts
        segment = Segment(grams, bits_each)
        answers: dict[int, list[bytes]] = {1: [], 2: []}
        for gram in answers:
            for x in held[gram - 1]:
                hashes, _ = _unpack(x, gram)
                answer = segment.levels(hashes, gram).tobytes()
                if gram == 1:
                    at = _found(grams[1][0], hashes)
                    there = at >= 0
                    exact = np.zeros(len(hashes), "<i8")
                    exact[there] = grams[1][1][at[there]]
                    answer += exact.tobytes()
                answers[gram].append(answer)
        none = [None] * len(chunks)
        yield _rows([bucket] * len(chunks) + [bucket], [*chunks, -1], words=[*answers[1], None], pairs=[*answers[2], None], n=[*none, len(grams[1][0])], total=[*none, int(grams[1][1].sum())])


def _finished(batches: Iterator[pa.RecordBatch], total: int, distinct: int) -> Iterator[pa.RecordBatch]:
    """Scores of the chunks, which come one after the other, each with its documents before its answers."""

    def finish() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(kept)
        docs = pa.concat_tables(pa.ipc.open_stream(x).read_all() for x in table.column("docs").drop_null().to_pylist())
        answers = table.filter(pc.is_valid(table.column("words")))
        levels, exact = [], []
        for data in answers.column("words").to_pylist():
            n = len(data) // 9
            levels.append(np.frombuffer(data, np.uint8, n))
            exact.append(np.frombuffer(data, "<i8", n, n))
        counts, words = np.concatenate(exact), np.concatenate(levels)
        pairs = np.frombuffer(b"".join(answers.column("pairs").to_pylist()), np.uint8)
        made = [tokens(block) for block in B.blocks(docs.column("text"))]
        keys = [np.unique(np.concatenate([x[i] for x in made])) for i in range(2)]
        if len(keys[0]) != len(words) or len(keys[1]) != len(pairs):
            raise RuntimeError("the answers of the buckets do not belong to the documents of the chunk")
        n_tokens, n_known, base, score_ = [], [], [], []
        for own, two, bounds in made:
            at = np.searchsorted(keys[0], own)
            c = counts[at]
            n_tokens.append(np.diff(bounds))
            n_known.append(np.add.reduceat((c > 0).astype(np.int64), bounds[:-1]))
            base.append(np.add.reduceat(np.log10((c + 0.1) / (total + 0.1 * (distinct + 1))), bounds[:-1]))
            score_.append(log10(words[at], pairs[np.searchsorted(keys[1], two)], bounds, total, distinct))
        columns = {"n_tokens": n_tokens, "n_known": n_known, "train_tokens": [np.full(docs.num_rows, total)], "base_score": base, "score": score_}
        yield from pa.table({"id": docs.column("id"), "held_out": docs.column("held_out"), **{k: np.concatenate(x) for k, x in columns.items()}}).to_batches(max_chunksize=10_000)

    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        chunk = batch.column("chunk").to_numpy()
        edges = [*np.flatnonzero(np.diff(chunk, prepend=-1)).tolist(), len(chunk)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if last != chunk[lo] and kept:
                yield from finish()
                kept = []
            last = chunk[lo]
            kept.append(batch.slice(lo, hi - lo))
    if kept:
        yield from finish()


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, bits_each: int = BITS_EACH) -> DataFrame:
    """For each row: key, held_out, n_tokens, n_known, train_tokens, base_score and score; null counts as empty text.

    Learns from the rows where ``held_out`` is false. Without any, all words are unknown. Rows are kept apart even
    where keys repeat or are null. An empty table gives no rows. A chunk has ``chunk`` tokens, and its last document's more.
    """
    small_batches(docs.sparkSession)
    body = docs.select(F.col(f"`{key}`").alias("id"), held_out.alias("held_out"), F.col(f"`{text}`").alias("text"))
    kind = body.schema["id"].dataType.simpleString()
    buckets = parts(docs, 8 << 20)
    asked = body.select(F.monotonically_increasing_id().alias("rid"), "id", "held_out", "text").mapInArrow(B.released(lambda b: _asked(b, buckets, chunk)), _ROW)
    table = cut(asked.repartition(buckets, "bucket").mapInArrow(B.released(lambda b: _answered(b, bits_each)), _MET))
    sums = table.where("chunk < 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("v"), F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first()
    total, distinct = int(sums["n"]), int(sums["v"])
    met = table.where("chunk >= 0").drop("n", "total").repartition(buckets, "chunk").sortWithinPartitions("chunk", "bucket")
    done = met.mapInArrow(B.released(lambda b: _finished(b, total, distinct)), f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return done.withColumnRenamed("id", key)
