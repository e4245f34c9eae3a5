"""Fuzzy line dedup: one line is kept of each component of near-copies.

A line is what lies between line feeds, without ASCII white space around it; blank lines are left alone. Lines of
equal text are one class. Each class has the set of its shingles of ``SHINGLE`` characters; lines shorter than that are
similar to equal ones only. One of more than SHORT distinct shingles has a signature of BANDS * ROWS bins, each the
least hash of the shingles that fall in it; an empty bin takes a full one's, which it seeks in an order of its own, so
that bins stay nearly independent in short lines too. With 20 bands of 6 a pair at 0.8 agrees in a whole band with a
chance of about 0.998, one at 0.9 practically always. A class of at most SHORT shingles meets every similar one: pairs
of its least shingle hashes are its keys (a prefix filter, without loss), and those of all lines that could be similar
to such a one.

Keys travel packed, with 64 bits of the signature and the number of shingles. Where they meet, lists in which no two
lines agree in enough of these bits and in size are let go; of the other lists the candidates are compared exactly on
the texts, and confirmed links go through the distributed union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .decontamination import BITS, bitmap
from .lineage import cut, forget, parts, small_batches
from .linking import WORDS, link, parities

SHINGLE, BANDS, ROWS = 5, 20, 6
PART, WHOLE = 80, 100
#: Lines of at most so many distinct shingles meet all similar ones, by prefixes.
SHORT = 24
#: Standard deviations that a pair at the threshold may lie below its mean agreement of signature bits.
SLACK = 4.5
_BINS = BANDS * ROWS
_HASH = 52
_MASK = np.uint64((1 << _HASH) - 1)
_NONE = np.uint64(1 << 63)
_LINES, _BYTES = 2048, 1 << 18  # lines and bytes of a chunk that is turned into shingles at once
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC4CEB9FE1A85EC53)
_WHITE = " \t\n\r\x0b\x0c"
_POSTING = np.dtype([("hi", "<u4"), ("lo", "<u2"), ("line", "<u8"), ("bits", "<u8"), ("n", "<u2")])
_BUCKET_BYTES, _BUCKETS = 16 << 20, 8  # input to a partition of postings, and buckets to a partition
_FLUSH = 1 << 19
_HELD = 1 << 20
_CELLS = 1 << 22


def line_hash(body: bytes) -> int:
    """Spark's xxhash64 of the same string, unsigned."""
    return xxhash.xxh64_intdigest(body, 42)


def chunks(lines: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of the lines that are turned into shingles at once."""
    lo = size = 0
    for i, body in enumerate(lines):
        size += len(body)
        if size >= _BYTES or i + 1 - lo >= _LINES:
            yield lines[lo : i + 1]
            lo, size = i + 1, 0
    if lo < len(lines):
        yield lines[lo:]


def shingles(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of up to 4096 lines, sorted within each line, on end, and how many each line has."""
    codes = np.frombuffer(b"\n".join(lines).decode(errors="replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    feeds = np.flatnonzero(codes == 10)
    starts, ends = np.append(0, feeds + 1), np.append(feeds, len(codes))
    n = np.maximum(0, ends - starts - SHINGLE + 1)
    if not n.any():
        return np.zeros(0, np.uint64), n
    # five characters: two, four (two twos), and one more; each step multiplies so that no sum can cancel out
    two = codes[:-1] << np.uint64(21)
    two |= codes[1:]
    own = two[:-3] * _K1
    own += two[2:-1]
    own *= _K2
    own += codes[4:]
    own ^= own >> np.uint64(32)
    own *= _K3
    own >>= np.uint64(64 - _HASH)
    inside = np.ones(len(codes) + 1, bool)
    for d in range(SHINGLE):  # where a shingle would reach beyond its line
        inside[np.maximum(ends - d, starts)] = False
    own = own[inside[: len(own)]]
    own |= np.repeat(np.arange(len(n), dtype=np.uint64) << np.uint64(_HASH), n)
    own.sort()
    first = np.ones(len(own), bool)
    np.not_equal(own[1:], own[:-1], out=first[1:])
    own = own[first]
    edges = np.searchsorted(own, np.arange(len(n) + 1, dtype=np.uint64) << np.uint64(_HASH))
    own &= _MASK
    return own, np.diff(edges)


def _turns() -> np.ndarray:
    """By turn and bin the bin that is asked next: each empty bin asks all bins in an order of its own for the first full one."""
    keys = B.mix(np.arange(_BINS * _BINS, dtype=np.uint64) + np.uint64(0x74)).reshape(_BINS, _BINS)
    return np.argsort(keys, 1, kind="stable").T.copy()


_TURNS = _turns()


def signature(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Least shingle hash of each line in each bin, mixed with the bin's number; empty bins are filled from full ones. All counts are over 0."""
    cell = hashes * np.uint64(_BINS)
    cell >>= np.uint64(_HASH)
    cell += np.repeat(np.arange(len(counts), dtype=np.uint64) * np.uint64(_BINS), counts)
    cell = cell.view(np.int64)
    least = np.ones(len(cell), bool)  # hashes are sorted, so the first of a cell is its least
    np.not_equal(cell[1:], cell[:-1], out=least[1:])
    bins = np.full(len(counts) * _BINS, _NONE)
    bins[cell[least]] = hashes[least]
    filled = bins.copy()
    empty = np.flatnonzero(bins == _NONE)
    own = empty % _BINS
    line = empty - own
    for turn in range(_BINS):
        if not len(empty):
            break
        value = bins[line + _TURNS[turn][own]]
        full = value != _NONE
        filled[empty[full]] = value[full]
        more = ~full
        empty, own, line = empty[more], own[more], line[more]
    return B.mix(filled.reshape(-1, _BINS) ^ (np.arange(_BINS, dtype=np.uint64) << np.uint64(_HASH)))


def bands(signed: np.ndarray) -> np.ndarray:
    """Band values of each line, hashed with the band's number."""
    return B.mix(np.bitwise_xor.reduce(signed.reshape(len(signed), ROWS, BANDS), 1) + np.arange(1, BANDS + 1, dtype=np.uint64))


def bits(signed: np.ndarray) -> np.ndarray:
    """A bit of each of the first 64 bins."""
    return np.packbits((signed[:, :64] >> np.uint64(63)).astype(np.uint8), axis=1).view("<u8").ravel()


def slack(n: np.ndarray, part: int = PART, whole: int = WHOLE) -> np.ndarray:
    """How many of the 64 bits may differ in a pair whose smaller line has n shingles; all of them in lines that keys of prefixes join."""
    agree = (1 + part / whole) / 2
    spread = np.sqrt(agree * (1 - agree) * (1 / 64 + 1 / np.minimum(0.7 * np.maximum(n, 1), _BINS)))
    return np.where(n <= partners(part, whole), 64, np.floor(64 * (1 - agree + SLACK * spread)).astype(np.int64))


def partners(part: int, whole: int) -> int:
    """Shingles at most of a line that is similar to one of at most SHORT."""
    return SHORT * whole // part


def prefixes(tokens: np.ndarray, counts: np.ndarray, part: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix keys of lines of few shingles (sorted by hash), with the line of each: similar lines share at least one.

    Similar sets share ceil(part * n / whole) shingles of each one's n, so in any order of the shingles two common ones
    are among the first n - that + 2 of both; a line that may share just one has its single shingles as keys too.
    """
    least = -(-part * counts // whole)
    length = np.minimum(counts, counts - least + 2)
    first = np.cumsum(counts) - counts
    single = np.flatnonzero((least == 1) & (counts > 0))
    n = counts[single]
    keys, owners = [B.mix(tokens[np.repeat(first[single], n) + B.ragged(n)] + np.uint64(0x31))], [np.repeat(single, n)]
    for j in range(1, int(length.max(initial=0))):
        has = np.flatnonzero(length > j)
        for i in range(j):
            keys.append(B.mix(B.mix(tokens[first[has] + i]) * _K2 + tokens[first[has] + j]))
            owners.append(has)
    return np.concatenate(keys), np.concatenate(owners)


def postings(hashes: np.ndarray, counts: np.ndarray, part: int = PART, whole: int = WHOLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the lines, the line of each key, and the signature bits of each line."""
    some = np.flatnonzero(counts)
    signed = signature(hashes, counts[some])
    sketch = np.zeros(len(counts), np.uint64)
    sketch[some] = bits(signed)
    long = counts[some] > SHORT
    few = (counts > 0) & (counts <= partners(part, whole))
    keys, row = prefixes(hashes[np.repeat(few, counts)], counts * few, part, whole)
    return np.concatenate([bands(signed[long]).ravel(), keys]), np.concatenate([np.repeat(some[long], BANDS), row]), sketch


def bodies(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """For each row its number and its trimmed lines that are not blank."""
    white = _WHITE.encode()
    for i, text in enumerate(column.cast(pa.binary()).to_pylist()):
        if text:
            yield i, [x for x in (line.strip(white) for line in text.split(b"\n")) if x]


def _read(docs: DataFrame) -> DataFrame:
    """id, th, number and line (its hash) of each line that is not blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        white = _WHITE.encode()
        for batch in batches:
            row, number, names = [], [], []
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                if text:
                    for j, line in enumerate(text.split(b"\n")):
                        if body := line.strip(white):
                            row.append(i)
                            number.append(j)
                            names.append(line_hash(body))
            own = batch.drop_columns(["text"]).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(number, pa.int32()), pa.array(B.signed(np.array(names, np.uint64)))], names=["id", "th", "number", "line"])

    return docs.mapInArrow(B.released(run), f"id {docs.schema['id'].dataType.simpleString()}, th long, number int, line long")


def _posted(docs: DataFrame, buckets: int, part: int, whole: int) -> DataFrame:
    """(bucket, held): the postings of all lines, packed; a line of a task's memory is posted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            own = np.concatenate(held)
            held.clear()
            at = (own["hi"].astype(np.int64) * buckets) >> 32
            order = np.argsort(at.astype(np.uint16) if buckets <= 1 << 16 else at, kind="stable")  # few buckets: a radix sort
            own, at = own.view("<u8").reshape(-1, 3)[order].view(_POSTING).ravel(), at[order]  # a posting is three words
            edge = np.flatnonzero(np.diff(at, prepend=-1, append=-1))
            packed = [own[lo:hi].tobytes() for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at[edge[:-1]].astype(np.int32)), pa.array(packed, pa.binary())], names=["bucket", "held"])

        def post(names: list[int], lines: list[bytes]) -> None:
            hashes, counts = shingles(lines)
            if not len(hashes):
                return
            keys, row, sketch = postings(hashes, counts, part, whole)
            own = np.empty(len(keys), _POSTING)
            own["hi"], own["lo"] = keys >> np.uint64(32), keys & np.uint64(0xFFFF)
            own["line"], own["bits"] = np.array(names, np.uint64)[row], sketch[row]
            own["n"] = np.minimum(counts, 0xFFFF)[row]
            held.append(own)

        names, lines, size = [], [], 0
        for batch in batches:
            for _, found in bodies(batch.column("text")):
                for body in found:
                    h = line_hash(body)
                    if len(body) < SHINGLE or h in seen:
                        continue
                    if len(seen) >= _FLUSH:
                        seen.clear()
                    seen.add(h)
                    names.append(h)
                    lines.append(body)
                    size += len(body)
                    if size >= _BYTES or len(lines) >= _LINES:
                        post(names, lines)
                        names, lines, size = [], [], 0
                if sum(map(len, held)) > _FLUSH:
                    yield from flush()
        if lines:
            post(names, lines)
        if held:
            yield from flush()

    return docs.select("text").mapInArrow(B.released(run), "bucket int, held binary")


def _runs(own: np.ndarray) -> np.ndarray:
    """For each row the row where its key's run begins."""
    first = np.ones(len(own), bool)
    first[1:] = own["key"][1:] != own["key"][:-1]
    return np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))


def collide(own: np.ndarray, part: int, whole: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lists in which two lines are near, and the other rows: rows, which of them lead, and rows of no such list.

    In each list the first line takes those that are near it; of what is left the first leads on, until each line leads
    or is taken. If two lines of a list are near, one at least is taken, so a list in which none is has no near pair.
    """
    key = own["key"].copy()
    cells = min(_CELLS, 4 << len(own).bit_length())  # four to eight times the rows: few keys meet by chance
    cell = ((key ^ key >> np.uint64(23)) & np.uint64(cells - 1)).astype(np.int64)
    met = (np.bincount(cell, minlength=cells) > 1)[cell]  # a key that has no other in its cell is alone
    alone, own = own[~met], own[met]
    own = own[np.lexsort((own["line"], own["key"]))]
    same = np.zeros(len(own), bool)
    same[1:] = (own["key"][1:] == own["key"][:-1]) & (own["line"][1:] == own["line"][:-1])
    own = own[~same]
    wide, n = slack(own["n"].astype(np.int64), part, whole), own["n"].astype(np.int64)
    taken = np.zeros(len(own), bool)
    left = np.arange(len(own))
    while len(left):
        lead = left[_runs(own[left])]
        near = np.bitwise_count(own["bits"][lead] ^ own["bits"][left]) <= np.maximum(wide[lead], wide[left])
        near &= (whole * np.minimum(n[lead], n[left]) >= part * np.maximum(n[lead], n[left])) & (lead != left)
        taken[left[near]] = True
        left = left[~near & (lead != left)]
    start = _runs(own)
    live = np.zeros(len(own), bool)
    live[start[taken]] = True
    live = live[start]
    return own[live], ~taken[live], np.concatenate([alone, own[~live]])


_KEYED = np.dtype([("key", "<u8"), ("line", "<u8"), ("bits", "<u8"), ("n", "<u2")])


def _met(posted: DataFrame, size: int, part: int, whole: int) -> DataFrame:
    """(pair, id, bits, n): the lists in which two lines are near.

    A bucket of more than _HELD postings passes on what lists it has and holds only their leading lines, so a key that
    very many similar lines share takes no more memory than others.
    """

    def rows(own: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(B.signed(names)), pa.array(B.signed(own["line"].copy())), pa.array(B.signed(own["bits"].copy())), pa.array(own["n"].astype(np.int32))], names=["pair", "id", "bits", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        split = np.zeros(0, np.uint64)  # keys of which lists were passed on in parts
        now, limit = -1, _HELD

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal split
            own, _, _ = collide(np.concatenate(held), part, whole)
            held.clear()
            if len(own):
                # a list is named by its lines, so those that meet under several keys are one list
                start = _runs(own)
                heads = np.flatnonzero(start == np.arange(len(own)))
                content = B.mix(np.add.reduceat(B.mix(own["line"] + np.uint64(0x29)), heads))[np.searchsorted(heads, start)]
                yield rows(own, np.where(np.isin(own["key"], split), B.mix(own["key"]), content))
            split = split[:0]

        for batch in batches:
            for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("held").to_pylist(), strict=True):
                if bucket != now:
                    if held:
                        yield from close()
                    now, limit = bucket, _HELD
                raw = np.frombuffer(packed, _POSTING)
                own = np.empty(len(raw), _KEYED)
                own["key"] = raw["hi"].astype(np.uint64) << np.uint64(16) | raw["lo"].astype(np.uint64)
                for name in ("line", "bits", "n"):
                    own[name] = raw[name]
                held.append(own)
                if sum(map(len, held)) > limit:
                    live, leads, rest = collide(np.concatenate(held), part, whole)
                    held.clear()
                    if len(live):
                        yield rows(live, B.mix(live["key"]))
                        split = np.union1d(split, live["key"])
                    held.append(np.concatenate([live[leads], rest]))
                    limit = max(_HELD, 2 * len(held[0]))
        if held:
            yield from close()

    dealt = posted.repartition(size, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(B.released(run), "pair long, id long, bits long, n int")


def near(part: int, whole: int) -> tuple[Column, Column]:
    """What a list's rows carry (allowed differences of bits), and whether rows x and y can be similar."""
    top = partners(part, whole)
    table = slack(np.arange(_BINS * 2 + 1), part, whole).tolist()
    allowed = F.when(F.col("n") <= top, 64).otherwise(F.element_at(F.array(*[F.lit(int(x)) for x in table]), F.least("n", F.lit(_BINS * 2)) + 1))
    like = F.bit_count(F.col("bits_x").bitwiseXOR(F.col("bits_y"))) <= F.greatest("slack_x", "slack_y")
    return allowed.alias("slack"), like & (F.lit(whole) * F.least("n_x", "n_y") >= F.lit(part) * F.greatest("n_x", "n_y"))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, body, n, b0, b1, ...): the wanted lines with the size and the parity bits of their sets."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.col("id").alias("fp")), BITS))

    def send(ids: list[int], lines: list[bytes]) -> Iterator[pa.RecordBatch]:
        lo = 0
        for some in chunks(lines):
            hashes, counts = shingles(some)
            words = B.signed(parities(hashes, counts).T.copy())
            columns = [pa.array(B.signed(np.array(ids[lo : lo + len(some)], np.uint64))), pa.array(some, pa.binary()), pa.array(counts), *map(pa.array, words)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "body", "n", *[f"b{i}" for i in range(WORDS)]])
            lo += len(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        ids: list[int] = []
        own: list[bytes] = []
        for batch in batches:
            for _, lines in bodies(batch.column("text")):
                names = np.array([line_hash(x) for x in lines], np.uint64)
                at = names % np.uint64(BITS)
                hit = np.flatnonzero(held.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1) != 0)
                new = []
                for i in hit.tolist():
                    if (h := int(names[i])) not in seen:
                        if len(seen) >= _FLUSH:
                            seen.clear()
                        seen.add(h)
                        new.append(i)
                ids += names[new].tolist()
                own += [lines[i] for i in new]
                if sum(map(len, own)) >= _BYTES or len(own) >= _LINES:
                    yield from send(ids, own)
                    ids, own = [], []
        yield from send(ids, own)

    found = docs.select("text").mapInArrow(B.released(run), f"id long, body binary, n long, {', '.join(f'b{i} long' for i in range(WORDS))}")
    return found.join(wanted, "id", "left_semi").dropDuplicates(["id"])


def similar(lines: list[bytes], part: int, whole: int) -> np.ndarray:
    """Whether lines 0 and 1, 2 and 3, ... are similar by their whole shingle sets."""
    hashes, counts = shingles(lines)
    both = hashes | np.repeat(np.arange(len(counts), dtype=np.uint64) >> np.uint64(1) << np.uint64(_HASH), counts)
    both.sort()
    common = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(_HASH)).astype(np.int64), minlength=len(counts) // 2)
    return (common > 0) & (whole * common >= part * (counts[::2] + counts[1::2] - common))


def _confirmed(pairs: DataFrame, texts: DataFrame, part: int, whole: int) -> DataFrame:
    """The pairs whose shingle sets satisfy whole * intersection >= part * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, lo, size = [], 0, 0
            ta, tb = batch.column("ta"), batch.column("tb")
            for i, n in enumerate((pc.binary_length(ta).to_numpy() + pc.binary_length(tb).to_numpy()).tolist(), 1):
                size += n
                if size >= _BYTES or i - lo >= _LINES // 2 or i == batch.num_rows:
                    a, b = ta.slice(lo, i - lo).to_pylist(), tb.slice(lo, i - lo).to_pylist()
                    keep.append(similar([x for both in zip(a, b, strict=True) for x in both], part, whole))
                    lo, size = i, 0
            if keep:
                yield batch.select(["a", "b"]).filter(pa.array(np.concatenate(keep)))

    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("body").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("body").alias("tb")), "b")
    return both.mapInArrow(B.released(run), "a long, b long")


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct shingles of each line of a batch."""
    for own in chunks(batch.column("body").to_pylist()):
        yield shingles(own)


def components_of(docs: DataFrame, part: int = PART, whole: int = WHOLE) -> DataFrame:
    """(id, component) of the lines (by hash) of docs(text) that are similar to another."""
    size = parts(docs, _BUCKET_BYTES)
    allowed, like = near(part, whole)
    met = _met(_posted(docs, size * _BUCKETS, part, whole), size, part, whole)
    lists = cut(met.distinct().select("pair", "id", "bits", "n", allowed))
    texts = cut(_texts(docs, lists.select("id").distinct()))
    sets = texts.drop("body")
    labels = link(lists, sets, lambda pairs: _confirmed(pairs, texts, part, whole), (texts.select("id", "body"), _tokens), part, whole, like)
    forget(texts)
    return labels


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", part: int = PART, whole: int = WHOLE) -> DataFrame:
    """docs with the text's near-copied lines removed; added columns: n_lines and n_dropped.

    Of each component of similar lines the one that comes first (by key, null keys first, then by line) stays. Rows with
    equal key and text are treated alike. A null text stays null (no lines); blank lines stay. Columns named n_lines or
    n_dropped are replaced, all others kept, whatever their names; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    body = F.col(f"`{text}`")
    slim = docs.select(F.col(f"`{key}`").alias("id"), F.xxhash64(body).alias("th"), body.alias("text"))
    read = cut(_read(slim))
    labels = components_of(slim.select("text"), part, whole)
    place = F.struct("id", "th", "number")
    classes = read.groupBy("line").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    known = classes.join(labels.withColumnRenamed("id", "node"), F.col("line") == F.col("node"), "left").withColumn("c", F.coalesce("component", "line"))
    # a class of one line that is like no other needs no more thought
    known = cut(known.where("n > 1 or component is not null").select("line", "c", "first", "n"))
    heads = known.groupBy("c").agg(F.min("first").alias("head"))
    more = known.join(heads, "c").select("line", "head")
    gone = read.join(more, "line").where(~place.eqNullSafe(F.col("head")))
    drops = gone.groupBy("id", "th").agg(F.collect_set("number").alias("gone"))
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    whole_rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")).select("row", F.col(f"row.`{key}`").alias("id"), F.xxhash64(F.col(f"row.`{text}`")).alias("th"))
    d = drops.select(F.col("id").alias("did"), F.col("th").alias("dth"), "gone")
    joined = whole_rows.join(d, F.col("id").eqNullSafe(F.col("did")) & (F.col("th") == F.col("dth")), "left")
    # lines by built-in functions again: those whose number is gone are left out
    lines = F.split(F.col(f"row.`{text}`"), "\n")
    kept = F.when(F.col("gone").isNull(), F.col(f"row.`{text}`")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n"))
    n_lines = F.coalesce(F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(_WHITE)) != "")), F.lit(0)).cast("long")
    columns = [kept.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in others]
    return joined.select(*columns, n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
