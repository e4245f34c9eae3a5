"""Jaccard overlap of all pairs of sets of a group, block by block.

A set is words of 64 members as bits. Roles with the same set are one class; a group's classes are dealt into blocks of
bounded size, and each two blocks meet once, in one task, whose matrix product gives what their sets share. Shuffled are
the sets, once for each block of their group, and a few numbers for each two blocks, never a row for a pair: the pairs'
number, which is quadratic, costs time only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes and words of sets in a block, about; words held at once as a matrix of floats.
BLOCK_SETS = 1024
BLOCK_WORDS = 1 << 20
_CHUNK = 64
_SET = "array<struct<word:bigint,bits:bigint>>"


def classes(words: DataFrame, roles: DataFrame, by: str, role: str) -> DataFrame:
    """(by, set, loose, k, first, second, size): the different sets of roles, how many roles have each and the two least of them.

    words has by, role, word and bits, a row for each word of a set; a role of ``roles`` (by, role, loose) without any has the
    empty set. loose are members besides that equal no other role's.
    """
    held = words.groupBy(by, role).agg(F.array_sort(F.collect_list(F.struct(F.col("word").cast("long").alias("word"), "bits"))).cast(_SET).alias("set"))
    sized = roles.join(held, [by, role], "left").withColumn("set", F.coalesce("set", F.array().cast(_SET)))
    out = sized.groupBy(by, "set", "loose").agg(F.count("*").alias("k"), F.min(role).alias("first"), F.get(F.sort_array(F.collect_list(role)), 1).alias("second"))
    return out.withColumn("size", F.aggregate("set", F.col("loose"), lambda s, w: s + F.bit_count(w["bits"])))


def _matrix(rows: np.ndarray, at: np.ndarray, bits: np.ndarray, n: int) -> np.ndarray:
    """0 and 1 of n sets over the members of ``_CHUNK`` words."""
    out = np.zeros((n, _CHUNK), np.int64)
    out[rows, at] = bits
    return np.unpackbits(out.view(np.uint8), axis=1).astype(np.float32)


def _shared(left: tuple, right: tuple, words: np.ndarray) -> np.ndarray:
    """How many members each left set shares with each right one."""
    out = np.zeros((left[3], right[3]))
    for lo in range(0, len(words), _CHUNK):
        sides = []
        for rows, at, bits, n in (left, right):
            here = (at >= lo) & (at < lo + _CHUNK)
            sides.append(_matrix(rows[here], at[here] - lo, bits[here], n))
        out += sides[0] @ sides[1].T
    return out


def _met(table: pa.Table, digits: int) -> tuple[float, list[tuple[float, object, object]]]:
    """Sum of the overlaps of two blocks' pairs, each counted for all roles of its classes, and for each overlap that may round to the greatest its first pair."""
    side = table["side"].to_numpy()
    sets = table["set"].combine_chunks()
    counts = sets.value_lengths().to_numpy(zero_copy_only=False)
    flat = sets.flatten()
    words, at = np.unique(flat.field("word").to_numpy(zero_copy_only=False), return_inverse=True)
    bits, k, size = flat.field("bits").to_numpy(zero_copy_only=False), table["k"].to_numpy(), table["size"].to_numpy().astype(float)
    names = table["first"].to_pylist()
    rank = np.empty(len(names), np.int64)
    rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    owner = np.repeat(np.arange(len(names)), counts)
    parts = []
    for s in (0, 1):
        own = np.flatnonzero(side == s)
        place = np.full(len(names), -1)
        place[own] = np.arange(len(own))
        mine = side[owner] == s
        parts.append((own, (place[owner[mine]], at[mine], bits[mine], len(own))))
    one = not len(parts[1][0])
    (a, left), (b, right) = parts[0], parts[0] if one else parts[1]
    both = _shared(left, right, words)
    overlap = both / (size[a][:, None] + size[b][None, :] - both)
    if one:
        overlap[np.tril_indices(len(a))] = 0
    total = float(k[a].astype(float) @ overlap @ k[b].astype(float))
    most = overlap.max(initial=0.0)
    if most == 0:
        return total, []
    i, j = np.nonzero(overlap >= max(most - 2 * 10.0**-digits, np.finfo(float).tiny))
    values, (x, y) = overlap[i, j], (rank[a[i]], rank[b[j]])
    pair = np.minimum(x, y) * len(names) + np.maximum(x, y)
    best: list[tuple[float, object, object]] = []
    by_rank = sorted(names)
    order = np.lexsort((pair, values))
    for at_ in order[np.r_[True, np.diff(values[order]) > 0]].tolist():
        best.append((float(values[at_]), by_rank[pair[at_] // len(names)], by_rank[pair[at_] % len(names)]))
    return total, best


def totals(found: DataFrame, by: str, digits: int) -> DataFrame:
    """(by, sum, max, best) over the pairs of different sets of ``found`` (``classes``, as a written table).

    sum has each overlap as often as there are pairs of roles of the two classes, max is the greatest, and best (o, a, b)
    minus the greatest as rounded, with the first pair of roles that has it. Groups whose sets share nothing may be missing.
    """
    some = found.where("size(set) > 0").select(by, "first", "k", "size", "set")
    dealt = some.groupBy(by).agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum(F.size("set")) / BLOCK_WORDS)).cast("int").alias("blocks"))
    own = some.join(dealt, by).withColumn("block", F.pmod(F.xxhash64("first"), F.col("blocks")).cast("int"))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = each.select(by, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "first", "k", "size", "set")
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema.fields}

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        lo, hi = key[1].as_py(), key[2].as_py()
        if lo != hi and table["side"].to_numpy().min() == 1:
            total, best = 0.0, []  # the other block is empty
        elif lo != hi and table["side"].to_numpy().max() == 0:
            total, best = 0.0, []
        else:
            total, best = _met(table, digits)
        rows = [(total, None, None, None), *[(0.0, *b) for b in best]]
        name = table.schema.field("first").type
        total_, overlap, a, b = (list(c) for c in zip(*rows, strict=True))
        return pa.table({by: pa.array([key[0].as_py()] * len(rows), table.schema.field(by).type), "sum": pa.array(total_, pa.float64()), "overlap": pa.array(overlap, pa.float64()), "a": pa.array(a, name), "b": pa.array(b, name)})

    met = placed.groupBy(by, "lo", "hi").applyInArrow(meet, f"`{by}` {kinds[by]}, sum double, overlap double, a {kinds['first']}, b {kinds['first']}")
    best = F.min(F.when(F.col("overlap").isNotNull(), F.struct((-F.round("overlap", digits)).alias("o"), "a", "b"))).alias("best")
    return met.groupBy(by).agg(F.sum("sum").alias("sum"), F.max("overlap").alias("max"), best)
