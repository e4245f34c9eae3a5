"""Components of a similarity join over inverted lists, without emitting the pairs within a list."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .lineage import cut, forget
from .sketches import count_min, repeated

STAR_ROUNDS = 2
#: Words of parity bits to a set.
WORDS = 16
#: Lists of more ids are thinned out and dealt to groups before they are merged; neither changes what is found.
SMALL = 64
#: Groups that the ids of a long list are dealt to when the list is merged with itself.
SALTS = 4
#: Cells of the sketch of tokens.
CELLS = 1 << 26
Tokens = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]


def _reach(part: int, whole: int, common: Column, n: Column, other: Column) -> Column:
    """Whether sets of n and ``other`` tokens with at most ``common`` in common can reach the similarity part / whole."""
    return F.lit(whole) * common >= F.lit(part) * (n + other - common)


def _cross(rows: DataFrame, on: str, more: Column | None = None, salts: int = 1) -> DataFrame:
    """Pairs (a, b) of ids of different components that meet under ``on`` and satisfy ``more``, which sees columns _x and _y.

    With salts the rows of one list are dealt to that many groups, each of which meets all of the list.
    """
    x, y = (rows.select(on, *[F.col(c).alias(f"{c}_{s}") for c in rows.columns if c != on]) for s in ("x", "y"))
    keys = [on]
    if salts > 1:
        x = x.withColumn("salt", F.pmod(F.xxhash64("id_x"), F.lit(salts)).cast("int"))
        y = y.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keys = [on, "salt"]
    met = x.join(y, keys).where((F.col("c_x") < F.col("c_y")) & (more if more is not None else F.lit(True)))
    return met.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"))


def parities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """WORDS words of 64 bits for each set: bit i tells whether an odd number of its tokens fall in cell i."""
    width = 64 * WORDS
    cell = np.repeat(np.arange(len(counts)) * width, counts) + (hashes & np.uint64(width - 1)).astype(np.int64)
    odd = (np.bincount(cell, minlength=len(counts) * width) & 1).astype(np.uint8)
    return np.packbits(odd).view("<u8").reshape(-1, WORDS)


def _alike(part: int, whole: int) -> Column:
    """Whether rows x and y can reach the similarity; false only if they can't.

    Bits that differ stand for tokens that only one of the sets has, each token for one bit at most, and sets that
    reach the similarity differ in (n_x + n_y) * (whole - part) / (whole + part) tokens at most.
    """
    differ = F.bit_count(F.col("b0_x").bitwiseXOR(F.col("b0_y")))
    for i in range(1, WORDS):
        differ = differ + F.bit_count(F.col(f"b{i}_x").bitwiseXOR(F.col(f"b{i}_y")))
    sized = F.lit(whole) * F.least("m_x", "m_y") >= F.lit(part) * F.greatest("m_x", "m_y")
    return sized & (differ * F.lit(whole + part) <= (F.col("m_x") + F.col("m_y")) * F.lit(whole - part))


def _common(rows: DataFrame, of: Tokens) -> DataFrame:
    """(id, common): how many of a set's tokens other rows have too, or a few more: a sketch of fixed size tells."""

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for hashes, _ in of(batch):
            yield hashes

    held = rows.sparkSession.sparkContext.broadcast(count_min(rows, keys, CELLS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.bincount(np.repeat(np.arange(len(n)), n)[repeated(held.value, hashes)], minlength=len(n)) for hashes, n in of(batch)]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(found).astype(np.int64))], names=["id", "common"])

    return rows.mapInArrow(run, "id long, common long")


def _rest(live: DataFrame, sets: DataFrame, tokens: tuple[DataFrame, Tokens], part: int, whole: int) -> DataFrame:
    """All pairs that may still be linked between components.

    Ids meet only where the parity bits and the sizes of their sets allow the similarity; the join gives out no other
    pairs. Of long lists those ids are left out that could not be similar to any other one with the tokens that they
    have in common with ids of long lists at all, and the others are dealt to SALTS groups a list.
    """
    known = cut(live.select("pair", "id", "c").join(live.groupBy("pair").agg(F.count("*").alias("size")), "pair").join(sets.withColumnRenamed("n", "m"), "id"))
    small, long = known.where(F.col("size") <= SMALL).drop("size"), known.where(F.col("size") > SMALL).drop("size")
    pairs = _cross(small, "pair", _alike(part, whole))
    if not long.isEmpty():
        rows, of = tokens
        counted = long.join(_common(cut(rows.join(long.select("id").distinct(), "id", "left_semi")), of), "id")
        least = counted.groupBy("pair").agg(F.min("m").alias("least"))
        able = counted.join(least, "pair").where(_reach(part, whole, F.col("common"), F.col("m"), F.greatest(F.col("least").cast("double"), F.col("m") * F.lit(part / whole)))).drop("least")
        bound = _reach(part, whole, F.least("common_x", "common_y"), F.col("m_x"), F.col("m_y"))
        pairs = pairs.union(_cross(able, "pair", _alike(part, whole) & bound, SALTS))
    return pairs.distinct()


def link(
    lists: DataFrame, sets: DataFrame, confirm: Callable[[DataFrame], DataFrame], tokens: tuple[DataFrame, Tokens], part: int, whole: int, near: Column | None = None, star_rounds: int = STAR_ROUNDS
) -> DataFrame:
    """(id, component) of all ids that a confirmed link joins to another; the component is its least id.

    ``lists`` has the columns pair (the list) and id, and others that ``near`` needs to say whether rows x and y can be
    similar at all (it names them with _x and _y). ``sets`` has the size n and the parity words b0, b1, ... of each
    id's set, ``tokens`` is a table of the ids with what its function turns, batch by batch, into the tokens
    of each row and how many it has, and ``confirm`` keeps the true links among offered pairs (a, b). In a star round each list offers its ids one centre
    (the first time the least id, then one by hash), and what is joined is contracted, so a list of n alike ids costs
    about n pairs. The last round offers what may still be linked between components; no such pair goes untried.
    """
    extra = [c for c in lists.columns if c not in ("pair", "id")]
    labels: DataFrame | None = None
    live = lists.withColumn("c", F.col("id"))
    for turn in range(star_rounds + 1):
        if labels is not None:
            # lists of one component need nothing more
            named = live.drop("c").join(labels, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
            open_ = named.groupBy("pair").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("pair")
            before, live = live, cut(named.join(open_, "pair", "left_semi"))
            forget(before)
            if live.isEmpty():
                break
        first = F.xxhash64("id", F.lit(turn)) if turn else F.col("id")
        spread = live.groupBy("pair").agg(F.count("*").alias("size"), F.min(F.struct(first.alias("h"), "id", "c", *extra)).alias("m"))
        if turn < star_rounds:
            centres = spread.select("pair", *[F.col(f"m.{c}").alias(f"{c}_y") for c in ("id", "c", *extra)])
            met = live.select("pair", *[F.col(c).alias(f"{c}_x") for c in ("id", "c", *extra)]).join(centres, "pair").where("c_x <> c_y")
            met = met if near is None else met.where(near)
            offered = met.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()
        else:
            offered = _rest(live, sets, tokens, part, whole)
        links = cut(confirm(offered))
        if links.isEmpty():
            continue
        if labels is None:
            labels = components(links).select(F.col("node").alias("id"), "component")
            continue
        a, b = labels.select(F.col("id").alias("a"), F.col("component").alias("ca")), labels.select(F.col("id").alias("b"), F.col("component").alias("cb"))
        joined = components(links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
        merged = joined.select(F.col("node"), F.col("component").alias("to"))
        old = labels.join(merged, labels["component"] == merged["node"], "left").select("id", F.coalesce("to", "component").alias("component"))
        new = merged.join(labels.select(F.col("id").alias("node")), "node", "left_anti").select(F.col("node").alias("id"), F.col("to").alias("component"))
        labels = cut(old.union(new))
    return lists.select("id", F.col("id").alias("component")).limit(0) if labels is None else labels
