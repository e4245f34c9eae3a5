"""Exactly k rows of each stratum, the same ones however the rows are dealt to tasks.

Each row gets a number from SHA-256 of the seed and its key, and a stratum's sample is its k least numbers. Nothing is
sorted to find them: one pass counts rows by stratum and the number's leading bits, which adds up by parts like any count;
the running counts of a stratum say up to which leading bits its sample reaches, and only rows below that bound (k and one
cell's worth) are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bits of a row's number, and leading bits that are counted: rows of a stratum beyond k that are ranked are one in 2 ** CELL_BITS.
BITS, CELL_BITS = 60, 16


def drawn_number(seed: int, *keys: Column) -> Column:
    """A number of 60 bits from the seed and a row's key; a null part counts as a part of its own."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("\u0000")) for k in keys])
    return F.conv(F.substring(F.sha2(text, 256), 1, BITS // 4), 16, 10).cast("long")


def bottom_k(rows: DataFrame, by: list[str], key: list[str], k: int, seed: int = 42) -> DataFrame:
    """rows of the sample: ``k`` of each stratum, all of smaller ones. Strata and keys may be null; of rows that share a key
    any may be taken first, and the number taken is still exact. An empty table gives an empty one."""
    if k < 1:
        raise ValueError("k must be positive")
    at, cell = F.col("_at"), F.shiftright("_at", BITS - CELL_BITS)
    numbered = rows.withColumn("_at", drawn_number(seed, *[F.col(f"`{c}`") for c in key]))
    names = [f"_s{i}" for i in range(len(by))]
    counts = numbered.groupBy(*[F.col(f"`{c}`").alias(n) for c, n in zip(by, names, strict=True)], cell.alias("_cell")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*names).orderBy("_cell")) - F.col("_n")  # a row for each cell
    bounds = counts.withColumn("_before", before).where(F.col("_before") < k).groupBy(*names).agg(F.max("_cell").alias("_last"))
    same = F.lit(True)
    for c, n in zip(by, names, strict=True):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(n))
    near = numbered.join(bounds, same).where(cell <= F.col("_last"))
    place = F.row_number().over(Window.partitionBy(*names).orderBy(at, *[F.col(f"`{c}`") for c in key]))
    return near.withColumn("_place", place).where(F.col("_place") <= k).select(*[F.col(f"`{c}`") for c in rows.columns])
