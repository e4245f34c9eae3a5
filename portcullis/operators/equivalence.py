"""Equality of query results as sets, bags and sequences, with or without the order of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import steps
from . import denotation


def canonical(df: DataFrame, digits: int = 2, lower: bool = False, null: str | None = None) -> DataFrame:
    """Cells as strings: numbers rounded half up, dates without time, nested values as JSON."""

    def cell(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.NumericType):
            out = F.format_string("%s", F.round(c.cast("decimal(38,6)"), digits).cast(f"decimal(38,{digits})").cast("string"))
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            out = F.to_json(c)
        else:
            out = c.cast("string")
        out = F.lower(F.trim(out)) if lower else out
        return F.when(c.isNotNull(), out).otherwise(F.lit(null)) if null is not None else F.when(c.isNotNull(), out)

    return df.select(*[cell(f).alias(f"c{i}") for i, f in enumerate(df.schema.fields)])


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows of a and b, distinct rows only one has, and rows by which their bags differ.

    One aggregation over both, so that neither side is collected or compared pairwise.
    """
    names = a.columns
    both = a.withColumn("_s", F.lit(1)).unionByName(b.toDF(*names).withColumn("_s", F.lit(0)))
    counts = both.groupBy(*names).agg(F.sum("_s").alias("na"), F.sum(1 - F.col("_s")).alias("nb"))
    one = (F.col("na") == 0) | (F.col("nb") == 0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return counts.agg(total("na").alias("rows_a"), total("nb").alias("rows_b"), F.count_if(one).cast("long").alias("only_one"), total(F.abs(F.col("na") - F.col("nb"))).alias("bag_difference"))


def set_equal(a: DataFrame, b: DataFrame) -> bool:
    return len(a.columns) == len(b.columns) and difference(a, b).first()["only_one"] == 0


def bag_equal(a: DataFrame, b: DataFrame) -> bool:
    return len(a.columns) == len(b.columns) and difference(a, b).first()["bag_difference"] == 0


def result_equal(a: DataFrame, b: DataFrame, ordered: bool = False) -> bool:
    """Whether some order of b's columns makes the results equal as bags, or as sequences (``denotation.denotation_equal`` for one case).

    A sequence compares rows by their number, which the inputs must carry as a first column.
    """

    def side(df: DataFrame, gold: bool) -> DataFrame:
        named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
        place = F.col("c0") if ordered else F.lit(None)
        cells = F.array(*[denotation.normal_cell(F.col(f.name), f.dataType) for f in named.schema.fields[ordered:]])
        return named.select(F.lit(0).alias("case_id"), F.lit(gold).alias("gold"), place.cast("long").alias("place"), cells.alias("cells"))

    found = denotation.denotation_equal(side(a, True).unionByName(side(b, False)), a.sparkSession.range(1).select(F.lit(0).alias("case_id")))
    matches = found.first()["matches"]
    steps.release(found)
    return matches


def simulate_update(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """UPDATE as a projection."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def simulate_delete(df: DataFrame, where: Column) -> DataFrame:
    """DELETE as a filter; rows where the condition is null stay."""
    return df.where(~F.coalesce(where, F.lit(False)))
