"""Version differences, merges, token costs, pivots and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def version_diff(old: DataFrame, new: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Each key of either version: added, removed, changed or same, with a flag for each field."""
    a = old.select(*key, F.struct(*fields).alias("o"))
    b = new.select(*key, F.struct(*fields).alias("n"))
    both = a.join(b, key, "full_outer")
    differs = {f: ~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")) for f in fields}
    common = F.col("o").isNotNull() & F.col("n").isNotNull()
    flags = [(common & differs[f]).alias(f"{f}_changed") for f in fields]
    some = common & (~F.col("o").eqNullSafe(F.col("n")))
    return both.select(*key, F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(some, "changed").otherwise("same").alias("change"), *flags)


def overlay(main: DataFrame, over: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of main with the other's fields where it has the key, nulls included."""
    m = main.alias("m").join(over.select(F.col(key).alias("_k"), F.lit(True).alias("_have"), *[F.col(f).alias(f"_{f}") for f in fields]), F.col(f"m.{key}") == F.col("_k"), "left")
    kept = [F.when(F.coalesce("_have", F.lit(False)), F.col(f"_{c}")).otherwise(F.col(f"m.{c}")).alias(c) if c in fields else F.col(f"m.{c}") for c in main.columns]
    return m.select(*kept, F.coalesce("_have", F.lit(False)).alias("matched"))


def keep_last(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    fields = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max(F.struct(order, *[c for c in fields if c != order])).alias("m")).select(*key, *[F.col(f"m.{c}") for c in fields])


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """All rows of the keys that occur more than once."""
    return df.join(df.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(*key), key, "left_semi")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def token_cost(usage: DataFrame, prices: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    """Tokens and dollars: usage has tokens_in and tokens_out, prices are dollars a million by model."""
    joined = usage.join(prices, "model", "left")
    cost = (F.col("tokens_in") * F.coalesce("price_in", F.lit(0.0)) + F.col("tokens_out") * F.coalesce("price_out", F.lit(0.0))) / 1e6
    return joined.groupBy(*by).agg(
        F.count("*").cast("long").alias("calls"), F.sum("tokens_in").cast("long").alias("tokens_in"), F.sum("tokens_out").cast("long").alias("tokens_out"),
        F.round(F.avg("tokens_in"), digits).alias("avg_in"), F.round(F.sum(cost), digits).alias("cost"),
    )


def summary(df: DataFrame, value: str, by: list[str], digits: int = 6) -> DataFrame:
    """Count, mean, exact median, least, greatest and sum of a value."""
    r = lambda c: F.round(c, digits)
    return df.groupBy(*by).agg(F.count("*").cast("long").alias("n"), r(F.avg(value)).alias("mean"), r(F.median(value)).alias("median"), r(F.min(value)).alias("least"), r(F.max(value)).alias("most"), r(F.sum(value)).alias("total"))


def cumulative_share(df: DataFrame, by: list[str], part: list[str], order: list[Column], digits: int = 6) -> DataFrame:
    """Counts by group with their running share, as the sectors of a circle follow each other."""
    counts = df.groupBy(*by, *part).agg(F.count("*").cast("long").alias("n"))
    w = Window.partitionBy(*by).orderBy(*order)
    total = F.sum("n").over(Window.partitionBy(*by))
    running = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumns({"from_share": F.round((running - F.col("n")) / total, digits), "to_share": F.round(running / total, digits)})


def ema(df: DataFrame, by: list[str], order: str, value: str, weight: float, digits: int = 6) -> DataFrame:
    """Exponentially smoothed last value of each series; null if a value is null.

    A value's share depends only on its place from the end, so the smoothing is a sum over numbered rows: a series is
    sorted, with spill, and never held in one row.
    """
    x = F.col(value).cast("double")
    placed = df.select(*by, x.alias("x"), F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order), x.desc())).alias("r"))
    smoothed = F.sum((1 - weight) * F.pow(F.lit(weight), F.col("r") - 1) * F.col("x")) + F.max_by("x", "r") * F.pow(F.lit(weight), F.count("*"))
    return placed.groupBy(*by).agg(F.count("*").cast("long").alias("n"), F.when(F.count("x") == F.count("*"), F.round(smoothed, digits)).alias("smoothed"))


def judge_summary(decisions: DataFrame, digits: int = 6) -> DataFrame:
    """Wins, ties, unknowns and win rates among decisive verdicts."""
    n = lambda w: F.count_if(F.col("winner") == w).cast("long")
    out = decisions.agg(F.count("*").cast("long").alias("total"), n("A").alias("wins_a"), n("B").alias("wins_b"), n("tie").alias("ties"), n("unknown").alias("unknown"))
    decisive = F.col("wins_a") + F.col("wins_b")
    rate = lambda c: F.round(F.when(decisive == 0, 0.0).otherwise(F.col(c) / decisive), digits)
    return out.withColumns({"decisive": decisive, "rate_a": rate("wins_a"), "rate_b": rate("wins_b")})
