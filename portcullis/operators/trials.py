"""Fair-comparison trials: one answer a question for each seed, and statistics across the trials."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEEDS = (42, 43, 44, 45, 46)


def exact_trials(keys: list[str], seeds: tuple[int, ...] = SEEDS) -> list[tuple[int, int]]:
    """(seed, source index) with the standard generator over groups in first-seen order; for a list that fits the driver."""
    if not keys or not seeds:
        raise ValueError("no rows or no seeds")
    groups: dict[str, list[int]] = {}
    for i, k in enumerate(keys):
        groups.setdefault(k, []).append(i)
    out = []
    for seed in seeds:
        draw = random.Random(seed)
        out += [(seed, i) for i in sorted(draw.choice(g) for g in groups.values())]
    return out


def sampled_trials(cases: DataFrame, seeds: tuple[int, ...] = SEEDS, group: str = "question_key", index: str = "source_index") -> DataFrame:
    """The same at any scale: for each seed and question the case of least hash, by a map-side combined minimum."""
    each = cases.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    rank = F.struct(F.sha2(F.concat_ws("|", F.col("seed").cast("string"), F.col(index).cast("string")), 256).alias("h"), F.col(index))
    return each.groupBy("seed", group).agg(F.min(rank).alias("m")).select("seed", group, F.col("m")[index].alias(index))


def across(trials: DataFrame, metrics: list[str], by: list[str], digits: int = 6) -> DataFrame:
    """Mean, population deviation, least and greatest of each metric; null where a trial has none."""
    whole = lambda m, x: F.when(F.count(m) == F.count("*"), x)
    aggs = [F.round(whole(m, f(m)), digits).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    return trials.groupBy(*by).agg(F.count("*").cast("long").alias("trials"), *aggs)


def pick(cases: DataFrame, group: str, first: str = "SystemManager", role: str = "role", index: str = "source_index") -> DataFrame:
    """One case a question: the first of a favoured role, else the first allowed one, else the first."""
    order = F.struct(F.when(F.col(role) == first, 0).when(F.col("gold_allowed"), 1).otherwise(2).alias("p"), F.col(index))
    return cases.groupBy(group).agg(F.min(order).alias("m")).select(group, F.col("m")[index].alias(index), F.col("m.p").cast("long").alias("priority"))


def listed(trials: DataFrame, metrics: list[str], by: list[str], order: str = "seed", digits: int = 6) -> DataFrame:
    """``across`` with each metric's values in the order of the trials as text: one value a trial."""

    def values_of(m: str) -> Column:
        return F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct(order, m))), lambda x: F.format_string("%.4f", x[m]))).alias(f"{m}_trials")

    values = [values_of(m) for m in metrics]
    names = [F.col(b).alias(f"_{b}") for b in by]
    same = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
    return across(trials, metrics, by, digits).join(trials.groupBy(*names).agg(*values), same).drop(*[f"_{b}" for b in by])
