"""Quality of role policies: deny rates, coverage, overlap, alignment, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import steps
from ..functions.numeric import alignment, cosine, ratio, spread
from . import overlap

# Weights of the operations in a role's coverage, by their share in the CRUD dataset.
OPERATION_WEIGHTS = {"SELECT": 0.7609, "UPDATE": 0.1304, "INSERT": 0.0761, "DELETE": 0.0326}
# Limits of the quality issues and of the strict audit.
LIMITS = {"deny_low": 5.0, "deny_high": 90.0, "similarity": 0.6, "overlap": 0.7, "std": 0.1, "coverage": 0.9}
STRICT = {"deny_high": 85.0, "overlap": 0.65, "std": 0.060, "similarity": 0.66}


def deny_rates(cases: DataFrame, by: str = "db_id", digits: int = 6) -> DataFrame:
    """Allowed and denied cases, roles, and questions that every role may ask or none may."""
    c = F.col("gold_allowed")
    questions = cases.groupBy(by, "question_key").agg(F.bool_and(c).alias("every"), F.bool_and(~c).alias("none"))
    kinds = questions.groupBy(by).agg(F.count("*").cast("long").alias("questions"), F.count_if("every").cast("long").alias("all_allowed"), F.count_if("none").cast("long").alias("all_denied"))
    counts = cases.groupBy(by).agg(F.count("*").cast("long").alias("total"), F.count_if(c).cast("long").alias("allowed"), F.count_if(~c).cast("long").alias("denied"), F.countDistinct("role").cast("long").alias("roles"))
    return counts.join(kinds, by).withColumn("deny_rate", F.round(100 * ratio(F.col("denied"), F.col("total")), digits))


def coverage(grants: DataFrame, catalog: DataFrame, by: str = "db_id", role: str = "role_ord", digits: int = 6) -> DataFrame:
    """Share of the catalog's columns that each role reads: mean and population deviation over the roles of a database."""
    size = catalog.agg(F.count("*").alias("n"))
    own = grants.groupBy(by, role).agg(F.count("*").alias("held")).crossJoin(F.broadcast(size)).withColumn("share", F.least(F.lit(1.0), ratio(F.col("held"), F.col("n"))))  # one row beside
    return own.groupBy(by).agg(F.count("*").cast("long").alias("roles"), F.round(F.avg("share"), digits).alias("avg_coverage"), F.round(spread(F.col("share")), digits).alias("std_coverage"), F.max("held").cast("long").alias("max_columns"))


def _role_classes(grants: DataFrame, by: str, role: str) -> DataFrame:
    """The different column sets of roles (``overlap.classes``), over columns numbered in their database."""
    held = grants.where(" and ".join(f"`{c}` is not null" for c in (by, role))).select(by, role, "table_name", "column_name").distinct()
    place = F.row_number().over(Window.partitionBy(by).orderBy("table_name", "column_name")) - 1
    names = held.select(by, "table_name", "column_name").distinct().withColumn("i", place)
    numbered = held.join(names, [by, "table_name", "column_name"])
    words = numbered.groupBy(by, role, F.floor(F.col("i") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(i % 64 as int))")).alias("bits"))
    nameless = F.count_if(F.col("table_name").isNull() | F.col("column_name").isNull())
    return overlap.classes(words, held.groupBy(by, role).agg(nameless.alias("loose")), by, role)


def policy_overlap(grants: DataFrame, by: str = "db_id", role: str = "role_ord", digits: int = 6) -> DataFrame:
    """Mean and greatest overlap of a database's role pairs, and the first pair of the greatest.

    Roles with the same columns are one class, and pairs of classes meet by blocks (``overlap``). Pairs that share nothing
    add 0: their number follows from the number of roles. Where nothing is shared the first pair is of the two least roles.
    """
    found = greatest_overlap(grants, by, role, digits)
    pairs = F.expr("n * (n - 1) div 2")
    some = F.coalesce(F.col("best.o") < 0, F.lit(False))
    return found.where("n > 1").select(
        by, pairs.alias("pairs"), F.round(F.col("sum") / pairs, digits).alias("avg_overlap"), F.round("max", digits).alias("max_overlap"),
        F.when(some, F.col("best.a")).otherwise(F.col("a1")).alias("role_a"), F.when(some, F.col("best.b")).otherwise(F.col("b1")).alias("role_b"),
    )


def greatest_overlap(grants: DataFrame, by: str = "db_id", role: str = "role_ord", digits: int = 6) -> DataFrame:
    """For each database n roles, the two least (a1, b1), sum and max of the overlaps of all pairs, and the first pair of the greatest (best: o, a, b)."""
    classes = steps.written(_role_classes(grants, by, role))
    least = F.slice(F.array_sort(F.flatten(F.collect_list(F.array_compact(F.array("first", "second"))))), 1, 2)
    roles = classes.groupBy(by).agg(F.sum("k").alias("n"), least.alias("least"))
    own = ratio(F.col("size") - F.col("loose"), F.col("size") + F.col("loose"))
    first = F.min(F.struct((-F.round("own", digits)).alias("o"), F.col("first").alias("a"), F.col("second").alias("b"))).alias("f")
    alike = classes.where("k > 1 and size > loose").withColumn("own", own).groupBy(by).agg(F.sum(F.expr("own * (k * (k - 1) div 2)")).alias("s"), F.max("own").alias("own"), first)
    out = roles.join(overlap.totals(classes, by, digits), by, "left").join(alike, by, "left").select(
        by, "n", F.get("least", 0).alias("a1"), F.get("least", 1).alias("b1"), (F.coalesce("sum", F.lit(0.0)) + F.coalesce("s", F.lit(0.0))).alias("sum"),
        F.coalesce(F.greatest("max", "own"), F.lit(0.0)).alias("max"), F.least("best", "f").alias("best"),
    )
    out = steps.written(out)  # a row for each database
    steps.release(classes)
    return out


def policy_counts(grants: DataFrame, by: str = "db_id", role: str = "role_ord") -> DataFrame:
    """Columns and tables that each role holds, and its place among the roles of its database."""
    counts = grants.groupBy(by, role).agg(F.count("*").cast("long").alias("n_columns"), F.countDistinct("table_name").cast("long").alias("n_tables"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n_columns"), role)).cast("long"))


def semantic_alignment(vectors: DataFrame, label: str = "label", vector: str = "embedding", digits: int = 4) -> DataFrame:
    """Similarity of each vector to the mean vector of its label: average, least and greatest a label."""
    at = vectors.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = at.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))  # as long as a vector
    own = vectors.join(centre, label).withColumn("s", alignment(cosine(F.col(vector), F.col("centre"))))
    return own.groupBy(label).agg(F.count("*").cast("long").alias("n"), F.round(F.avg("s"), digits).alias("avg_similarity"), F.round(F.min("s"), digits).alias("min_similarity"), F.round(F.max("s"), digits).alias("max_similarity"))


def issues(metrics: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """Status of each database from deny_rate, max_overlap, std_coverage and avg_coverage; null metrics raise no issue."""
    c = F.col
    found = F.array_compact(
        F.array(
            F.when(c("deny_rate") < limits["deny_low"], "deny rate too low"),
            F.when(c("deny_rate") > limits["deny_high"], "deny rate too high"),
            F.when(c("max_overlap") > limits["overlap"], "roles overlap"),
            F.when(c("std_coverage") < limits["std"], "roles alike in coverage"),
            F.when(c("avg_coverage") > limits["coverage"], "roles cover too much"),
        )
    )
    out = metrics.withColumn("issues", F.array_join(found, "; "))
    return out.withColumn("status", F.when(F.col("issues") == "", "OK").otherwise("WARN"))


def strict_audit(deny: DataFrame, overlap: DataFrame, cover: DataFrame, by: str = "db_id") -> DataFrame:
    """Deny rate, overlap and spread of coverage side by side with one verdict; a missing metric does not fail."""
    out = deny.select(by, "deny_rate").join(overlap.select(by, "max_overlap"), by, "left").join(cover.select(by, "std_coverage"), by, "left")
    bad = (F.col("deny_rate") > STRICT["deny_high"]) | F.coalesce(F.col("max_overlap") > STRICT["overlap"], F.lit(False)) | F.coalesce(F.col("std_coverage") < STRICT["std"], F.lit(False))
    return out.withColumn("verdict", F.when(bad, "WARN").otherwise("OK"))


def report(metrics: DataFrame, databases: DataFrame, by: str = "db_id", limits: dict[str, float] = LIMITS) -> DataFrame:
    """A row for each database: its issues in the order of the metrics, and whether it has any; and one for all (``by`` null) with the pass rate.

    metrics has deny_rate, max_overlap, std_coverage and avg_coverage where they are known; databases without any pass.
    """
    found = issues(metrics, limits).select(F.col(by).alias("_d"), "issues")
    each = databases.select(by).distinct().join(found, F.col(by) == F.col("_d"), "left").select(by, F.coalesce("issues", F.lit("")).alias("issues"))
    rows = each.groupingSets([[F.col(by), F.col("issues")], []], by, "issues").agg(F.grouping_id().alias("g"), F.count("*").cast("long").alias("databases"), F.count_if(F.col("issues") != "").cast("long").alias("with_issues"))
    return rows.select(by, F.when(F.col("g") == 0, F.col("issues")).alias("issues"), "databases", "with_issues", F.round(ratio(F.col("databases") - F.col("with_issues"), F.col("databases")), 6).alias("pass_rate"))


def manager_validation(cases: DataFrame, role: str = "role", manager: str = "SystemManager") -> DataFrame:
    """Whether the managing role is allowed everything: one row, valid without any of its cases."""
    own = F.col(role) == manager
    out = cases.agg(F.count_if(own).cast("long").alias("cases"), F.count_if(own & F.col("gold_allowed")).cast("long").alias("allowed"))
    return out.withColumn("share", F.round(ratio(F.col("allowed"), F.col("cases")), 6)).withColumn("valid", F.col("allowed") == F.col("cases"))


def plot_data(points: DataFrame, digits: int = 4) -> DataFrame:
    """Chart points of ``covered``, ``total`` and ``similarity``: coverage held to 0..1, the marker's size by it, and similarity scaled to 0..1 over all points (0.5 where they agree)."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio(F.col("covered"), F.col("total"))))
    ends = points.agg(F.min("similarity").alias("_lo"), F.max("similarity").alias("_hi"))
    wide = points.crossJoin(F.broadcast(ends))  # one row beside
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col("similarity") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.5)
    return wide.select(*points.columns, F.round(share, digits).alias("coverage"), F.round(90 + 220 * share, digits).alias("marker"), F.round(scaled, digits).alias("scaled"))
