"""Steps around an evaluation: cached results, exposure, audits, selections, previews and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import digests
from ..functions.numeric import ratio, spread

#: The role that holds everything, and limits of the role-set comparison and of the strict deny audit.
MANAGER = "SystemManager"
SET_LIMITS = {"coverage": 0.90, "std": 0.065, "overlap": 0.90}
DENY_LIMITS = (5.0, 85.0)


def with_cached(cases: DataFrame, cache: DataFrame, key: str = "source_index", value: str = "execution_correct") -> DataFrame:
    """cases whose ``value`` is the cached one where the cache has the key; ``from_cache`` says where."""
    held = cache.select(F.col(key).alias("_ck"), F.col(value).alias("_cv"), F.lit(True).alias("_hit"))
    joined = cases.join(held, F.col(key) == F.col("_ck"), "left")
    return joined.withColumn(value, F.when(F.col("_hit"), F.col("_cv")).otherwise(F.col(value))).withColumn("from_cache", F.coalesce("_hit", F.lit(False))).drop("_ck", "_cv", "_hit")


def cache_problems(cache: DataFrame, cases: DataFrame, bound: list[str], key: str = "source_index", value: str = "execution_correct") -> DataFrame:
    """Cache rows that may not be used: repeated, of no case, without a result, or bound to another text than the case's."""
    times = cache.groupBy(key).agg(F.count("*").alias("times"))
    other = cases.select(F.col(key).alias("_k"), *[F.col(b).alias(f"_{b}") for b in bound])
    joined = cache.join(times, key).join(other, F.col(key) == F.col("_k"), "left")
    differs = F.lit(False)
    for b in bound:
        differs = differs | ~F.col(b).eqNullSafe(F.col(f"_{b}"))
    problem = F.when(F.col("times") > 1, "repeated").when(F.col("_k").isNull(), "no case").when(F.col(value).isNull(), "no result").when(differs, "other text")
    return joined.select(key, problem.alias("problem")).where("problem is not null").distinct()


#: The digests by which a cached result is bound to a case.
BOUND = ("row_sha256", "prediction_sha256", "gold_sql_sha256")


def bindings(rows: DataFrame, predictions: DataFrame, key: str = "source_index", record: str = "record", prediction: str = "prediction") -> DataFrame:
    """key and the three digests that a cached result of each case must carry: of its JSON record, its exact prediction and its gold statement."""
    said = predictions.select(F.col(key).alias("_k"), F.sha2(F.coalesce(prediction, F.lit("")), 256).alias("prediction_sha256"))
    named = rows.select(key, digests.digest(F.col(record)).alias("row_sha256"), F.sha2(digests.canonical_gold(F.col(record)), 256).alias("gold_sql_sha256"))
    return named.join(said, F.col(key) == F.col("_k")).select(key, *BOUND)


def binding_problems(cache: DataFrame, bound: DataFrame, key: str = "source_index", value: str = "execution_correct") -> DataFrame:
    """key and problem of cached results that must not be used: 'repeated', 'out of range' (no such case), or the digest that differs.

    Digests that a cached result lacks differ. ``value`` may be true, false or null; its type is the schema's affair.
    """
    times = cache.groupBy(F.col(key).alias("_c")).agg(F.count("*").alias("_n"))
    other = bound.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in BOUND])
    joined = cache.select(key, *BOUND).join(times, F.col(key).eqNullSafe(F.col("_c"))).join(other, F.col(key) == F.col("_k"), "left")
    problem = F.when(F.col("_n") > 1, "repeated").when(F.col("_k").isNull(), "out of range")
    for c in BOUND:
        problem = problem.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), c)
    return joined.select(key, problem.alias("problem")).where("problem is not null").distinct()


def bound_results(cache: DataFrame, bound: DataFrame, key: str = "source_index", value: str = "execution_correct") -> DataFrame:
    """key and value of the cached results; any problem is an error that names the first."""
    first = binding_problems(cache, bound, key, value).orderBy(F.asc_nulls_first(key)).first()
    if first is not None:
        raise ValueError(f"cached results do not fit the cases: {first['problem']} at {first[key]}")
    return cache.select(key, value)


def needed(trials: DataFrame, key: str = "source_index") -> DataFrame:
    """Each case that any trial draws, once."""
    return trials.select(key).distinct()


def exposure_metrics(violations: DataFrame, by: str, digits: int = 6) -> DataFrame:
    """Violations by what they show of the schema: hidden columns that exist, invented ones, or allowed ones only; with all in one row."""
    counts = violations.cube(by).agg(
        F.grouping(by).alias("whole"), *[F.count_if(F.col("exposure") == k).cast("long").alias(n) for k, n in (("valid_guess", "valid_guess"), ("invalid_guess", "invalid_guess"), ("no_unauthorized", "no_unauthorized"))], F.count("*").cast("long").alias("total_violations")
    )
    named = counts.withColumn(by, F.when(F.col("whole") == 1, "all").otherwise(F.col(by))).drop("whole")
    return named.select("*", *[F.round(ratio(F.col(n), F.col("total_violations")), digits).alias(f"{n}_rate") for n in ("valid_guess", "invalid_guess", "no_unauthorized")])


def other_than(rows: DataFrame, role: str = "role", manager: str = MANAGER) -> DataFrame:
    """Rows of roles other than the manager; a missing role counts as another."""
    return rows.where(F.coalesce(F.col(role) != manager, F.lit(True)))


def no_admins(rows: DataFrame, role: str = "role") -> DataFrame:
    """Rows whose role's name has no ``admin`` in it."""
    return rows.where(~F.lower(F.coalesce(F.col(role), F.lit(""))).contains("admin"))


def manager_free_deny(cases: DataFrame, manager: str = MANAGER, limits: tuple[float, float] = DENY_LIMITS, digits: int = 6) -> DataFrame:
    """Deny rate of each database without the manager's cases, and whether it lies within the limits."""
    out = other_than(cases, manager=manager).groupBy("db_id").agg(F.count("*").cast("long").alias("total"), F.count_if(~F.coalesce("gold_allowed", F.lit(False))).cast("long").alias("denied"))
    rate = 100 * ratio(F.col("denied"), F.col("total"))
    return out.select("db_id", "total", "denied", F.round(rate, digits).alias("deny_rate"), F.when(rate.between(*limits), "OK").otherwise("WARN").alias("status"))


def selected_roles(old: DataFrame, new: DataFrame, chosen: DataFrame) -> DataFrame:
    """Roles of two sets by the lists in chosen(db_id, version, role), where the role ``*`` takes all of a database."""

    def take(rows: DataFrame, version: str) -> DataFrame:
        mine = chosen.where(F.col("version") == version)
        everything = mine.where("role = '*'").select("db_id").distinct()
        named = mine.where("role <> '*'").select("db_id", "role").distinct()
        both = rows.join(everything, "db_id", "left_semi").unionByName(rows.join(everything, "db_id", "left_anti").join(named, ["db_id", "role"], "left_semi"))
        return both.withColumn("version", F.lit(version))

    return take(old, "OLD").unionByName(take(new, "NEW"))


def role_set_compare(sizes: DataFrame, overlaps: DataFrame, digits: int = 6) -> DataFrame:
    """Coverage and greatest overlap of each version's roles, with a verdict on each.

    sizes: db_id, version, role, held, columns (of the schema); overlaps: db_id, version, overlap (of pairs of roles).
    """
    share = ratio(F.col("held"), F.col("columns"))
    own = sizes.groupBy("db_id", "version").agg(F.avg(share).alias("coverage"), spread(share).alias("coverage_std"))
    most = overlaps.groupBy("db_id", "version").agg(F.max("overlap").alias("max_overlap"))
    out = own.join(most, ["db_id", "version"], "left").withColumn("max_overlap", F.coalesce("max_overlap", F.lit(0.0)))
    verdict = lambda bad: F.when(bad, "WARN").otherwise("OK")
    return out.select(
        "db_id", "version", *[F.round(c, digits).alias(c) for c in ("coverage", "coverage_std", "max_overlap")], verdict(F.col("coverage") > SET_LIMITS["coverage"]).alias("coverage_status"),
        verdict(F.col("coverage_std") < SET_LIMITS["std"]).alias("std_status"), verdict(F.col("max_overlap") > SET_LIMITS["overlap"]).alias("overlap_status"),
    )


def allow_set_missing(need: DataFrame, allowed: DataFrame) -> DataFrame:
    """Needs (case_id, kind, table_name, column_name) that the allow sets (kind, table_name, column_name) lack.

    Inserts, deletes and DDL are allowed by table, reads and writes by column or by ``*``. Where no write is listed at
    all, writes are not checked.
    """
    by_column = F.col("kind").isin("read", "write")
    held = allowed.select("kind", "table_name", F.when(by_column, F.col("column_name")).alias("column_name")).distinct()
    listed = held.select("kind").distinct()
    asked = need.where("kind <> 'write'").unionByName(need.where("kind = 'write'").join(listed.where("kind = 'write'"), "kind", "left_semi"))
    whole = held.where("column_name = '*' or column_name is null").select("kind", "table_name")
    return asked.join(whole, ["kind", "table_name"], "left_anti").join(held.where("column_name is not null"), ["kind", "table_name", "column_name"], "left_anti").select("case_id", "kind", "table_name", "column_name")


def schema_of(rows: DataFrame, schemas: DataFrame, suffix: str = "_M") -> DataFrame:
    """rows with the columns of their database's schema, or of the database named without the suffix; null where neither is known."""
    own = schemas.select(F.col("db_id").alias("_d"), F.col("columns").alias("_own"))
    base = schemas.select(F.col("db_id").alias("_b"), F.col("columns").alias("_base"))
    stem = F.regexp_replace("db_id", f"{suffix}$", "")
    return rows.join(own, F.col("db_id") == F.col("_d"), "left").join(base, stem == F.col("_b"), "left").withColumn("columns", F.coalesce("_own", "_base")).drop("_d", "_own", "_b", "_base")


def permission_of(allowed: Column, nested: Column) -> Column:
    """allowed or denied: by the flat flag where there is one, else by the nested field, else denied."""
    return F.when(allowed.isNotNull(), F.when(allowed, "allowed").otherwise("denied")).otherwise(F.coalesce(nested, F.lit("denied")))


def panels(rows: DataFrame, key: str, size: int) -> DataFrame:
    """The distinct keys in order, dealt to panels of ``size``; the keys are names of databases, few by nature."""
    order = Window.orderBy(key)
    return rows.select(key).distinct().withColumn("panel", F.floor((F.row_number().over(order) - 1) / size).cast("int"))


def ranked(column: str, order: list[str], unknown: int = 999) -> Column:
    """The place of a value in a list of names; others come last."""
    out = F.lit(unknown)
    for i, name in reversed(list(enumerate(order))):
        out = F.when(F.col(column) == name, i).otherwise(out)
    return out


def sampled_listing(rows: DataFrame, by: str, key: str, n: int = 5, seed: int = 42) -> DataFrame:
    """At most n rows of each value of ``by``, drawn by a hash of the key, so that a repeated run lists the same."""
    drawn = F.crc32(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(drawn, key))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def usage_statistics(calls: DataFrame, by: str, digits: int = 6) -> DataFrame:
    """Calls, cache hits and their share, tokens and tokens a second of each ``by``; calls has cached, tokens and seconds."""
    out = calls.groupBy(by).agg(F.count("*").cast("long").alias("calls"), F.count_if("cached").cast("long").alias("hits"), F.sum("tokens").cast("long").alias("tokens"), F.sum("seconds").cast("long").alias("seconds"))
    return out.select("*", F.round(ratio(F.col("hits"), F.col("calls")), digits).alias("hit_rate"), F.round(ratio(F.col("tokens"), F.col("seconds")), digits).alias("tokens_per_second"))


def database_statistics(files: DataFrame, tables: DataFrame) -> DataFrame:
    """For each database whether it has a database file and a schema, and how many tables."""
    kinds = files.groupBy("db_id").agg(F.bool_or(F.col("kind") == "sqlite").alias("has_sqlite"), F.bool_or(F.col("kind") == "schema").alias("has_schema"))
    counts = tables.groupBy("db_id").agg(F.countDistinct("table_name").cast("long").alias("table_count"))
    return kinds.join(counts, "db_id", "left").withColumn("table_count", F.coalesce("table_count", F.lit(0).cast("long")))


def table_roles(column_roles: DataFrame, by: list[str]) -> DataFrame:
    """Roles over columns as roles over whole tables."""
    return column_roles.groupBy(*by).agg(F.array_sort(F.collect_set("table_name")).alias("tables"))


def meaning_preview(meanings: DataFrame, key: str = "key", tables: int = 6, columns: int = 4) -> DataFrame:
    """Keys ``database|table|column`` in parts, of each database the first tables and of each of these the first columns, by name."""
    part = F.split(F.col(key), r"\|")
    named = meanings.select(part[0].alias("db_id"), part[1].alias("table_name"), part[2].alias("column_name")).where("column_name is not null")
    t = F.dense_rank().over(Window.partitionBy("db_id").orderBy("table_name"))
    c = F.row_number().over(Window.partitionBy("db_id", "table_name").orderBy("column_name"))
    return named.select("*", t.alias("t"), c.alias("c")).where((F.col("t") <= tables) & (F.col("c") <= columns)).drop("t", "c")
