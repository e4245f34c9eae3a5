"""Permissions as bit sets over a database's catalogue, for coverage and overlap without joins on columns.

Every column that a database's schema or policies name gets an ordinal by one grouping and a running number; a role's
permission set is then the bits of its ordinals, 64 to a row (db_id, role, operation, word, bits). Wildcards and whole
tables are the schema table's own words. Sizes are bit counts, unions are ``bit_or``, and what two roles share is AND of
words that meet by number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import steps
from ..functions.numeric import ratio
from . import overlap, quality

#: Whole-table operations; the others name columns.
TABLE_OPERATIONS = ("INSERT", "DELETE")
COLUMN_OPERATIONS = ("SELECT", "UPDATE")
#: Fixed value: the role that manages a database and is left out of its statistics.
MANAGER = "systemmanager"


def is_manager(role: Column) -> Column:
    return F.lower(F.trim(role)) == MANAGER


def _word(at: Column) -> list[Column]:
    return [F.floor(at / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(ordinal % 64 as int))").alias("bits")]


def permission_words(policies: DataFrame, schema: DataFrame) -> DataFrame:
    """(db_id, role, operation, word, bits) of all roles' permission sets; names are compared without case.

    policies has a row for each grant: db_id, role, operation, table_name and column_name, where SELECT and UPDATE name a
    column or ``*`` (the schema's columns of that table), and INSERT and DELETE a table. schema has db_id, table_name and
    column_name. Columns that only policies know are members like others; a table that the schema does not know has no
    columns, so whole-table grants on it are one member each, under the column ``*``.
    """
    low = lambda c: F.lower(F.col(c))
    grants = policies.where(F.col("operation").isin(*TABLE_OPERATIONS, *COLUMN_OPERATIONS)).select(
        "db_id", "role", "operation", low("table_name").alias("t"), F.when(F.col("operation").isin(*TABLE_OPERATIONS), "*").otherwise(low("column_name")).alias("c")
    ).distinct()
    known = schema.select("db_id", low("table_name").alias("t"), low("column_name").alias("c"), F.lit(True).alias("listed"))
    # a row for each name, however many hold it, with its ordinal; holders meet it by name
    names = grants.select("db_id", "t", "c", F.lit(False).alias("listed")).unionByName(known).groupBy("db_id", "t", "c").agg(F.max("listed").alias("listed"))
    numbered = names.withColumn("ordinal", F.row_number().over(Window.partitionBy("db_id").orderBy("t", "c")) - 1)
    n = numbered.select(F.col("db_id").alias("_d"), F.col("t").alias("_t"), F.col("c").alias("_c"), "ordinal")
    holders = grants.where("role is not null and c is not null").join(n, F.col("db_id").eqNullSafe(F.col("_d")) & F.col("t").eqNullSafe(F.col("_t")) & (F.col("c") == F.col("_c")))
    by_name = holders.where("c <> '*'").select("db_id", "role", "operation", *_word(F.col("ordinal")))
    tables = numbered.where("listed").select("db_id", "t", *_word(F.col("ordinal"))).groupBy("db_id", "t", "word").agg(F.bit_or("bits").alias("bits"))
    wild = holders.where("c = '*'").select("db_id", "t", "role", "operation", *[x.alias(f"own_{n}") for n, x in zip(("word", "bits"), _word(F.col("ordinal")), strict=True)])
    # whole tables: the schema's words of the table; where it has none, one member for a whole-table operation
    whole = wild.join(tables, ["db_id", "t"], "left").where(F.col("word").isNotNull() | F.col("operation").isin(*TABLE_OPERATIONS))
    whole = whole.select("db_id", "role", "operation", F.coalesce("word", "own_word").alias("word"), F.coalesce("bits", "own_bits").alias("bits"))
    return by_name.unionByName(whole).groupBy("db_id", "role", "operation", "word").agg(F.bit_or("bits").alias("bits"))


def _sizes(words: DataFrame, *by: str) -> DataFrame:
    return words.groupBy(*by).agg(F.sum(F.bit_count("bits")).cast("long").alias("n"))


def crud_coverage(policies: DataFrame, schema: DataFrame, digits: int = 6) -> DataFrame:
    """A row for each database with roles: tables, columns, roles, has_ddl, avg_permissions, and for each operation the mean and
    population deviation of its coverage over the roles, with their weighted deviation (coverage_std).

    SELECT and UPDATE cover columns, INSERT and DELETE tables that the schema lists. The managing role counts among the
    roles and for DDL only. A role without grants has a row of its own with a null operation. Databases without a schema
    cover nothing; names that a policy repeats count once.
    """
    totals = schema.groupBy("db_id").agg(F.countDistinct(F.lower("table_name")).alias("tables"), F.countDistinct(F.lower("table_name"), F.lower("column_name")).alias("columns"))
    roles = policies.groupBy("db_id", "role").agg(F.coalesce(F.bool_or(F.col("operation") == "DDL"), F.lit(False)).alias("ddl"))
    others = roles.where(~is_manager(F.col("role"))).select("db_id", "role")
    words = permission_words(policies, schema)
    by_column = _sizes(words.where(F.col("operation").isin(*COLUMN_OPERATIONS)), "db_id", "role", "operation")
    held = policies.where(F.col("operation").isin(*TABLE_OPERATIONS)).select("db_id", "role", "operation", F.lower("table_name").alias("t")).distinct()
    known = schema.select("db_id", F.lower("table_name").alias("t")).distinct()
    by_table = held.join(known, ["db_id", "t"], "left_semi").groupBy("db_id", "role", "operation").agg(F.count("*").cast("long").alias("n"))
    wide = by_column.unionByName(by_table).groupBy("db_id", "role").pivot("operation", [*COLUMN_OPERATIONS, *TABLE_OPERATIONS]).agg(F.sum("n"))
    every = _sizes(words, "db_id", "role").withColumnRenamed("n", "permissions")
    own = others.join(wide, ["db_id", "role"], "left").join(every, ["db_id", "role"], "left").join(totals, "db_id", "left")
    share = lambda op: ratio(F.coalesce(op, F.lit(0)), F.coalesce(F.col("columns" if op in COLUMN_OPERATIONS else "tables"), F.lit(0)))
    own = own.select("db_id", F.coalesce("permissions", F.lit(0)).alias("permissions"), *[share(op).alias(op) for op in (*COLUMN_OPERATIONS, *TABLE_OPERATIONS)])
    stats = own.groupBy("db_id").agg(
        F.avg("permissions").alias("p"), *[F.avg(op).alias(f"a{op}") for op in quality.OPERATION_WEIGHTS], *[quality.spread(F.col(op)).alias(f"s{op}") for op in quality.OPERATION_WEIGHTS]
    )
    heads = roles.groupBy("db_id").agg(F.count("*").cast("long").alias("roles"), F.bool_or("ddl").alias("has_ddl"))
    out = heads.join(totals, "db_id", "left").join(stats, "db_id", "left")
    number = lambda c: F.round(F.coalesce(c, F.lit(0.0)), digits)
    weighted = sum((F.coalesce(F.col(f"s{op}"), F.lit(0.0)) * w for op, w in quality.OPERATION_WEIGHTS.items()), F.lit(0.0))
    return out.select(
        "db_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tables", "columns")], "roles", "has_ddl", number(F.col("p")).alias("avg_permissions"),
        *[number(F.col(f"a{op}")).alias(f"avg_{op.lower()}_coverage") for op in quality.OPERATION_WEIGHTS], *[number(F.col(f"s{op}")).alias(f"{op.lower()}_coverage_std") for op in quality.OPERATION_WEIGHTS],
        number(weighted).alias("coverage_std"),
    )


def select_coverage(policies: DataFrame, schema: DataFrame, digits: int = 6) -> DataFrame:
    """(db_id, role, selected, coverage): columns that each role may SELECT and their share of the schema's columns."""
    totals = schema.groupBy("db_id").agg(F.countDistinct(F.lower("table_name"), F.lower("column_name")).alias("columns"))
    sizes = _sizes(permission_words(policies, schema).where("operation = 'SELECT'"), "db_id", "role")
    roles = policies.select("db_id", "role").distinct().join(sizes, ["db_id", "role"], "left").join(totals, "db_id", "left")
    n = F.coalesce("n", F.lit(0))
    return roles.select("db_id", "role", n.cast("long").alias("selected"), F.round(ratio(n, F.coalesce("columns", F.lit(0))), digits).alias("coverage"))


def overlaps(policies: DataFrame, schema: DataFrame, operations: tuple[str, ...] | None = None, empty: float = 1.0, digits: int = 6) -> DataFrame:
    """(db_id, pairs, avg_overlap, max_overlap, role_a, role_b): Jaccard overlap of the permission sets of a database's roles.

    Managing roles and those with "admin" in their name are left out, and databases of fewer than two others. role_a and
    role_b are the first pair, by name, of the greatest overlap. Two empty sets overlap by ``empty``. ``operations``
    restricts the sets; without, all count and DDL is a member too.

    Roles with the same set are one class, and pairs of classes meet by blocks (``overlap``); equal roles and pairs that
    share nothing are counted by numbers alone.
    """
    policies, schema = made = steps.written(policies), steps.written(schema)  # read several times
    taken = ~is_manager(F.col("role")) & ~F.lower("role").contains("admin")
    words = permission_words(policies, schema).where(taken)
    if operations is None:
        ddl = policies.where((F.col("operation") == "DDL") & taken).select("db_id", "role", "operation", F.lit(0).alias("word"), F.lit(1).cast("long").alias("bits")).distinct()
        words = words.unionByName(ddl)
    else:
        words = words.where(F.col("operation").isin(*operations))
    roles = policies.where(taken).select("db_id", "role").distinct()
    every = [*COLUMN_OPERATIONS, *TABLE_OPERATIONS, "DDL"]
    place = F.col("word").cast("long") * len(every) + F.array_position(F.lit(every), F.col("operation")) - 1
    classes = steps.written(overlap.classes(words.select("db_id", "role", place.alias("word"), "bits"), roles.withColumn("loose", F.lit(0).cast("long")), "db_id", "role"))
    alike = classes.where("k > 1").withColumn("own", F.when(F.col("size") > 0, 1.0).otherwise(empty)).groupBy("db_id").agg(
        F.sum(F.expr("own * (k * (k - 1) div 2)")).alias("s"), F.min(F.struct((-F.round("own", digits)).alias("o"), F.col("first").alias("a"), F.col("second").alias("b"))).alias("f")
    )
    least = F.slice(F.array_sort(F.flatten(F.collect_list(F.array_compact(F.array("first", "second"))))), 1, 2)
    totals = classes.groupBy("db_id").agg(F.sum("k").alias("r"), least.alias("least")).select("db_id", "r", F.get("least", 0).alias("r1"), F.get("least", 1).alias("r2")).where("r > 1")
    met = overlap.totals(classes, "db_id", digits).join(alike, "db_id", "full")
    found = met.select("db_id", (F.coalesce("sum", F.lit(0.0)) + F.coalesce("s", F.lit(0.0))).alias("sum"), F.least("best", "f").alias("best"))
    pairs = F.expr("r * (r - 1) div 2")
    some = F.coalesce(F.col("best.o") < 0, F.lit(False))
    out = totals.join(found, "db_id", "left").select(
        "db_id", pairs.cast("long").alias("pairs"), F.round(F.coalesce("sum", F.lit(0.0)) / pairs, digits).alias("avg_overlap"), F.when(some, -F.col("best.o")).otherwise(0.0).alias("max_overlap"),
        F.when(some, F.col("best.a")).otherwise(F.col("r1")).alias("role_a"), F.when(some, F.col("best.b")).otherwise(F.col("r2")).alias("role_b"),
    )
    out = steps.written(out)  # a row for each database
    steps.release(classes, *made)
    return out
