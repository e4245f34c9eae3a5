"""Datasets of questions, roles and labels from queries and policies."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import sampling


def gold_label(permission: Column, allowed: Column) -> Column:
    """The explicit label; conflicting labels and missing ones are errors, never ALLOW."""
    said = F.when(permission == "allowed", True).when(permission == "denied", False)
    bad = (said.isNotNull() & allowed.isNotNull() & (said != allowed)) | (said.isNull() & allowed.isNull())
    return F.when(bad, F.raise_error(F.lit("missing or conflicting gold permission")).cast("boolean")).otherwise(F.coalesce(said, allowed))


def gold_sql(*candidates: Column) -> Column:
    """The first that is not empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit(""))


def question_key(question_id: Column, text: Column, index: Column) -> Column:
    trimmed = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(trimmed(question_id), trimmed(text), F.concat(F.lit("question_"), index.cast("string")))


def question_key_crud(instance_id: Column, db_id: Column, question: Column) -> Column:
    return F.coalesce(F.nullif(instance_id, F.lit("")), F.concat(F.coalesce(db_id, F.lit("")), F.lit("||"), F.coalesce(question, F.lit(""))))


def expand(queries: DataFrame, roles: DataFrame, on: str = "db_id") -> DataFrame:
    """Every query with every role of its database."""
    return queries.join(roles, on)


def deterministic_roles(catalog: DataFrame, by: list[str], columns: int = 5) -> DataFrame:
    """ReadOnly (first half of the tables, first columns of each), Editor (all columns) and SystemManager (``*``)."""
    tables = catalog.groupBy(*by, "table_name").agg(F.array_sort(F.collect_set("column_name")).alias("cols"))
    place = tables.groupBy(*by).agg(F.array_sort(F.collect_set("table_name")).alias("names"))
    held = tables.join(place, by) if by else tables.crossJoin(F.broadcast(place))  # one row beside
    first = F.array_position("names", F.col("table_name")) <= F.greatest(F.lit(1), F.expr("size(names) div 2"))
    roles = F.array(F.struct(F.lit("ReadOnly").alias("role"), F.when(first, F.slice("cols", 1, columns)).alias("c")), F.struct(F.lit("Editor").alias("role"), F.col("cols").alias("c")), F.struct(F.lit("SystemManager").alias("role"), F.array(F.lit("*")).alias("c")))
    each = held.select(*by, "table_name", F.explode(roles).alias("r")).where("r.c is not null")
    return each.select(*by, F.col("r.role").alias("role"), "table_name", F.explode("r.c").alias("column_name"))


def operator_policies(schema: dict[str, list[str]], seed: int) -> list[dict[str, list[str]]]:
    """Random operator policies of one database: all columns of a table half of the time, else some, at most nine tenths."""
    draw = random.Random(seed)
    out = []
    for _ in range(3 if len(schema) >= 3 else 2):
        policy: dict[str, list[str]] = {}
        for table, columns in schema.items():
            if draw.random() < 0.5:
                policy[table] = ["*"]
                continue
            some = [c for c in columns if draw.random() < 0.7] or [draw.choice(columns)]
            policy[table] = sorted(some[: max(1, int(0.9 * len(columns)))])
        out.append(policy)
    return out


def split_train(df: DataFrame, key: str, share: float = 0.95, seed: int = 42) -> DataFrame:
    """df with split: train or validation by a hash of the key, so that a row always falls on the same side."""
    return df.withColumn("split", F.when(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(10_000)) < int(share * 10_000), "train").otherwise("validation"))


def operator_grants(schema: DataFrame, seed: int = 42, whole: float = 0.5, share: float = 0.7, most: float = 0.9) -> DataFrame:
    """(db_id, role, table_name, column_name): overlapping operator policies of every database, drawn by hash.

    A database of three tables or more has three operators, others two. An operator holds all columns of a table (``*``)
    with chance ``whole``; else each column with chance ``share``, at least one and at most ``most`` of them. The draw
    depends on the seed and the names alone, so it is the same wherever it is made.
    """
    scale = 1 << sampling.BITS
    number = lambda *keys: sampling.drawn_number(seed, *[F.col(k) for k in keys])
    names = schema.select("db_id", "table_name", "column_name").distinct()
    tables = names.groupBy("db_id", "table_name").agg(F.count("*").alias("n"))
    operators = tables.groupBy("db_id").agg(F.when(F.count("*") >= 3, 3).otherwise(2).alias("k")).select("db_id", F.explode(F.sequence(F.lit(1), "k")).alias("i"))
    each = tables.join(operators, "db_id").withColumn("all", number("db_id", "i", "table_name") < int(whole * scale))
    columns = each.where("not all").join(names, ["db_id", "table_name"]).withColumn("at", number("db_id", "i", "table_name", "column_name"))
    placed = columns.withColumn("place", F.row_number().over(Window.partitionBy("db_id", "i", "table_name").orderBy("at", "column_name")))
    some = placed.where((F.col("place") == 1) | (F.col("at") < int(share * scale)) & (F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("n") * most))))
    held = each.where("all").select("db_id", "i", "table_name", F.lit("*").alias("column_name")).unionByName(some.select("db_id", "i", "table_name", "column_name"))
    return held.select("db_id", F.concat(F.lit("DataOperator_"), F.col("i").cast("string")).alias("role"), "table_name", "column_name")


def expand_managers(cases: DataFrame, required: DataFrame, grants: DataFrame, case: str = "case_id", manager: str = "SystemManager") -> DataFrame:
    """(case, db_id, role, allowed) without the managing role: each of its cases becomes one of every operator of the database.

    An operator is allowed a case if it holds every column that ``required`` (case, db_id, table_name, column_name) names, by
    name or by the table's wildcard; a case that needs nothing is allowed. Cases of other roles stay as they are. Names
    are compared as they are written.
    """
    own = cases.where(F.col("role") == manager).select(case, "db_id").distinct()
    each = own.join(grants.select("db_id", "role").distinct(), "db_id")
    needs = each.join(required.select(case, "db_id", "table_name", "column_name").distinct(), [case, "db_id"])
    lacking = needs.join(grants.where("column_name = '*'").drop("column_name"), ["db_id", "role", "table_name"], "left_anti").join(grants, ["db_id", "role", "table_name", "column_name"], "left_anti")
    bad = lacking.select(case, "db_id", "role").distinct().withColumn("_bad", F.lit(True))
    made = each.join(bad, [case, "db_id", "role"], "left").select(case, "db_id", "role", F.col("_bad").isNull().alias("allowed"))
    return cases.where(F.coalesce(F.col("role") != manager, F.lit(True))).select(case, "db_id", "role", "allowed").unionByName(made)
