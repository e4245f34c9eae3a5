"""Schemas as text for prompts: one row a database, from rows of its columns, by ordered lists and joins of strings.

Columns take their order from ``place``, tables from their names. A catalogue is one database's, so its text is one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns named in a summary, and characters of a value description before it is cut.
KEY_COLUMNS, VALUES = 5, 100


def _tables(columns: DataFrame, by: str, *fields: str) -> DataFrame:
    """by, table_name and cols: the table's columns in order, each a struct of place, column_name and the fields."""
    one = F.struct("place", "column_name", *fields)
    return columns.groupBy(by, "table_name").agg(F.array_sort(F.collect_list(one)).alias("cols"))


def _joined(tables: DataFrame, by: str, line: Column, between: str = "\n") -> DataFrame:
    """by, body (a line for each table, in order of names), n_tables and n_columns."""
    rows = tables.select(by, F.struct("table_name", line.alias("line")).alias("t"), F.size("cols").alias("n"))
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["line"]), between).alias("body"), F.count("*").alias("n_tables"), F.sum("n").alias("n_columns"))


def _names(cols: str | Column = "cols") -> Column:
    return F.array_join(F.transform(cols, lambda c: c["column_name"]), ", ")


def simple_text(columns: DataFrame, by: str = "db_id") -> DataFrame:
    """(by, text): ``Database:`` and a sentence for each table."""
    line = F.concat(F.lit("Table "), F.col("table_name"), F.lit(" has columns: "), _names(), F.lit("."))
    return _joined(_tables(columns, by), by, line).select(by, F.concat(F.lit("Database: "), F.col(by).cast("string"), F.lit("\n"), F.col("body")).alias("text"))


def sentences(columns: DataFrame, by: str = "db_id") -> DataFrame:
    """(by, text): the tables, each table's columns and primary key, and then the foreign keys, a sentence each.

    columns also has key_place (0 outside the primary key), ref_table and ref_column (null without a reference).
    """
    tables = _tables(columns, by, "key_place")
    keys = F.transform(F.array_sort(F.transform(F.filter("cols", lambda c: c["key_place"] > 0), lambda c: F.struct(c["key_place"], c["column_name"]))), lambda k: k["column_name"])
    key = F.when(F.size(keys) == 1, F.concat(F.lit("\n"), F.get(keys, F.lit(0)), F.lit(" is the primary key."))).when(F.size(keys) > 1, F.concat(F.lit("\nThe combination of ("), F.array_join(keys, ", "), F.lit(") are the primary key."))).otherwise("")
    line = F.concat(F.lit("Table "), F.col("table_name"), F.lit(" has columns such as "), _names(), F.lit("."), key)
    told = F.concat(F.lit("\nThe "), F.col("column_name"), F.lit(" of "), F.col("table_name"), F.lit(" is the foreign key of "), F.col("ref_column"), F.lit(" of "), F.col("ref_table"), F.lit("."))
    refs = columns.where("ref_table is not null and ref_column is not null").select(F.col(by).alias("_d"), F.struct("table_name", "place", told.alias("line")).alias("r"))
    refs = refs.groupBy("_d").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "").alias("refs"))
    names = tables.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list("table_name")), ", ").alias("names")).withColumnRenamed(by, "_n")
    whole = _joined(tables, by, line).join(names, F.col(by).eqNullSafe(F.col("_n"))).join(refs, F.col(by).eqNullSafe(F.col("_d")), "left")
    return whole.select(by, F.concat(F.col(by).cast("string"), F.lit(" contains tables such as "), F.col("names"), F.lit(".\n"), F.col("body"), F.coalesce("refs", F.lit(""))).alias("text"))


def _given(c: Column) -> Column:
    """A text that is there; empty cells and the word that stands for them count as absent."""
    return F.when((F.trim(c) != "") & (c != "nan"), c)


def described(columns: DataFrame, style: str = "detailed", by: str = "db_id") -> DataFrame:
    """(by, text) of described columns: detailed (every column with format, description and values), summary (the first
    ``KEY_COLUMNS`` of each table) or compact (``table[column(format), ...]``).

    columns also has data_format, column_description and value_description, which may be null.
    """
    form = lambda c: _given(c["data_format"])
    tables = _tables(columns, by, "data_format", "column_description", "value_description")
    head, many = F.concat(F.lit("Database: "), F.col(by).cast("string")), F.size("cols").cast("string")
    title = F.concat(F.lit("Table: "), F.col("table_name"), F.lit(" ("), many, F.lit(" columns)"))
    spaced = lambda c: F.concat(c["column_name"], F.coalesce(F.concat(F.lit(" ("), form(c), F.lit(")")), F.lit("")))
    if style == "compact":
        tight = lambda c: F.concat(c["column_name"], F.coalesce(F.concat(F.lit("("), form(c), F.lit(")")), F.lit("")))
        line = F.concat(F.col("table_name"), F.lit("["), F.array_join(F.transform("cols", tight), ", "), F.lit("]"))
        return _joined(tables, by, line, "; ").select(by, F.concat(head, F.lit("\nTables: "), F.col("body")).alias("text"))
    if style == "summary":
        more = F.when(F.size("cols") > KEY_COLUMNS, F.concat(F.lit("  ... and "), (F.size("cols") - KEY_COLUMNS).cast("string"), F.lit(" more columns\n"))).otherwise("")
        line = F.concat(title, F.lit("\n  Key columns: "), F.array_join(F.transform(F.slice("cols", 1, KEY_COLUMNS), spaced), ", "), F.lit("\n"), more)
        return _joined(tables, by, line).select(by, F.concat(head, F.lit("\nTables: "), F.col("n_tables").cast("string"), F.lit(", Columns: "), F.col("n_columns").cast("string"), F.lit("\n\n"), F.col("body")).alias("text"))
    if style != "detailed":
        raise ValueError(f"unknown style {style}; known: detailed, summary, compact")
    values = lambda c: F.trim(_given(c["value_description"]))
    cut = lambda v: F.when(F.char_length(v) > VALUES, F.concat(F.left(v, F.lit(VALUES)), F.lit("..."))).otherwise(v)
    full = lambda c: F.concat(F.lit("• "), spaced(c), F.coalesce(F.concat(F.lit(": "), _given(c["column_description"])), F.lit("")), F.coalesce(F.concat(F.lit("\n  Values: "), cut(values(c))), F.lit("")))
    line = F.concat(F.lit("\n"), title, F.lit("\n"), F.repeat(F.lit("-"), F.char_length(title)), F.lit("\n"), F.array_join(F.transform("cols", full), "\n"))
    counts = F.concat(F.lit("\nTotal Tables: "), F.col("n_tables").cast("string"), F.lit("\nTotal Columns: "), F.col("n_columns").cast("string"), F.lit("\n\nTable Schemas:\n"))
    return _joined(tables, by, line).select(by, F.concat(head, counts, F.col("body")).alias("text"))
