"""Readers of datasets, predictions, policies and schemas."""

from __future__ import annotations

import csv
import io
import re
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..plans.sqlfront import Unsupported, tokenize
from . import arrays

#: Column-level cases; policies stay JSON text because their keys are table names.
CASE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("db_id", "instruction", "role", "input", "output", "difficulty", "gold_sql", "question_id", "permission")]
    + [T.StructField("allowed", T.BooleanType()), T.StructField("policy", T.StringType()), T.StructField("metadata", T.StringType())]
)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_index, line) of a file, a folder or a pattern, blank lines included; a file's byte-order mark is dropped.

    Files are read in splits. A split's lines are numbered within it, and the splits' counts, one row each, say where
    each begins, so that a file of any length needs neither one task nor a sort. Numbered parts go by number, other files by name.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("m"), "value")
    name = F.element_at(F.split("file", "/"), -1)
    part = F.coalesce(F.expr("try_cast(regexp_extract(element_at(split(file, '/'), -1), '^part-([0-9]+)', 1) as bigint)"), F.lit(-1))
    blocks = read.groupBy("file", "at").agg(F.count("*").alias("n"), F.min("m").alias("first"))
    before = F.sum("n").over(Window.orderBy(part, name, "file", "at").rowsBetween(Window.unboundedPreceding, -1))  # one row a split
    starts = blocks.select("file", "at", "first", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    line = F.when((F.col("at") == 0) & (F.col("m") == F.col("first")), F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value"))
    return read.join(starts, ["file", "at"]).select((F.col("m") + F.col("shift")).alias("source_index"), line.alias("line"))


def read_records(spark: SparkSession, path: str, schema: T.StructType = CASE) -> DataFrame:
    """JSON arrays (``.json``) or JSON lines (``.jsonl``), a file, folder or pattern, with the record's number; anything else is an error. Both are read in splits."""
    if path.endswith(".jsonl"):
        rows = _lines(spark, path).where(F.trim("line") != "")
        parsed = rows.select("source_index", F.from_json("line", schema).alias("r"))
    elif path.endswith(".json"):
        parsed = arrays.read_array(spark, path).select("source_index", F.from_json("record", schema).alias("r"))
    else:
        raise ValueError(f"neither .json nor .jsonl: {path}")
    return parsed.select("source_index", "r.*")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(source_index, prediction): a line each of a ``.sql`` file, or JSON records with one unambiguous key."""
    if path.endswith(".sql"):
        return _lines(spark, path).select("source_index", F.trim("line").alias("prediction"))
    keys = ("prediction", "pred_sql", "prediction_text")
    rows = read_records(spark, path, T.StructType([T.StructField(k, T.StringType()) for k in keys]))
    given = sum(F.col(k).isNotNull().cast("int") for k in keys)
    one = F.when(given == 1, F.coalesce(*keys)).otherwise(F.raise_error(F.lit("a prediction needs exactly one key")).cast("string"))
    return rows.select("source_index", one.alias("prediction"))


#: Saved answers under the names of either writer.
SAVED = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "instruction", "input", "question", "role", "policy", "gold_sql", "database", "difficulty", "operation", "category", "metadata", "prediction", "raw_response", "pred_sql", "cleaned_sql", "expected_action")]
    + [T.StructField("is_allowed", T.BooleanType())]
)


def harmonised(rows: DataFrame) -> DataFrame:
    """Saved answers under one set of names: an empty statement or answer gives way to its other name, a missing label to
    the expected action, and without either the case counts as allowed; missing texts are empty."""
    given = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b))
    return rows.withColumns(
        {
            "pred_sql": given("pred_sql", "cleaned_sql"),
            "prediction": given("prediction", "raw_response"),
            "is_allowed": F.coalesce("is_allowed", F.upper("expected_action") == "ALLOW", F.lit(True)),
            "input": F.coalesce("input", "question", F.lit("")),
            **{n: F.coalesce(n, F.lit("")) for n in ("id", "instruction", "gold_sql", "database")},
        }
    ).drop("cleaned_sql", "raw_response", "expected_action", "question")


def read_saved(spark: SparkSession, path: str, max_samples: int | None = None) -> DataFrame:
    """Saved answers of a JSON array or JSON lines, the first ``max_samples`` of them if given."""
    rows = harmonised(read_records(spark, path, SAVED))
    return rows if max_samples is None else rows.where(F.col("source_index") < max_samples)


def align(rows: DataFrame, predictions: DataFrame, strict: bool = True) -> DataFrame:
    """Rows with their predictions by number; unequal numbers are an error, or cut to the shorter if not strict."""
    if strict:
        counts = rows.agg(F.count("*").alias("a")).join(predictions.agg(F.count("*").alias("b")), how="cross").first()  # one row each
        if counts["a"] != counts["b"]:
            raise ValueError(f"{counts['a']} rows but {counts['b']} predictions")
    return rows.join(predictions, "source_index")


def role_assignments(spark: SparkSession, path: str) -> DataFrame:
    """(db_id, role_ord, role, description, policy as JSON) from ``{db: [role]}``, with or without an ``assignments`` wrapper."""
    role = "role string, description string, policy string, tables string, columns string"
    kind = f"map<string, array<struct<{role.replace(' string', ': string')}>>>"
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"))
    body = F.coalesce(F.get_json_object("v", "$.assignments"), F.col("v"))
    dbs = text.select(F.explode(F.from_json(body, kind)).alias("db_id", "roles"))
    return dbs.select("db_id", F.posexplode("roles").alias("role_ord", "r")).select("db_id", "role_ord", "r.role", "r.description", F.coalesce("r.policy", "r.tables", "r.columns").alias("policy"))


def explode_policy(df: DataFrame, policy: str = "policy") -> DataFrame:
    """(.., table_name, column_name) of column-level policies; an empty list gives one row with an empty column."""
    kept = [c for c in df.columns if c != policy]
    rows = df.select(*kept, F.explode(F.from_json(policy, "map<string, array<string>>")).alias("table_name", "cols"))
    return rows.select(*kept, "table_name", F.explode(F.when(F.size("cols") > 0, F.col("cols")).otherwise(F.array(F.lit("")))).alias("column_name"))


def sqlite_schema(path: str) -> dict[str, list[str]]:
    """Tables and views of a SQLite file with their visible columns, read without running a query on the data."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        names = [r[0] for r in con.execute("select name from sqlite_master where type in ('table', 'view') and name not like 'sqlite_%' order by name")]
        return {n: [r[1] for r in con.execute(f'pragma table_xinfo("{n}")') if r[6] != 1] for n in names}


def ddl_schema(text: str) -> dict[str, list[str]]:
    """Tables and columns of CREATE TABLE statements; constraints are not columns."""
    out: dict[str, list[str]] = {}
    for m in re.finditer(r"(?is)\bcreate\s+(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?((?:\"[^\"]+\"|`[^`]+`|[\w$]+)(?:\s*\.\s*(?:\"[^\"]+\"|`[^`]+`|[\w$]+))?)\s*\(", text):
        try:
            tokens = tokenize(text[m.end() :].split(";")[0])
        except Unsupported:
            continue
        depth, start, columns = 0, True, []
        for t in tokens:
            if t.up == ")" and depth == 0:
                break
            depth += {"(": 1, ")": -1}.get(t.up, 0)
            if start and t.kind in ("word", "name"):
                if not (t.kind == "word" and t.up in ("PRIMARY", "FOREIGN", "UNIQUE", "CHECK", "CONSTRAINT", "KEY", "INDEX", "EXCLUDE", "LIKE")):
                    columns.append(t.text)
                start = False
            if t.up == "," and depth == 0:
                start = True
        out[re.split(r"\s*\.\s*", m[1])[-1].strip('"`')] = columns
    return out


def schema_rows(spark: SparkSession, schemas: dict[str, dict[str, list[str]]]) -> DataFrame:
    """(db_id, table_name, column_name, ordinal) of schema snapshots."""
    rows = [(d, t, c, i) for d, tables in schemas.items() for t, cs in tables.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "db_id string, table_name string, column_name string, ordinal int")


# The columns that a description file must have, and encodings in the order in which they are tried.
DESCRIBED = ("original_column_name", "column_name", "column_description", "data_format", "value_description")
ENCODINGS = ("utf-8", "latin-1", "cp1252")


def descriptions(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """Rows of column-description CSVs (a file, folder or pattern): file, table_name (the file's stem), place, encoding and the five columns.

    Each file is decoded strictly by the first encoding that fits all its bytes. A file without all five columns, or that
    no encoding fits, is an error that names it; empty cells are null, and a byte-order mark is dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for encoding in encodings:
                    try:
                        text = body.decode(encoding)
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    raise ValueError(f"no encoding fits {name}")
                rows = list(csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline="")))
                head = [x.strip() for x in rows[0]] if rows else []
                if lacking := [c for c in DESCRIBED if c not in head]:
                    raise ValueError(f"missing columns in {name}: {', '.join(lacking)}")
                found = [[name, name.rsplit("/", 1)[-1].removesuffix(".csv"), i, encoding, *[(r[head.index(c)] if head.index(c) < len(r) else "") or None for c in DESCRIBED]] for i, r in enumerate(x for x in rows[1:] if x)]
                columns = list(zip(*found, strict=True)) if found else [()] * (4 + len(DESCRIBED))
                kinds = [pa.string(), pa.string(), pa.int32(), *[pa.string()] * (1 + len(DESCRIBED))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["file", "table_name", "place", "encoding", *DESCRIBED])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(path).select(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path"), "content")
    return files.mapInArrow(run, "file string, table_name string, place int, encoding string, " + ", ".join(f"{c} string" for c in DESCRIBED))


def parse_file_name(name: str | F.Column) -> list:
    """Columns model, mode and dataset from a prediction file's name."""
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.(jsonl?|sql)$", "")
    mode = F.when(stem.contains("baseline"), "baseline").when(stem.contains("structured"), "structured").otherwise("rbac")
    dataset = F.when(stem.contains("spider"), "spider").when(stem.contains("bird"), "bird").when(stem.contains("livesql"), "livesql").otherwise("unknown")
    model = F.regexp_replace(stem, r"_?(baseline|structured|rbac|spider|bird|livesqlbench|livesql|predictions?|detailed).*$", "")
    return [model.alias("model"), mode.alias("mode"), dataset.alias("dataset")]
