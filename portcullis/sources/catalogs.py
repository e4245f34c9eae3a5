"""Catalogues of SQLite databases as a Spark data source, and the same from databases held as bytes.

    register(spark)
    spark.read.format("sqlite_catalog").load("/shared/databases")

Each database file is a partition and so a task of its own; a filter on ``db_id`` leaves out files without opening them. The path is a folder, a file or a glob
pattern that driver and executors see alike. For databases in a store that only Spark reads, ``catalog_of`` takes the
files' bytes (``spark.read.format("binaryFile")``).
"""

from __future__ import annotations

import glob
import hashlib
import json
import os
import sqlite3
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: A row for each visible column: its table or view, place, declared type, whether null is refused, its place in the primary
#: key (0: none), the column it refers to, and the digest of the whole catalogue.
SCHEMA = "db_id string, table_name string, kind string, column_name string, ordinal int, data_type string, not_null boolean, key_place int, ref_table string, ref_column string, digest string"
_NAMES = tuple(x.split()[0] for x in SCHEMA.split(", "))


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def digest(tables: dict[str, list[str]]) -> str:
    """SHA-256 of a schema's canonical JSON: names in lower case, tables and columns by name, every type written TEXT."""
    body = {t.lower(): {c.lower(): "TEXT" for c in cs} for t, cs in tables.items()}
    return hashlib.sha256(json.dumps(body, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def rows_of(con: sqlite3.Connection, db_id: str) -> list[tuple]:
    """Rows of SCHEMA for one open database; no statement runs on its data. Hidden columns are left out."""
    names = con.execute("select name, type from sqlite_master where type in ('table', 'view') and name not like 'sqlite_%' order by name").fetchall()
    found, tables = [], {}
    for table, kind in names:
        refs = {r[3]: (r[2], r[4]) for r in con.execute(f"pragma foreign_key_list({_quoted(table)})")}
        columns = [r for r in con.execute(f"pragma table_xinfo({_quoted(table)})") if r[6] != 1]
        tables[table] = [r[1] for r in columns]
        found += [(db_id, table, kind, r[1], i, r[2], bool(r[3]), r[5], *refs.get(r[1], (None, None))) for i, r in enumerate(columns)]
    mark = digest(tables)
    return [(*r, mark) for r in found]


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)


def _db_id(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        inside = os.path.isdir(path)
        found = glob.glob(os.path.join(path, "**", "*.sqlite"), recursive=True) if inside else glob.glob(path)
        if not found and not inside:
            raise FileNotFoundError(f"no database at {path}")
        self.files = sorted(found)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality with db_id, alone or in a list; Spark keeps the others."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("db_id",):
                self.files = [x for x in self.files if _db_id(x) == f.value]
            elif isinstance(f, In) and f.attribute == ("db_id",):
                self.files = [x for x in self.files if _db_id(x) in f.value]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_File(x) for x in self.files]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None or partition.value is None:  # no file is left
            return
        con = sqlite3.connect(f"file:{partition.value}?mode=ro&immutable=1", uri=True)
        try:
            yield from rows_of(con, _db_id(partition.value))
        finally:
            con.close()


class CatalogSource(DataSource):
    """``sqlite_catalog``: the catalogues of all databases (``*.sqlite``) under a path; the file's name is the db_id."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_catalog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options["path"].removeprefix("file://"))


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let the session hand filters to sources written in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CatalogSource)


def catalog_of(databases: DataFrame, db_id: str = "db_id", content: str = "content") -> DataFrame:
    """Rows of SCHEMA for databases held as bytes, one a row. Null contents have none; bytes that are no database are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column("db").to_pylist(), batch.column("body"), strict=True):
                if not body.is_valid or not len(body.as_buffer()):
                    continue
                con = sqlite3.connect(":memory:")
                try:
                    con.deserialize(body.as_py())
                    rows = rows_of(con, name)
                finally:
                    con.close()
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(_NAMES)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW, strict=True)], names=list(_NAMES))

    return databases.select(F.col(db_id).cast("string").alias("db"), F.col(content).alias("body")).mapInArrow(run, SCHEMA)


_ARROW = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.string())


def schema_digest(schema: DataFrame, by: str = "db_id") -> DataFrame:
    """(by, schema_sha256) of catalogues given as rows of table_name and column_name: the same digest, by built-in functions."""
    text = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    low = schema.select(by, F.lower("table_name").alias("t"), F.lower("column_name").alias("c")).distinct()
    tables = low.groupBy(by, "t").agg(F.array_sort(F.collect_list(F.struct("c", F.concat(text("c"), F.lit(':"TEXT"')).alias("j")))).alias("cs"))  # the columns of a table
    body = F.concat(text("t"), F.lit(":{"), F.array_join(F.transform("cs", lambda x: x["j"]), ","), F.lit("}"))
    whole = tables.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("t", body.alias("j")))).alias("ts"))
    return whole.select(by, F.sha2(F.concat(F.lit("{"), F.array_join(F.transform("ts", lambda x: x["j"]), ","), F.lit("}")), 256).alias("schema_sha256"))


def built(columns: DataFrame, by: Column, table: str = "table_name", column: str = "column_name") -> DataFrame:
    """(db_id, content): a SQLite database for each group, with its tables and columns and no rows. A catalogue is one task's."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        con = sqlite3.connect(":memory:")
        own: dict[str, list[str]] = {}
        for r in sorted(zip(group.column("t").to_pylist(), group.column("c").to_pylist(), strict=True)):
            own.setdefault(r[0], []).append(r[1])
        for t, cs in own.items():
            con.execute(f"CREATE TABLE {_quoted(t)} ({', '.join(f'{_quoted(c)} TEXT' for c in cs)}, PRIMARY KEY ({_quoted(cs[0])}))")
        body = con.serialize()
        con.close()
        return pa.table({"db_id": pa.array([key[0].as_py()]), "content": pa.array([body], pa.binary())})

    slim = columns.select(by.cast("string").alias("db"), F.col(table).alias("t"), F.col(column).alias("c")).distinct()
    return slim.groupBy("db").applyInArrow(run, "db_id string, content binary")
