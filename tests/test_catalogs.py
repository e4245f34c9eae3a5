"""The catalogue data source: files as partitions, keys, digests, push-down; the same from bytes."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from portcullis.sources import catalogs, records


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("dbs")
    for name, ddl in {
        "shop": "CREATE TABLE customer(id INTEGER PRIMARY KEY, name TEXT NOT NULL, Note TEXT); CREATE TABLE \"Order\"(id INT, cust INT REFERENCES customer(id), g INT GENERATED ALWAYS AS (id + 1) VIRTUAL, PRIMARY KEY (cust, id)); CREATE VIEW v AS SELECT name FROM customer",
        "tiny": "CREATE TABLE t(id INT, x INT, secret INT)",
        "none": "",
    }.items():
        (path / name).mkdir()
        con = sqlite3.connect(path / name / f"{name}.sqlite")
        con.executescript(ddl)
        con.commit()
        con.close()
    return path


def test_files_are_partitions(spark, folder):
    catalogs.register(spark)
    df = spark.read.format("sqlite_catalog").load(str(folder))
    assert df.rdd.getNumPartitions() == 3
    got = {(r.db_id, r.table_name, r.column_name): r for r in df.collect()}
    assert sorted({k[:2] for k in got}) == [("shop", "Order"), ("shop", "customer"), ("shop", "v"), ("tiny", "t")]
    assert got["shop", "v", "name"].kind == "view" and got["shop", "customer", "name"].not_null
    order = got["shop", "Order", "cust"]
    assert (order.ordinal, order.key_place, order.ref_table, order.ref_column) == (1, 1, "customer", "id") and got["shop", "Order", "id"].key_place == 2
    # SHA-256 of {"t":{"id":"TEXT","secret":"TEXT","x":"TEXT"}}
    assert {r.digest for r in df.where("db_id = 'tiny'").collect()} == {"45784c1ca77de0a9642deb24570faa9faa95d57af71040b1b653d93434374f2c"}
    assert catalogs.digest({"t": ["id", "x", "secret"]}) == got["tiny", "t", "x"].digest


def test_filters_leave_files_out(spark, folder):
    catalogs.register(spark)
    df = spark.read.format("sqlite_catalog").load(str(folder))
    for some in (df.where("db_id = 'tiny'"), df.where("db_id in ('tiny', 'none')"), df.where("db_id = 'tiny' and ordinal < 9")):
        assert some.count() == 3
    assert df.where("db_id = 'tiny'").rdd.getNumPartitions() == 1
    assert df.where("db_id = 'nothing'").count() == 0 and df.where("column_name = 'x'").count() == 1
    with pytest.raises(Exception, match="no database"):
        spark.read.format("sqlite_catalog").load(str(folder / "absent.sqlite")).collect()


def test_bytes_give_the_same(spark, folder):
    catalogs.register(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(folder)).select(F.regexp_extract("path", r"([^/]+)\.sqlite$", 1).alias("db_id"), "content")
    got = catalogs.catalog_of(files.unionByName(spark.createDataFrame([("null", None)], "db_id string, content binary")))
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.read.format("sqlite_catalog").load(str(folder)).collect()))
    small = got.where("kind = 'table'")
    marks = {r.db_id: r.schema_sha256 for r in catalogs.schema_digest(got).collect()}
    assert marks == {r.db_id: r.digest for r in got.collect()} and small.count() == 9
    assert records.sqlite_schema(str(folder / "tiny" / "tiny.sqlite")) == {"t": ["id", "x", "secret"]}


def test_digest_of_odd_names(spark):
    names = [("T", 'a"b'), ("T", "ünï"), ("T", "new\nline"), ("_x", "B"), ("Z", "b"), ("T", "back\\slash")]
    df = spark.createDataFrame([(1, *n) for n in names], "db_id int, table_name string, column_name string")
    tables = {}
    for t, c in names:
        tables.setdefault(t, []).append(c)
    assert catalogs.schema_digest(df).first().schema_sha256 == catalogs.digest(tables)
