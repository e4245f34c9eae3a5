"""Execution of statements, value slots, and writers with metadata."""

import json

import pytest
from pyspark.sql import functions as F

from portcullis.operators import execution as ex
from portcullis.sources import sinks


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT 1", True), ("  with a as (select 1) select * from a ;", True), ("(SELECT 1) UNION (SELECT 2)", True), ("SELECT REPLACE(a, 'x', 'y') FROM t", True),
        ("SELECT 'delete' AS word", True), ("SELECT 1; SELECT 2", False), ("DELETE FROM t", False), ("WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", False),
        ("SELECT a INTO b FROM t", False), ("SELECT a FROM t FOR UPDATE", False), ("", False), (None, False), ("garbage", False), ("SELECT 'open", False),
    ],
)
def test_read_only(sql, want):
    assert ex.read_only(sql) is want


@pytest.fixture(scope="module")
def database(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db"))
    spark.createDataFrame([(i, f"n{i % 4}", i % 3) for i in range(50)], "id int, name string, k int").repartition(5).write.parquet(f"{path}/t")
    return ex.open_database(spark, {"t": f"{path}/t"})


@pytest.mark.parametrize(
    ("predicted", "gold", "options", "want"),
    [
        ("SELECT k, name FROM t", "SELECT name, k FROM t", {}, True),
        ("SELECT DISTINCT k FROM t", "SELECT k FROM t", {}, True),
        ("SELECT DISTINCT k FROM t", "SELECT k FROM t", {"keep_distinct": True}, False),
        ("SELECT id FROM t ORDER BY id DESC", "SELECT id FROM t ORDER BY id", {}, False),
        ("SELECT id FROM t WHERE id > = 0 ORDER BY id", "SELECT id FROM t ORDER BY id", {}, True),
        ("SELECT id FROM t WHERE k = 2", "SELECT id FROM t WHERE k = 1", {}, False),
        ("SELECT id FROM t WHERE k = 2", "SELECT id FROM t WHERE k = 1", {"plug": True}, True),
        ("SELECT nothing FROM t", "SELECT id FROM t", {}, False),
        ("SELECT id, k FROM t", "SELECT id FROM t", {}, False),
        ("DROP VIEW t", "SELECT id FROM t", {}, False),
        ("SELECT raise_error('x') AS id FROM t", "SELECT id FROM t", {}, False),
        ("SELECT id FROM t WHERE id < 0", "SELECT id FROM t WHERE id > 100", {}, True),
    ],
)
def test_exec_match(database, predicted, gold, options, want):
    assert ex.exec_match([database], predicted, gold, **options) is want


@pytest.mark.parametrize(
    ("predicted", "gold", "want"),
    [
        ("SELECT CAST(id AS BIGINT) FROM t", "SELECT id FROM t", "match"), ("SELECT SUM(id) * 1.0 FROM t", "SELECT SUM(id) FROM t", "match"), ("SELECT id, k FROM t WHERE id < 0", "SELECT id FROM t WHERE id < 0", "match"),
        ("SELECT 'a distinct b'", "SELECT 'a b'", "differs"), ("SELECT 'a distinct b'", "SELECT  'a distinct b'", "match"), ("SELECT k, k, id, id, name, name, k, id, name FROM t", "SELECT id, id, id, k, k, k, name, name, name FROM t", "match"),
        ("SELECT id % 2, id % 3, id % 5, id % 7 FROM t", "SELECT id % 7, id % 5, id % 2, id % 3 FROM t", "match"), ("SELECT id, id FROM t", "SELECT id, k FROM t", "differs"), ("SELECT nope FROM t", "SELECT id FROM t", "error"), ("SELECT id FROM t", "SELECT nope FROM t", "gold"),
        ("SELECT COUNT(*) AS n FROM range(100000000) a JOIN range(1000) b ON a.id + b.id < 0", "SELECT 0 AS n", "timeout"), ("SELECT YEAR(CURDATE())", "SELECT 2020", "match"),
    ],
)
def test_verdicts(spark, database, predicted, gold, want):
    assert ex.exec_verdicts(spark, [ex.Pair((database,), predicted, gold)], seconds=15.0 if want != "timeout" else 2.0) == [want]


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "SELECT upper(reflect('java.util.UUID', 'randomUUID'))", "SELECT id FROM t WHERE EXISTS (SELECT try_reflect('a', 'b'))", "SELECT * FROM parquet.`/root/x`",
        "SELECT * FROM t JOIN csv.`/etc/passwd` c ON true", "SELECT (SELECT max(k) FROM other_view)", "SELECT * FROM global_temp.v", "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM t", "SELECT * FROM IDENTIFIER('other_' || 'view')",
        "SELECT input_file_name() FROM t", "SELECT read_files('/etc')", "WITH other_view AS (SELECT 1) SELECT * FROM other_view", "SELECT * FROM spark_catalog.default.t", "SELECT version(), current_user()", "SHOW TABLES", "SET spark.x=1",
    ],
)
def test_guard(spark, database, sql):
    spark.range(3).selectExpr("id AS k").createOrReplaceTempView("other_view")
    database.range(3).selectExpr("id AS k").createOrReplaceTempView("other_view")  # in the session, but no view of the database
    assert ex.refusal(database, sql) and ex.execute(database, [sql]).error


def test_guard_lets_queries_run(database):
    for sql in (
        "WITH a AS (SELECT k, COUNT(*) AS n FROM t GROUP BY k HAVING COUNT(*) > 1), b AS (SELECT * FROM a) SELECT a.k, RANK() OVER (PARTITION BY b.k ORDER BY a.n DESC) FROM a LEFT JOIN b ON a.k = b.k WHERE a.n BETWEEN 1 AND 99 ORDER BY 1 LIMIT 3",
        "SELECT CASE WHEN name LIKE 'n%' THEN CAST(id AS STRING) ELSE name END, x FROM t LATERAL VIEW explode(array(1, 2)) e AS x WHERE id IN (SELECT id FROM t WHERE k = 1) AND EXISTS (SELECT 1 FROM T u WHERE u.id = t.id)",
        "SELECT id FROM t UNION SELECT k FROM t EXCEPT SELECT 7", "VALUES (1, 'a'), (2, 'b')", "SELECT transform(array(id), x -> x + 1), EXTRACT(YEAR FROM DATE'2020-01-01'), SUM(id) OVER w, COUNT(*) OVER (ORDER BY k ROWS 1 PRECEDING) FROM t WINDOW w AS (ORDER BY id)",
    ):
        assert ex.refusal(database, sql) is None, sql
        assert ex.execute(database, [sql]).result.collect()


def test_candidates_of_many_pairs_together(spark, database):
    pairs = [ex.Pair((database,), f"SELECT id FROM t WHERE k = {i}", "SELECT id FROM t WHERE k = 1") for i in range(3)] + [ex.Pair((database, database), "SELECT name FROM t ORDER BY id", "SELECT name FROM t ORDER BY id")]
    assert ex.exec_verdicts(spark, pairs) == ["differs", "match", "differs", "match"]
    assert ex.exec_verdicts(spark, pairs[:3], plug=True) == ["match"] * 3


def test_gold_must_run(database):
    with pytest.raises(ValueError, match="gold"):
        ex.exec_match([database], "SELECT id FROM t", "SELECT nothing FROM t")


def test_too_long_is_no_match(database):
    slow = "SELECT COUNT(*) AS n FROM range(100000000) a JOIN range(1000) b ON a.id + b.id < 0"
    assert ex.exec_match([database], slow, "SELECT 0 AS n", seconds=2.0) is False


def test_last_result_counts(database):
    assert [r[0] for r in ex.execute(database, ["SELECT 1", "SELECT 2"]).result.collect()] == [2]
    assert ex.execute(database, ["SELECT 1", "DELETE FROM t"]).error == "not a query"
    assert ex.execute(database, []).result is None


def test_numbered(database):
    df = database.table("t").orderBy(F.desc("id"))
    assert [tuple(r) for r in ex.numbered(df.select("id")).orderBy("_place").collect()] == [(i, 49 - i) for i in range(50)]


def test_plugged():
    assert list(ex.plugged("a = 'x' and b1 < 3", "c = 5 or d = 'y'")) == ["a = 'y' and b1 < 'y'", "a = 'y' and b1 < 5", "a = 5 and b1 < 'y'", "a = 5 and b1 < 5"]


def test_live_verdicts(spark):
    kind = "k int, a string, b int"
    p = spark.createDataFrame([(1, "x", 1), (1, "x", 1), (2, "x", None), (3, "x", 1), (5, "z", 1)], kind)
    g = spark.createDataFrame([(1, "x", 1), (2, "x", None), (4, "x", 1), (5, "z", 2)], kind)
    cases = spark.createDataFrame([(i,) for i in range(1, 7)], "k int")
    assert {r.k: r.matches for r in ex.live_verdicts(cases, p, g, "k").collect()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: True}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "d", "violation_wrong"), (2, "d", "correct"), (3, None, "correct")], "i int, db string, classification string")
    got = sinks.write_with_metadata(df, f"{tmp_path}/items", ["db", "classification"], seed=1)
    assert got == json.loads((tmp_path / "items_metadata.json").read_text()) and got["total"] == 3 and got["seed"] == 1
    assert got["by"] == {"db": {"d": 2, "None": 1}, "classification": {"violation_wrong": 1, "correct": 2}}
    sinks.write_csv(df, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 3
    sinks.write_violations(df, f"{tmp_path}/bad")
    assert [r.i for r in spark.read.json(f"{tmp_path}/bad").collect()] == [1]
