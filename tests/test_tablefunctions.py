"""Table functions over statements: LATERAL equals the DataFrame form, constants are checked while planning."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from portcullis.plans import lineage, tablefunctions

SCHEMA = '{"t": ["id", "x", "secret"], "u": ["id", "y"]}'
SQL = ["SELECT x FROM t WHERE secret > 1", "SELECT * FROM t; DELETE FROM u WHERE y = ';'", "garbage", "", None, "UPDATE t SET x = 1", "SELECT x FROM t WHERE secret > 1"]


@pytest.fixture(scope="module")
def queries(spark):
    tablefunctions.register(spark)
    df = spark.createDataFrame(list(enumerate(SQL)), "k int, sql string").repartition(2)
    df.createOrReplaceTempView("tf_queries")
    return df


def test_lateral_equals_dataframe(spark, queries):
    schema = {"t": ["id", "x", "secret"], "u": ["id", "y"]}
    got = spark.sql(f"SELECT q.k, r.* FROM tf_queries q, LATERAL sql_lineage(q.sql, '{SCHEMA}') r")
    want = queries.join(lineage.resources(queries, schema), "sql").select("k", "op", "table_name", "column_name")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 8
    got = spark.sql(f"SELECT q.k, r.* FROM tf_queries q, LATERAL sql_permissions(q.sql, '{SCHEMA}', 'sqlite') r")
    want = queries.join(lineage.required_permissions(queries, schema, dialect="sqlite"), "sql").select("k", "kind", "table_name", "column_name")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_statements_and_verdicts(spark, queries):
    got = spark.sql("SELECT q.k, s.* FROM tf_queries q, LATERAL sql_statements(q.sql) s")
    assert sorted(map(tuple, got.where("k = 1").collect())) == [(1, 0, "SELECT * FROM t"), (1, 1, "DELETE FROM u WHERE y = ';'")]
    assert got.where("k in (3, 4)").count() == 0
    rows = spark.sql(f"""SELECT q.k, v.* FROM tf_queries q, LATERAL sql_verdict(q.sql, '{SCHEMA}', '{{"t": ["id", "x"]}}') v""").collect()  # a null statement has no rows
    assert {r.k: r.status for r in rows} == {0: "BLOCK", 1: "BLOCK", 2: "PASS", 3: "PASS", 5: "PASS", 6: "BLOCK"}
    assert next(r.missing for r in rows if r.k == 0) == '[{"column": "secret", "operation": "SELECT", "table": "t"}]'


def test_as_dataframe_function(spark, queries):
    f = tablefunctions.register(spark)["sql_lineage"]
    assert [tuple(r) for r in f(F.lit("SELECT y FROM u"), F.lit(SCHEMA)).collect()] == [("SELECT", "u", ""), ("SELECT", "u", "y")]


@pytest.mark.parametrize("call", ["sql_lineage(q.sql, q.sql)", "sql_lineage(q.sql, 'no json')", "sql_lineage(q.sql, '[1]')", f"sql_lineage(q.sql, '{SCHEMA}', 'oracle')", "sql_statements(q.k)"])
def test_wrong_constants_are_errors_before_anything_runs(spark, queries, call):
    with pytest.raises(PySparkException):
        spark.sql(f"SELECT * FROM tf_queries q, LATERAL {call} r")
