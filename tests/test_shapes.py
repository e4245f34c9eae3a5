"""Statements of one shape are read once, and as each would be read by itself."""

import json

import pytest

from portcullis import fixtures as fx
from portcullis.plans import lineage, sqlfront

SCHEMA = {"t": ["id", "x", "5", "x 5"], "u": ["id", "y"]}


def _tokens(sql):
    return [(t.kind, "" if t.kind == "number" else t.text) for t in sqlfront.tokenize(sql)]


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("SELECT x FROM t WHERE id = 12 -- 7", "SELECT x FROM t WHERE id = 3 -- it's", True),
        ("SELECT x/* 1 */FROM t WHERE id IN (1,22)", "SELECT x/* ' */FROM t WHERE id IN (3,4)", True),
        ("SELECT x1 FROM t", "SELECT x2 FROM t", False),
        ("SELECT 'a 1' FROM t", "SELECT 'a 2' FROM t", False),
        ("SELECT \"x 5\" FROM t", "SELECT \"x 6\" FROM t", False),
        ("SELECT [x 5] FROM t", "SELECT [x 6] FROM t", False),
        ("SELECT id AS 5 FROM t", "SELECT id AS 6 FROM t", False),
        ("SELECT id AS -- n\n 5 FROM t", "SELECT id AS -- n\n 6 FROM t", False),
        ("SELECT a$b$ 'x $b$ 5 ' FROM t", "SELECT a$b$ 'x $b$ 6 ' FROM t", False),
        ("SELECT 1.5, 1e5, 7 FROM t", "SELECT 1.5, 1e5, 88 FROM t", True),
        ("- /**/ - 1", "-- 1", False),
    ],
)
def test_shape(a, b, same):
    assert (sqlfront.shape(a) == sqlfront.shape(b)) == same
    if same:
        assert _tokens(a) == _tokens(b)


def test_one_reading_a_shape(monkeypatch):
    read, n = sqlfront.Analyser.script, []
    monkeypatch.setattr(sqlfront.Analyser, "script", lambda self, sql, crud=False: n.append(sql) or read(self, sql, crud))
    known = lineage.resource_rows(SCHEMA, True, "sqlite")
    each = [f"SELECT x FROM t WHERE id = {i} -- {i}" for i in range(50)]
    assert {tuple(known(s)) for s in each} == {(("SELECT", "t", ""), ("SELECT", "t", "id"), ("SELECT", "t", "x"))}
    assert len(n) == 1
    broken = sqlfront.by_shape(lambda sql: (lambda v: (v["not_checked"], v["not_checked"]))(sqlfront.verdict(SCHEMA, sql, {})))
    assert [broken(f"SELECT x FROM t WHERE id = {i} AND 'open") for i in (1, 22, 1)] == [["unreadable text at 33"], ["unreadable text at 34"], ["unreadable text at 33"]]


def test_policy_check_without_shuffle(spark, sf_dir):
    df = lineage.policy_check(fx.built_statements(spark, sf_dir), fx.BUILT_SCHEMA, crud=True)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    rows = spark.createDataFrame([(None, "{}", 1), ("SELECT x FROM t", None, 2), ("SELECT x FROM t", json.dumps({"t": ["x"]}), 3)], "sql string, policy string, k int")
    got = sorted(map(tuple, lineage.policy_check(rows, SCHEMA).select("k", "status", "n_resources", "missing", "not_checked").collect()))
    assert got == [(1, None, None, None, None), (2, None, None, None, None), (3, "PASS", 2, "", 0)]
