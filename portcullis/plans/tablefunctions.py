"""Reading statements as table functions, for SQL and LATERAL joins.

    register(spark)
    spark.sql("SELECT q.id, r.* FROM queries q, LATERAL sql_lineage(q.sql, '{\"t\": [\"id\"]}') r")

Rows reach the functions in pickled batches. The schema, policy and dialect are constants: ``analyze`` reads and checks them
while the query is planned, so a wrong one is an error before anything runs, and every worker reads them once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import lineage, sqlfront

DIALECTS = ("sqlite", "postgres")


@dataclass
class Planned(AnalyzeResult):
    """What ``analyze`` hands to the workers."""

    constants: dict = field(default_factory=dict)


def _constant(name: str, given: AnalyzeArgument | None, default: object = None) -> object:
    if given is None:
        return default
    if not given.isConstantExpression or given.value is None:
        raise ValueError(f"{name} must be a constant")
    return given.value


def _names(text: object) -> dict[str, list[str]]:
    body = json.loads(str(text))
    if not isinstance(body, dict) or not all(isinstance(v, list) for v in body.values()):
        raise ValueError("the schema must be a JSON object of tables with lists of columns")
    return body


def _planned(columns: str, sql: AnalyzeArgument, schema: AnalyzeArgument | None, dialect: AnalyzeArgument | None, default: str) -> Planned:
    if not isinstance(sql.dataType, (T.StringType, T.NullType)):
        raise ValueError("the statement must be a string")
    chosen = str(_constant("dialect", dialect, default)).lower()
    if chosen not in DIALECTS:
        raise ValueError(f"dialect must be one of {', '.join(DIALECTS)}")
    kinds = {"string": T.StringType(), "int": T.IntegerType()}  # planned in a worker, where no session reads DDL
    fields = [T.StructField(c.split()[0], kinds[c.split()[1]]) for c in columns.split(", ")]
    return Planned(T.StructType(fields), constants={"schema": _names(_constant("schema", schema, "{}")), "dialect": chosen})


class _Statements:
    """``sql_statements(sql)``: ordinal and statement for each statement of a script, split at semicolons outside strings."""

    @staticmethod
    def analyze(sql: AnalyzeArgument) -> Planned:
        return _planned("ordinal int, statement string", sql, None, None, "sqlite")

    def eval(self, sql: str | None) -> Iterator[tuple]:
        for i, part in enumerate(sqlfront.split(sql or "")):
            yield i, part.strip()


class _Read:
    """A function of one statement and constants; statements of one shape are read once in a worker."""

    def __init__(self, planned: Planned) -> None:
        self.rows = self._reader(planned.constants)

    def _reader(self, constants: dict) -> Callable[[str], list[tuple]]:
        raise NotImplementedError

    def _each(self, sql: str | None) -> list[tuple]:
        return [] if sql is None else self.rows(sql)


class _Lineage(_Read):
    """``sql_lineage(sql, schema, dialect)``: op, table_name and column_name of what a script touches; access to a table has an empty column."""

    @staticmethod
    def analyze(sql: AnalyzeArgument, schema: AnalyzeArgument, dialect: AnalyzeArgument | None = None) -> Planned:
        return _planned("op string, table_name string, column_name string", sql, schema, dialect, "sqlite")

    def _reader(self, constants: dict) -> Callable[[str], list[tuple]]:
        return lineage.resource_rows(constants["schema"], True, constants["dialect"])

    def eval(self, sql: str | None, schema: str, dialect: str | None = None) -> Iterator[tuple]:
        yield from self._each(sql)


class _Permissions(_Read):
    """``sql_permissions(sql, schema, dialect)``: kind, table_name and column_name as the CRUD checks take them."""

    @staticmethod
    def analyze(sql: AnalyzeArgument, schema: AnalyzeArgument, dialect: AnalyzeArgument | None = None) -> Planned:
        return _planned("kind string, table_name string, column_name string", sql, schema, dialect, "postgres")

    def _reader(self, constants: dict) -> Callable[[str], list[tuple]]:
        return lineage.permission_rows(constants["schema"], constants["dialect"])

    def eval(self, sql: str | None, schema: str, dialect: str | None = None) -> Iterator[tuple]:
        yield from self._each(sql)


class _Verdict(_Read):
    """``sql_verdict(sql, schema, policy, crud)``: status, and what lacks as JSON. The policy is a row's own."""

    @staticmethod
    def analyze(sql: AnalyzeArgument, schema: AnalyzeArgument, policy: AnalyzeArgument, crud: AnalyzeArgument | None = None) -> Planned:
        out = _planned("status string, missing string", sql, schema, None, "sqlite")
        out.constants["crud"] = bool(_constant("crud", crud, False))
        return out

    def _reader(self, constants: dict) -> Callable[[str, str], tuple]:
        def read(sql: str, policy: str) -> tuple[tuple, list[str]]:
            found = sqlfront.verdict(constants["schema"], sql, json.loads(policy), constants["crud"])
            return (found["status"], json.dumps(found["missing"], ensure_ascii=False, sort_keys=True)), found["not_checked"]

        return sqlfront.by_shape(read)

    def eval(self, sql: str | None, schema: str, policy: str | None, crud: bool | None = None) -> Iterator[tuple]:
        if sql is not None and policy is not None:
            yield self.rows(sql, policy)


FUNCTIONS: dict[str, type] = {"sql_statements": _Statements, "sql_lineage": _Lineage, "sql_permissions": _Permissions, "sql_verdict": _Verdict}


def register(spark: SparkSession) -> dict[str, Callable]:
    """Make the table functions known to a session under their names; they are returned as DataFrame functions too."""
    out = {}
    for name, handler in FUNCTIONS.items():
        out[name] = F.udtf(handler, useArrow=False)  # Arrow makes a data frame of each statement's rows
        spark.udtf.register(name, out[name])
    return out
