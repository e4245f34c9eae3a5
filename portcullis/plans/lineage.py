"""Static lineage over tables of statements: verdicts, resources, required permissions, difficulty.

Each distinct statement is read once: statements are reduced to their distinct texts, analysed in Arrow-fed batches
and joined back.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sqlfront import Analyser, Unsupported, by_shape, tokenize, verdict


def _distinct(df: DataFrame, keys: list[str], schema: str, rows: Callable[[tuple], list[tuple]]) -> DataFrame:
    """``rows`` of each distinct key, with the keys (which must not be null) in front."""
    names = [x.strip().split(" ")[0] for x in schema.split(";")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(*key, *r) for key in batch[keys].itertuples(index=False, name=None) for r in rows(key)]
            yield pd.DataFrame(out, columns=[*keys, *names])

    return df.select(*keys).where(" and ".join(f"`{k}` is not null" for k in keys)).distinct().mapInPandas(run, f"{kinds}, {schema.replace(';', ',')}")


def policy_check(df: DataFrame, schema: dict[str, list[str]], sql: str = "sql", policy: str = "policy", crud: bool = False, dialect: str = "sqlite", views: tuple[str, ...] = ()) -> DataFrame:
    """df with status, n_resources, missing (``operation table.column`` in order, joined by ``; ``) and not_checked.

    ``policy`` holds JSON. Rows without a statement or a policy get nulls. Nothing is shuffled: statements are read where
    they are, once for each shape (``by_shape``).
    """

    def read(text: str, held: str) -> tuple[tuple, list[str]]:
        v = verdict(schema, text, json.loads(held), crud, dialect, views)
        lacks = "; ".join(f"{m['operation']} {m['table'] or '|'.join(m.get('candidates', []))}" + (f".{m['column']}" if m["column"] else "") for m in v["missing"])
        return (v["status"], len(v["resources"]), lacks, len(v["not_checked"])), v["not_checked"]

    known = by_shape(read)

    def rows(texts: pd.Series, held: pd.Series) -> pd.DataFrame:
        out = [(None,) * 4 if s is None or p is None else known(s, p) for s, p in zip(texts, held, strict=True)]
        return pd.DataFrame(out, columns=["status", "n_resources", "missing", "not_checked"], dtype=object)

    own = F.pandas_udf(rows, "status string, n_resources long, missing string, not_checked long")
    others = [F.col(f"`{c}`") for c in df.columns if c not in (sql, policy)]
    return df.select(sql, policy, *others, own(F.col(sql), F.col(policy)).alias("_found")).select(sql, policy, *others, "_found.*")


def resource_rows(schema: dict[str, list[str]], crud: bool, dialect: str) -> Callable[[str], list[tuple]]:
    """A function of a script: its (op, table_name, column_name), in order."""

    def read(sql: str) -> tuple[list[tuple], list[str]]:
        found, unchecked = Analyser(schema, (), dialect).script(sql, crud)
        return sorted(found.resources), unchecked

    return by_shape(read)


def permission_rows(schema: dict[str, list[str]], dialect: str) -> Callable[[str], list[tuple]]:
    """A function of a script: its (kind, table_name, column_name), in order; ambiguous columns go to all candidate tables."""

    def read(sql: str) -> tuple[list[tuple], list[str]]:
        found, unchecked = Analyser(schema, (), dialect).script(sql, True)
        own = {(KINDS[o], t, c) for o, t, c in found.resources if c or o != "SELECT"}
        own |= {(KINDS[o], t, c) for o, tables, c in found.ambiguous for t in tables}
        return sorted(own), unchecked

    return by_shape(read)


def resources(df: DataFrame, schema: dict[str, list[str]], sql: str = "sql", crud: bool = True, dialect: str = "sqlite") -> DataFrame:
    """(sql, op, table_name, column_name) of each distinct statement; table-level access has an empty column."""
    known = resource_rows(schema, crud, dialect)
    return _distinct(df, [sql], "op string; table_name string; column_name string", lambda key: known(key[0]))


KINDS = {"SELECT": "read", "UPDATE": "write", "INSERT": "insert", "DELETE": "delete", "DDL": "ddl"}


def required_permissions(df: DataFrame, schema: dict[str, list[str]], sql: str = "sql", dialect: str = "postgres") -> DataFrame:
    """(sql, kind, table_name, column_name) as the CRUD checks take them; ambiguous columns go to all candidate tables."""
    known = permission_rows(schema, dialect)
    return _distinct(df, [sql], "kind string; table_name string; column_name string", lambda key: known(key[0]))


def query_columns(df: DataFrame, schema: dict[str, list[str]], sql: str = "sql", dialect: str = "sqlite") -> DataFrame:
    """(sql, table_name, columns): what a generator takes a query to need; COUNT(*) needs every column of its tables."""

    def rows(key: tuple) -> list[tuple]:
        analyser = Analyser(schema, (), dialect)
        found, _ = analyser.script(key[0], True)
        own: dict[str, set[str]] = {}
        for _, t, c in found.resources:
            if t:
                own.setdefault(t, set()).update([c] if c else [])
        for _, tables, c in found.ambiguous:
            for t in tables:
                own.setdefault(t, set()).add(c)
        if "count(*)" in "".join(key[0].lower().split()):
            own = {t: set(analyser.schema.get(t, [])) for t in own}
        return [(t, ",".join(sorted(cs))) for t, cs in sorted(own.items())]

    return _distinct(df, [sql], "table_name string; columns string", rows)


AGGREGATES = ("MAX", "MIN", "COUNT", "SUM", "AVG")


def difficulty(sql: str) -> str:
    """easy, medium, hard or extra by the counts of clauses, nestings and repeated parts; unknown if unreadable."""
    try:
        tokens = tokenize(sql)
    except Unsupported:
        return "unknown"
    if not tokens or tokens[0].up != "SELECT":
        return "unknown"
    depth, clause, top = 0, "", []
    nested = 0
    for i, t in enumerate(tokens):
        if t.up == "(":
            nested += i + 1 < len(tokens) and tokens[i + 1].up == "SELECT"
            depth += 1
        elif t.up == ")":
            depth -= 1
        elif depth == 0 and t.up in ("UNION", "INTERSECT", "EXCEPT"):
            nested += 1
            break
        elif depth == 0:
            clause = t.up if t.up in ("SELECT", "FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT") else clause
            top.append((t.up, clause))
    count = lambda word, *clauses: sum(u == word and (not clauses or c in clauses) for u, c in top)
    have = {c for _, c in top}
    first = sum(c in have for c in ("WHERE", "GROUP", "ORDER", "LIMIT")) + count("JOIN") + count(",", "FROM") + count("OR", "WHERE", "HAVING", "FROM") + count("LIKE", "WHERE", "HAVING")
    aggregates = sum(u in AGGREGATES for u, _ in top)
    conditions = (1 + count("AND", "WHERE") + count("OR", "WHERE")) if "WHERE" in have else 0
    others = (aggregates > 1) + (count(",", "SELECT") > 0) + (conditions > 1) + (count(",", "GROUP") > 0)
    if first <= 1 and others == 0 and nested == 0:
        return "easy"
    if nested == 0 and (others <= 2 and first <= 1 or first <= 2 and others < 2):
        return "medium"
    if nested == 0 and (others > 2 and first <= 2 or 2 < first <= 3 and others <= 2) or first <= 1 and others == 0 and nested <= 1:
        return "hard"
    return "extra"


def with_difficulty(df: DataFrame, sql: str = "sql") -> DataFrame:
    return df.join(_distinct(df, [sql], "difficulty string", lambda key: [(difficulty(key[0]),)]), sql, "left")


def exposure(df: DataFrame, schema: dict[str, list[str]], granted: dict[str, list[str]], sql: str = "sql") -> DataFrame:
    """valid_guess, invalid_guess or no_unauthorized: whether a statement names columns outside the grants, and real ones."""

    def rows(key: tuple) -> list[tuple]:
        try:
            tokens = tokenize(key[0])
        except Unsupported:
            return [("no_unauthorized", 0)]
        found, _ = Analyser(schema).script(key[0])
        have = {(t.lower(), c.lower()) for t, cs in granted.items() for c in cs}
        out = {(t, c) for _, t, c in found.resources if c and (t, c) not in have}
        names = {c.lower() for cs in schema.values() for c in cs}
        stray = [a for a, b, c in zip(tokens, tokens[1:], tokens[2:], strict=False) if b.up == "." and c.kind == "word" and c.text.lower() not in names]
        return [("valid_guess" if out else "invalid_guess" if stray else "no_unauthorized", len(out))]

    return df.join(_distinct(df, [sql], "exposure string; n_outside long", rows), sql, "left")


def count_by(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").cast("long").alias("n"))
