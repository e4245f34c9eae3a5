"""Left-to-right scans of SQL text that patterns cannot do: comments, nested calls, literals; one pass each, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import sqlfront


def _each(scan: Callable[[str], object], kind: T.DataType) -> Callable[[Column], Column]:
    """A scan of one text as a Column function; null gives null."""

    def batches(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([None if x is None else scan(x) for x in texts], dtype=object)

    batches.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(batches, kind)


def _without_blocks(sql: str) -> str:
    out, at = [], 0
    while (start := sql.find("/*", at)) >= 0 and (end := sql.find("*/", start + 2)) >= 0:
        out.append(sql[at:start])
        at = end + 2
    return "".join(out) + sql[at:]


def without_comments(sql: str) -> str:
    """Block comments go first, then what follows a double dash on its line; blank lines go, and a dash on an open last line stays."""
    lines = _without_blocks(sql).replace("\r\n", "\n").replace("\r", "\n").split("\n")
    bare = [line.partition("--")[0] for line in lines[:-1]] + lines[-1:]
    return "\n".join([bare[0], *(line for line in bare[1:-1] if line.strip()), *bare[1:][-1:]]).strip()


_CALL = re.compile(r"\bround\s*\(|[(),]", re.IGNORECASE)


def without_round(sql: str) -> str:
    """Each ROUND(x, ...) that is closed becomes x. A stack holds open parentheses; a call's comma marks what is dropped."""
    drops: list[tuple[int, int]] = []
    open_: list[list[int]] = []  # start, end of the opening, first comma; plain parentheses start at -1
    for m in _CALL.finditer(sql):
        mark = m.group()
        if mark == ",":
            if open_ and open_[-1][2] < 0:
                open_[-1][2] = m.start()
        elif mark != ")":
            open_.append([m.start() if len(mark) > 1 else -1, m.end(), -1])
        elif open_:
            start, end, comma = open_.pop()
            if start >= 0:
                drops += [(start, end), (comma if comma >= 0 else m.start(), m.end())]
    out, at = [], 0
    for start, end in sorted(drops):  # drops within a dropped part end before it does
        if start > at:
            out.append(sql[at:start])
        at = max(at, end)
    return "".join(out) + sql[at:]


def literals(sql: str) -> list[str]:
    """The literals of a statement in order: quoted strings as written, and numbers that are no part of a name."""
    return [m.group() for m in re.finditer(r"'(?:[^']|'')*'|\"(?:[^\"])*\"|(?<![\w.])\d+(?:\.\d+)?(?!\w)", sql)]


def without_distinct(sql: str) -> str:
    """The word DISTINCT goes wherever it is a word of its own: not in strings, quoted names or comments. An unreadable text stays."""
    try:
        tokens = sqlfront.tokenize(sql)
    except sqlfront.Unsupported:
        return sql
    out, at = [], 0
    for t in tokens:
        if t.up == "DISTINCT":
            out.append(sql[at : t.at])
            at = t.end
    return "".join(out) + sql[at:]


uncommented = _each(without_comments, T.StringType())
unrounded = _each(without_round, T.StringType())
undistinguished = _each(without_distinct, T.StringType())
literal_list = _each(literals, T.ArrayType(T.StringType()))
