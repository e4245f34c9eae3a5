"""Roles as language models write them, parsed by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_JSON = "array<struct<role: string, description: string, columns: map<string, array<string>>>>"


def _last_wins(entries: Column) -> Column:
    """A map of entries (key, value); of entries with one key the last counts, at the place of the first."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]))


def _written(text: Column) -> Column:
    """Roles of the form ROLE / DESCRIPTION / COLUMNS, one heading or table a line, in the shape of the JSON form."""
    field = lambda body, name: F.trim(F.regexp_extract(body, rf"(?m)^{name}:([^\n]*)$", 1))

    def role(body: Column) -> Column:
        listed = F.regexp_extract(body, r"(?s)\nCOLUMNS:[^\n]*\n(.*)$", 1)
        lines = F.filter(F.split(listed, "\n"), lambda x: x.rlike(r"^\s*[A-Za-z_][A-Za-z0-9_]*\s*:\s*\S"))
        table = lambda x: F.trim(F.substring_index(x, ":", 1))
        names = lambda x: F.filter(F.transform(F.split(F.regexp_extract(x, r"^[^:]*:(.*)$", 1), ","), lambda c: F.trim(c)), lambda c: c != "")
        columns = _last_wins(F.transform(lines, lambda x: F.struct(table(x).alias("key"), names(x).alias("value"))))
        return F.struct(F.trim(F.substring_index(body, "\n", 1)).alias("role"), field(body, "DESCRIPTION").alias("description"), columns.alias("columns"))

    found = F.transform(F.slice(F.split(text, r"(?m)^ROLE:"), 2, 1 << 20), role)
    return F.filter(found, lambda r: F.size(r["columns"]) > 0)


def column_roles(text: Column) -> Column:
    """An array of role, description and columns (table to its columns): from JSON, fenced or not, or from written roles.

    Text that is neither gives an empty array; written roles without columns are left out. Of a table named
    twice in one role the last list counts.
    """
    clean = F.trim(text)
    bare = F.trim(F.regexp_replace(F.regexp_replace(clean, r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    once = lambda r: F.struct(r["role"].alias("role"), r["description"].alias("description"), F.when(r["columns"].isNotNull(), _last_wins(F.map_entries(r["columns"]))).alias("columns"))
    parsed = F.transform(F.coalesce(F.from_json(bare, _JSON), F.from_json(F.lit("[]"), _JSON)), once)
    return F.when(bare.startswith("["), parsed).otherwise(_written(F.regexp_replace(clean, r"[ \t\r]+(?=\n|$)", "")))


def exploded(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, role, description, table_name and column_name for each column that a parsed role names."""
    roles = rows.select(key, F.explode(column_roles(F.col(text))).alias("r")).select(key, "r.role", "r.description", F.explode("r.columns").alias("table_name", "columns"))
    return roles.select(key, "role", "description", "table_name", F.explode("columns").alias("column_name"))


def question_prefix(text: Column, size: int = 200) -> Column:
    """The question's beginning, up to the schema that follows it."""
    return F.left(F.split(F.coalesce(text, F.lit("")), "\n\nSchema:")[0], F.lit(size))


def cleaned(value: Column) -> Column:
    """Without asterisks, backticks, brackets and quotes, and with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"[*`\[\]'\"]", ""), r"\s+", " "))


_TABLE_ROLES = "struct<role:string,description:string,tables:string,done:array<struct<role:string,description:string,tables:string>>>"
#: Fixed value: what follows the tables of a role that names unknown ones.
_MARK = " NEED HUMAN VERIFICATION (Invalid tables: "


def table_roles(text: Column, valid: Column | None = None) -> Column:
    """An array of role, description and tables from roles written as ROLE / DESCRIPTION / TABLES lines, whatever the answer.

    One fold over the lines: a ROLE line begins a role, wherever in the line the heading stands; DESCRIPTION and TABLES
    lines fill it, the last of each counts; other lines carry on the role's name, of which only what stands before a dash
    is kept. A blank line ends a role that has all three parts, and so does the next ROLE line; parts that come to nothing
    after cleaning drop it. With ``valid`` (an array of names in lower case, not empty), a role that a blank line or the
    text's end closes carries a mark with the tables that are not among them, in order of names. Null text gives null.
    """

    def ended(s: Column, mark: bool) -> Column:
        role = cleaned(F.split(s["role"], r"\s*[-\u2013]\s*", 2)[0])
        tables = cleaned(s["tables"])
        shown = tables
        if mark and valid is not None:
            unknown = F.array_sort(F.array_except(F.transform(F.split(tables, ","), lambda t: F.lower(F.trim(t))), valid))
            shown = F.when((F.size(valid) > 0) & (F.size(unknown) > 0), F.concat(tables, F.lit(_MARK), F.array_join(unknown, ", "), F.lit(")"))).otherwise(tables)
        one = F.struct(role.alias("role"), cleaned(s["description"]).alias("description"), shown.alias("tables"))
        whole = (role != "") & (cleaned(s["description"]) != "") & (tables != "")
        return F.when(F.coalesce(whole, F.lit(False)), F.concat(s["done"], F.array(one))).otherwise(s["done"])

    def state(role: Column, description: Column, tables: Column, done: Column) -> Column:
        return F.struct(role.alias("role"), description.alias("description"), tables.alias("tables"), done.alias("done"))

    none = F.lit(None).cast("string")
    after = lambda line, name: F.trim(F.regexp_replace(line, f"(?is)^.*{name}[:\uff1a]", ""))

    def step(s: Column, raw: Column) -> Column:
        line = F.regexp_replace(raw, r"^\s+|\s+$", "")
        full = s["role"].isNotNull() & s["description"].isNotNull() & s["tables"].isNotNull()
        begins = lambda name: F.upper(line).rlike(f"^{name}[:\uff1a]")
        kept = state(s["role"], s["description"], s["tables"], s["done"])
        heading = F.upper(line).rlike("(?:ROLE|DESCRIPTION|TABLES):")
        return (
            F.when((line == "") & full, state(none, none, none, ended(s, True)))
            .when(line == "", kept)
            .when(F.upper(line).rlike("ROLE[:\uff1a]"), state(after(line, "ROLE"), none, none, F.when(full, ended(s, False)).otherwise(s["done"])))
            .when(s["role"].isNull(), kept)
            .when(begins("DESCRIPTION"), state(s["role"], after(line, "DESCRIPTION"), s["tables"], s["done"]))
            .when(begins("TABLES"), state(s["role"], s["description"], after(line, "TABLES"), s["done"]))
            .when(heading, kept)
            .otherwise(state(F.concat(s["role"], F.lit(" "), line), s["description"], s["tables"], s["done"]))
        )

    start = F.from_json(F.lit('{"done": []}'), _TABLE_ROLES)
    return F.aggregate(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n"), start, step, lambda s: ended(s, True))
