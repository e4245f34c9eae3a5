"""Prompts as Column expressions: sections of instructions, policies as text, few-shot prefixes, and prompts put together.

System prompts and examples are the caller's; headings are fixed values of the instructions' format.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Headings of the two kinds of instructions.
_COLUMN = {"schema": ("##Instruction:\n", ("\n##Evidence:", "\n##Role Access Policy")), "evidence": ("##Evidence:\n", ("\n##Role Access Policy",))}
_CRUD = {
    "schema": ("# Database Schema:", ("\n# Column Meanings:", "\n# External Knowledge:", "\n## Your Role:")),
    "column_meanings": ("# Column Meanings:\n", ("\n# External Knowledge:", "\n## Your Role:")),
    "external_knowledge": ("# External Knowledge:\n", ("\n## Your Role:",)),
}
_SPACE = r"^\s+|\s+$"


def section(text: Column, begin: str, ends: tuple[str, ...], keep: bool = False, at_start: bool = False) -> Column:
    """What stands between a heading and the nearest of its ends, without outer white space; null without either.

    ``keep`` leaves the heading on, ``at_start`` takes it at the text's beginning only.
    """
    at = F.locate(begin, text)
    first = at + len(begin)
    stops = F.array_min(F.filter(F.array(*[F.locate(e, F.substr(text, first)) for e in ends]), lambda i: i > 0))  # within what follows the heading
    body = F.substr(text, F.when(F.lit(keep), at).otherwise(first), stops - 1 + (len(begin) if keep else 0))
    found = (at == 1) if at_start else (at > 0)
    return F.when(found & stops.isNotNull(), F.regexp_replace(body, _SPACE, ""))


def column_sections(instruction: Column) -> Column:
    """struct(schema, evidence) of a column-level instruction; without headings all of it is the schema."""
    return F.struct(F.coalesce(section(instruction, *_COLUMN["schema"]), instruction).alias("schema"), section(instruction, *_COLUMN["evidence"]).alias("evidence"))


def crud_sections(instruction: Column) -> Column:
    """struct(schema, column_meanings, external_knowledge) of a CRUD-level instruction."""
    schema = F.coalesce(section(instruction, *_CRUD["schema"], keep=True, at_start=True), instruction)
    return F.struct(schema.alias("schema"), *[section(instruction, *_CRUD[k]).alias(k) for k in ("column_meanings", "external_knowledge")])


def column_policy(role: Column, policy: Column) -> Column:
    """A column-level policy (JSON of tables with lists of columns) as text, tables in the order in which they are written."""
    tables = F.map_entries(F.from_json(policy, "map<string, array<string>>"))
    line = lambda t: F.concat(F.lit("\n  - "), t["key"], F.lit(": "), F.when(F.array_contains(t["value"], "*"), "ALL COLUMNS").otherwise(F.array_join(t["value"], ", ")))
    return F.concat(F.lit("Role: "), role, F.lit("\nAccessible Columns:"), F.array_join(F.transform(tables, line), ""))


def crud_policy(role: Column, policy: Column) -> Column:
    """A CRUD-level policy (JSON with DDL, INSERT, DELETE and tables) as text."""
    p = F.from_json(policy, "struct<description: string, DDL: boolean, INSERT: array<string>, DELETE: array<string>, tables: map<string, struct<SELECT: array<string>, UPDATE: array<string>>>>")
    some = lambda c, filled, empty: F.when(F.size(c) > 0, F.concat(F.lit(filled), F.array_join(c, ", "))).otherwise(empty)
    access = lambda t: F.concat(F.lit("\n  - "), t["key"], F.lit(":\n      SELECT: "), some(t["value"]["SELECT"], "", "NONE"), F.lit("\n      UPDATE: "), some(t["value"]["UPDATE"], "", "NONE"))
    tables = F.when(F.size(p["tables"]) > 0, F.concat(F.lit("\n\nTable Column Access:"), F.array_join(F.transform(F.map_entries(p["tables"]), access), ""))).otherwise("")
    described = F.coalesce(F.concat(F.lit("\nDescription: "), F.nullif(p["description"], F.lit(""))), F.lit(""))
    ddl = F.when(F.coalesce(p["DDL"], F.lit(False)), "YES").otherwise("NO")
    return F.concat(
        F.lit("Role: "), role, described, F.lit("\n\nPermissions:\n  - DDL (CREATE/DROP/ALTER): "), ddl, F.lit("\n"), some(p["INSERT"], "  - INSERT allowed on: ", "  - INSERT: NOT ALLOWED"), F.lit("\n"),
        some(p["DELETE"], "  - DELETE allowed on: ", "  - DELETE: NOT ALLOWED"), tables,
    )


def few_shot(examples: list[dict[str, str]], shots: int) -> str:
    """The prefix of the first ``shots`` examples (instruction, input, response); nothing for none."""
    taken = examples[: max(0, shots)]
    if not taken:
        return ""
    shown = [f"### Example {i}:\n{x['instruction']}\n###Input:\n{x['input']}\n\n###Response:\n{x['response']}" for i, x in enumerate(taken, 1)]
    return "\n\n".join(shown) + "\n\n### Now answer the following:\n"


def prompt(system: str, instruction: Column, question: Column, prefix: str = "") -> Column:
    """System prompt, examples, instruction and question; a blank question leaves its heading out."""
    asked = F.when(F.coalesce(question, F.lit("")) == "", F.lit("\n\n###Response:")).otherwise(F.concat(F.lit("\n###Input:\n"), question, F.lit("\n\n###Response:")))
    return F.concat(F.lit(f"{system}\n\n{prefix}"), instruction, asked)


def baseline_prompt(system: str, instruction: Column, question: Column) -> Column:
    """The question over the bare schema of a column-level instruction, without role and policy."""
    return F.concat(F.lit(f"{system}\n\n"), column_sections(instruction)["schema"], F.lit("\n###Input:\n"), F.coalesce(question, F.lit("")), F.lit("\n\n###Response:"))
