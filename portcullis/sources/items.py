"""Records of any layout as items with one set of names, by a field configuration over variants.

A record stays what it was written as, a variant; a layout says under which names (dotted for nested ones) each field may
stand, and the first that is given counts. So one reader serves every dataset, and a new one needs a layout and no code.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays, records

#: Fields of an item that are plain text; policy and metadata are JSON text.
TEXTS = ("instruction", "input", "role", "gold_sql", "database", "difficulty", "category", "instance_id", "normal_query")
JSONS = ("policy", "metadata")


@dataclass(frozen=True)
class Layout:
    """Where a dataset keeps the fields of an item. ``allowed`` holds true, or the word that means so."""

    name: str
    fields: Mapping[str, tuple[str, ...]]
    allowed: tuple[str, ...]
    dimension: str
    levels: tuple[str, ...]


_COMMON = {"id": ("id",), "instruction": ("instruction",), "input": ("input",), "role": ("role",), "policy": ("policy",), "database": ("db_id", "database")}
# Fields, levels and dimensions of the known layouts.
_BY_LEVEL = _COMMON | {"gold_sql": ("metadata.gold_sql",), "difficulty": ("difficulty",), "metadata": ("metadata",)}
LAYOUTS = {
    "spider": Layout("spider", _BY_LEVEL, ("metadata.permission",), "difficulty", ("easy", "medium", "hard", "extra")),
    "bird": Layout("bird", _BY_LEVEL, ("metadata.permission",), "difficulty", ("simple", "moderate", "challenging")),
    "livesqlbench": Layout(
        "livesqlbench", _COMMON | {"gold_sql": ("gold_sql", "gold_output"), "category": ("category",), "instance_id": ("instance_id",), "normal_query": ("normal_query",)}, ("allowed",),
        "operation", ("SELECT", "CREATE", "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "OTHER"),
    ),
}
# Keys under which records keep their id and their statement, the likeliest first.
ID_KEYS = ("instance_id", "id", "question_id", "instance")
SQL_KEYS = ("gold_sql", "sql", "ground_truth", "gt_sql", "query")


def layout(dataset: str) -> Layout:
    try:
        return LAYOUTS[dataset.lower()]
    except KeyError:
        raise ValueError(f"unknown dataset {dataset}; known: {', '.join(LAYOUTS)}") from None


def path_of(dotted: str) -> str:
    """The variant path of a dotted name, whatever characters its parts have."""
    if "'" in dotted:
        raise ValueError("names with apostrophes have no path")
    return "$" + "".join(f"['{p}']" for p in dotted.split("."))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source_index, record): the JSON texts of ``.json`` arrays or ``.jsonl`` lines, in splits."""
    if path.endswith(".jsonl"):
        return records._lines(spark, path).where(F.trim("line") != "").select("source_index", F.col("line").alias("record"))
    return arrays.read_array(spark, path)


def items(texts: DataFrame, kind: Layout, record: str = "record", index: str = "source_index") -> DataFrame:
    """An item for each JSON text: id, the plain and JSON fields, is_allowed and operation, all columns for every layout.

    Missing texts are null but for instruction, input, role, gold_sql and database (empty), a missing id is the layout's name and the
    index, a missing policy an empty object, a missing permission allows. Text that is no JSON, or is null, is an error.
    """
    v = F.col("_v")
    checked = F.when(F.col(record).isNull(), F.raise_error(F.lit("a record is missing")).cast("string")).otherwise(F.col(record))
    rows = texts.select(F.col(index), F.parse_json(checked).alias("_v"))
    text = lambda names: F.coalesce(*[F.try_variant_get(v, path_of(n), "string") for n in names]) if names else F.lit(None).cast("string")
    body = lambda names: F.coalesce(*[F.to_json(F.try_variant_get(v, path_of(n), "variant")) for n in names]) if names else F.lit(None).cast("string")
    given = text(kind.allowed)
    empty = {"instruction", "input", "role", "gold_sql", "database"}
    out = {c: F.coalesce(text(kind.fields.get(c, ())), F.lit("")) if c in empty else text(kind.fields.get(c, ())) for c in TEXTS}
    out |= {"policy": F.coalesce(F.nullif(body(kind.fields.get("policy", ())), F.lit("null")), F.lit("{}")), "metadata": F.nullif(body(kind.fields.get("metadata", ())), F.lit("null"))}
    name = F.coalesce(text(kind.fields.get("id", ())), F.concat(F.lit(f"{kind.name}_"), F.col(index).cast("string")))
    allowed = F.coalesce(F.when(given == "", True).otherwise(given.isin("allowed", "true")), F.lit(True))
    named = rows.select(index, name.alias("id"), *[c.alias(k) for k, c in out.items()], allowed.alias("is_allowed"))
    return named.withColumn("operation", _operation(F.col("gold_sql")))


def _operation(sql: Column) -> Column:
    from ..functions.text import operation_prefix

    return operation_prefix(sql)


def load_items(spark: SparkSession, path: str, dataset: str, max_samples: int | None = None) -> DataFrame:
    """The items of a dataset's file, folder or pattern; the first ``max_samples`` if given."""
    rows = items(read_texts(spark, path), layout(dataset))
    return rows if max_samples is None else rows.where(F.col("source_index") < max_samples)


def record_schema(texts: DataFrame, record: str = "record") -> str:
    """One schema that fits all records, as Spark writes it: fields of some records and types that differ included."""
    return texts.agg(F.schema_of_variant_agg(F.parse_json(record)).alias("s")).first()["s"]


def detected_keys(texts: DataFrame, id_key: str | None = None, sql_key: str | None = None, record: str = "record", index: str = "source_index") -> tuple[str | None, str | None]:
    """The keys of the id and of the statement: those given, else the first known ones that the first record has."""
    first = texts.agg(F.json_object_keys(F.min_by(record, index)).alias("keys")).first()["keys"] or []
    pick = lambda own, known: own or next((k for k in known if k in first), None)
    return pick(id_key, ID_KEYS), pick(sql_key, SQL_KEYS)


def ground_truth(texts: DataFrame, id_key: str | None = None, sql_key: str | None = None) -> DataFrame:
    """(instance_id, gold_sql) of ground-truth records, whose keys are detected; of repeated ids the last record counts.

    A list of statements counts by its first. Records without an id are left out; without known keys there is an error.
    """
    own, sql = detected_keys(texts, id_key, sql_key)
    if own is None or sql is None:
        raise ValueError("the records have no known key for the id or the statement")
    v = F.parse_json("record")
    one = F.coalesce(F.try_variant_get(v, f"{path_of(sql)}[0]", "string"), F.try_variant_get(v, path_of(sql), "string"))
    named = texts.select("source_index", F.try_variant_get(v, path_of(own), "string").alias("instance_id"), one.alias("gold_sql")).where("instance_id is not null")
    return named.groupBy("instance_id").agg(F.max_by("gold_sql", "source_index").alias("gold_sql"))
