"""Writers of cases, reports and tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def write_cases(cases: DataFrame, path: str) -> None:
    """One JSON line a case, in as many files as there are partitions."""
    cases.write.mode("overwrite").json(path)


def write_report(scored: DataFrame, path: str, **more: object) -> dict:
    """The few aggregated rows of a report as one JSON document."""
    report = {**more, "rows": [json.loads(r) for r in scored.toJSON().collect()]}
    Path(path).write_text(json.dumps(report, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    return report


def write_predictions(predictions: DataFrame, path: str, column: str = "prediction", index: str = "source_index") -> None:
    """One line a prediction in order, blank ones included, split into files by ranges of the index."""
    clean = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"\s*[\r\n]+\s*", " ")
    predictions.repartitionByRange(index).sortWithinPartitions(index).select(clean.alias("value")).write.mode("overwrite").text(path)


def examples(cases: DataFrame, by: str = "classification", order: str = "source_index", k: int = 10) -> DataFrame:
    """The first k cases of each class."""
    return cases.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_r") <= k).drop("_r")


def fixed_width(rows: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Report lines: numbers to the right, texts to the left."""
    cells = [F.lpad(F.coalesce(F.col(c).cast("string"), F.lit("-")), w, " ") if dict(rows.dtypes)[c] != "string" else F.rpad(F.coalesce(F.col(c), F.lit("-")), w, " ") for c, w in widths.items()]
    return rows.select(F.concat_ws(" | ", *cells).alias("line"))


def write_with_metadata(items: DataFrame, path: str, dimensions: list[str], **more: object) -> dict:
    """Items as JSON lines, and beside them ``<path>_metadata.json``: time, number of items, and counts by each dimension."""
    items.write.mode("overwrite").json(path)
    written = items.sparkSession.read.schema(items.schema).json(path)
    counts = written.groupingSets([[c] for c in dimensions], *dimensions).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    by: dict[str, dict[str, int]] = {c: {} for c in dimensions}
    for r in counts.collect():  # one row a value of a dimension
        # of the grouping bits only the grouped dimension's is 0
        c = next(c for i, c in enumerate(dimensions) if not r["g"] >> (len(dimensions) - 1 - i) & 1)
        by[c][str(r[c])] = r["n"]
    stamp = items.sparkSession.sql("SELECT date_format(current_timestamp(), 'yyyyMMdd_HHmmss') AS t").first()["t"]
    metadata = {"created": stamp, "total": written.count(), "by": by, **more}
    Path(f"{path}_metadata.json").write_text(json.dumps(metadata, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    return metadata


def write_csv(rows: DataFrame, path: str) -> None:
    """A table with a header, in as many files as there are partitions."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_violations(cases: DataFrame, path: str) -> None:
    """The answered cases that should have been refused or touch what the role may not, as JSON lines by class."""
    cases.where(F.col("classification").startswith("violation")).write.mode("overwrite").partitionBy("classification").json(path)
