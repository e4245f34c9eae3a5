"""Counts of outcomes over a stream of answers: an extension beside the batch metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.outcome import classified


def event_stream(spark: SparkSession, folder: str, glob: str = "events.parquet") -> DataFrame:
    schema = spark.read.parquet(f"{folder}/{glob}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def as_cases(events: DataFrame) -> DataFrame:
    """Events read as answers, with their time."""
    k = F.col("event_id")
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 3 != 0).alias("gold_allowed"), (k % 5 == 0).alias("refusal"), F.when(k % 5 == 0, "NOT_APPLICABLE").when(k % 7 == 0, "BLOCK").otherwise("PASS").alias("access_status"),
        F.when(F.col("event_type") == "view", True).when(F.col("event_type") == "click", False).alias("execution_correct"),
    )


def windowed_outcomes(cases: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Cases by class in windows of event time; later ones than the watermark are left out of closed windows."""
    rows = classified(cases.withWatermark("ts", late))
    counts = rows.groupBy(F.window("ts", every), "classification").agg(F.count("*").cast("long").alias("n"))
    return counts.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "classification", "n")
