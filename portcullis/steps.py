"""Intermediate tables in the folder that driver and executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and one machine runs everything."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='portcullis-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """df as a written table, read by ``spark`` (its own session if none is named): computed once, safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    out = (spark or df.sparkSession).read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote; nothing may read it again."""
    for df in tables:
        if "written_to" in vars(df):
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
