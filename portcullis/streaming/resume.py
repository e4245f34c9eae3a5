"""Predictions written by micro-batches, each exactly once, however often the writer is stopped and started.

A batch goes to a folder of its own, ``run=<run>/batch=<id>``, which overwrites what a failed attempt of the same batch
left there, and counts only once Spark has put its _SUCCESS mark into it. A stream that starts again with its checkpoint
gives an unfinished batch its old id, so it replaces itself. A new run (the checkpoint is lost, or cases are added) has
folders of its own and leaves out every case that is committed elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


class PredictionLog:
    """A folder of committed batches. ``schema`` names the columns of a prediction; ``key`` is the one that tells cases apart."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "source_index") -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = T.StructType.fromDDL(schema)
        if key not in self.schema.names:
            raise ValueError(f"no column {key} in the schema")

    def _paths(self, pattern: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        found = at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).globStatus(at)
        return sorted(str(x.getPath().getParent()) for x in found or [])

    def batches(self) -> list[str]:
        """Folders of the committed batches."""
        return self._paths("run=*/batch=*/_SUCCESS")

    def committed(self, besides: str = "") -> DataFrame:
        """All predictions of committed batches but those of one folder."""
        folders = [p for p in self.batches() if not p.endswith(f"/{besides}") or not besides]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).json(folders)

    def pending(self, cases: DataFrame, besides: str = "") -> DataFrame:
        """The cases without a committed prediction. Null keys are never committed and always pending."""
        return cases.join(self.committed(besides).select(F.col(self.key).alias("_done")).distinct(), cases[self.key] == F.col("_done"), "left_anti")

    def commit(self, cases: DataFrame, predict: Callable[[DataFrame], DataFrame], run: str, batch: int) -> None:
        """Predict the pending cases of one batch, each key once, and write them; doing it again replaces it."""
        folder = f"run={run}/batch={batch}"
        mine = self.pending(cases.where(F.col(self.key).isNotNull()), besides=folder).dropDuplicates([self.key])
        predict(mine).select(*self.schema.names).write.mode("overwrite").json(f"{self.path}/{folder}")

    def stream(self, cases: DataFrame, predict: Callable[[DataFrame], DataFrame], run: str, checkpoint: str) -> StreamingQuery:
        """Work off a stream of cases until nothing is left. One run has one checkpoint."""
        writer = cases.writeStream.foreachBatch(lambda batch, i: self.commit(batch, predict, run, i))
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def ordered(self) -> DataFrame:
        """Committed predictions by key, for ``sinks.write_predictions``."""
        return self.committed().orderBy(self.key)


def batches_of(rows: DataFrame, size: int, order: str = "source_index") -> DataFrame:
    """rows with a batch number: ``size`` rows each in the order of ``order``.

    Rows are counted by ranges of the order, so that no task holds more than a range.
    """
    from pyspark.sql.window import Window

    if size < 1:
        raise ValueError("size must be positive")
    ranged = rows.repartitionByRange(F.col(order).asc_nulls_first()).withColumn("_part", F.spark_partition_id())
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")  # a row for each range
    within = F.row_number().over(Window.partitionBy("_part").orderBy(F.col(order).asc_nulls_first())) - 1
    placed = ranged.withColumn("_i", within).join(starts, "_part")
    return placed.withColumn("batch", F.expr(f"(_before + _i) div {size}")).drop("_part", "_i", "_n", "_before")
