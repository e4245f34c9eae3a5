"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one of this machine only where that is unset and nothing else runs, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='portcullis-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


@contextlib.contextmanager
def _settings(spark: SparkSession, **named: str) -> Iterator[None]:
    """The session's settings for a while."""
    before = {k: spark.conf.get(k, None) for k in named}
    for k, v in named.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Shuffle files of a table that is written go when it is written.
_CLEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def trim(spark: SparkSession) -> bool:
    """Let the driver's JVM give native memory that it has freed back to the system; false where it has no such command."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")  # the server's own class is hidden
    given = array(jvm.java.lang.Object, 4)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    given[2], given[3] = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
    try:
        invoke.invoke(beans, given)
    except Py4JError:
        return False
    return True


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage once its heap has grown to over half of its limit, and give freed native memory back.

    Plans of many short jobs are garbage at once, but the heap that they made grow is given back to the system by a full
    collection only, and so are the broadcasts and shuffles that they refer to. Compilers and the threads of exchanges
    leave freed native memory behind in as many pools as there are threads at work, some 200 MB after a few hundred jobs.
    """
    run = spark._jvm.java.lang.Runtime.getRuntime()
    if run.totalMemory() > run.maxMemory() // 2:
        spark._jvm.java.lang.System.gc()
    trim(spark)


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: computed once, and safe from lost executors."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}.parquet"
    with _settings(df.sparkSession, **_CLEAN):
        df.write.parquet(path)
    tidy(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete those tables that ``cut`` wrote; nothing may read them again."""
    for df in tables:
        if "cut_path" not in vars(df):
            continue
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Rows to an Arrow batch, and bytes: texts of some kilobytes make batches of some megabytes, packed rows count by their bytes.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let the session hand Python at most BATCH_ROWS rows and about BATCH_BYTES at once, which bounds the memory of workers and of the buffers before them."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size))) > BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes that df reads; it only sizes the number of partitions."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts(df: DataFrame, each: int) -> int:
    """Partitions of about ``each`` bytes of input, and at least the session's number of shuffle partitions.

    Tables that are not files have no estimate (Catalyst then says exabytes) and get the session's number.
    """
    size = input_bytes(df)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // each if size < 1 << 55 else 1)
