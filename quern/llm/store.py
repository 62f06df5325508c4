"""Where intermediate tables live, and how a plan's lineage is cut.

Everything an executor may have to read again is written below
``spark.checkpoint.dir``, the folder that the cluster shares.  A lost executor
then costs only its running tasks.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a batch between Spark and a Python worker.  Both sides hold some of them at once, outside the heap.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a temporary one is set only where a local session names none (tests).  On a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jsc.isDefined():
            return jsc.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        where = tempfile.mkdtemp(prefix="quern-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; Hadoop removes it when the driver ends.

    Shuffle files of earlier steps that nothing refers to any more are then let
    go: Spark's cleaner follows the JVM's garbage collection.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quern/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, BATCH_BYTES)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH, before)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    gc.collect()
    jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table from :func:`stored` that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def packed(docs: DataFrame, *keep) -> DataFrame:
    """``docs`` as one struct column ``row`` and the columns ``keep``: other columns can't clash with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *keep)


def unpacked(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` back from ``row``."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
