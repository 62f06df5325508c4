"""The folder that all of a cluster shares, and tables at plain paths."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder stands in only where a local session sets none (tests).  On a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    checkpoints = spark.sparkContext._jsc.sc().getCheckpointDir()
    if checkpoints.isDefined():
        return checkpoints.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    return tempfile.mkdtemp(prefix="quern-")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/quern/{name}-{uuid.uuid4().hex}"


def table_at(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The Parquet table at ``path``, with its own schema if none is given; None where none was written yet."""
    try:
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
