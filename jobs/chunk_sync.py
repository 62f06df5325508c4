"""Keep a table of chunks in step with a table of documents, taking only what is new.

    python -m jobs.chunk_sync --documents DIR/documents.parquet --output DIR/corpus

A document is a source ``docs/<doc_id>.txt`` with the SHA-1 of its text; its scope
is its language.  A run compares the documents with the mark that the last run
left (``output/sources``), makes chunks of new and changed ones (windows of lines,
with content-addressed ids), drops those of removed ones, and overwrites only the
partitions of ``output/chunks`` that this touches.  A run without changes writes
nothing.  A run after an interrupted one gives what the interrupted one would
have: see :mod:`quern.operators.segments`.

Rows without a doc_id are no sources.  Of several rows of one doc_id the one of
greatest SHA-1, then language, stands; a null text is empty and has no chunks.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import command_line
from quern.operators import chunkers
from quern.operators.segments import Result, sync_segments

log = logging.getLogger(__name__)
REPO, LANGUAGE = "docs", "text"
COLUMNS = ("source", "scope", "start", "end", "anchor", "body", "chunk_id", "bucket")


def _sources(documents: DataFrame) -> DataFrame:
    """path, sha and scope of every document, and its text."""
    path = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    body = F.coalesce("text", F.lit(""))
    scope = F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.lit("universal"))
    return documents.where("doc_id IS NOT NULL").select(F.concat_ws("/", F.lit(REPO), path).alias("path"), F.sha1(body).alias("sha"), scope.alias("scope"), path.alias("name"), body.alias("text"))


def run(spark: SparkSession, documents: str, output: str, buckets: int = 64, lines: int = 80, overlap: int = 20) -> Result:
    """Bring the chunks below ``output`` to the documents at the path ``documents``."""
    every = _sources(spark.read.parquet(documents))
    # Texts aren't shuffled to find the sources, only their digests.
    sources = every.groupBy("path").agg(F.max(F.struct("sha", "scope")).alias("s")).select("path", "s.sha", "s.scope")

    def chunks_of(paths: DataFrame) -> DataFrame:
        files = every.join(paths, ["path", "sha", "scope"])
        files = files.select(F.lit(REPO).alias("repo"), F.col("name").alias("path"), F.lit(LANGUAGE).alias("language"), F.col("path").alias("source"), "scope", "text")
        found = chunkers.code_windows(files, lines, overlap, keep=("source", "scope"))
        return found.select(*COLUMNS[:-1]).dropDuplicates(["chunk_id"])  # of rows repeated as they are

    log.info("reading documents at %s", documents)
    done = sync_segments(spark, output, sources, chunks_of, buckets)
    log.info("read %d new or changed documents; partitions written below %s: %s", done.added + done.changed, output, done.buckets)
    return done


def chunks(spark: SparkSession, output: str) -> DataFrame:
    """The chunks below ``output`` as they stand."""
    return spark.read.parquet(f"{output}/chunks").select(*COLUMNS)


if __name__ == "__main__":
    command_line("chunk_sync", run)
