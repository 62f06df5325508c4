"""Chunks kept in segments by source: a sync writes only the segments that a change touches.

``root`` holds three tables, all partitioned by ``bucket``, a hash of the source's
path: ``chunks``; ``tallies`` (scope, sources, chunks), so that a status counts
nothing anew; and ``sources`` (path, sha, scope, n_chunks), the high-water mark.
A sync compares the sources as they are with those of the mark, makes
chunks of what is new or changed, and overwrites the touched partitions with what
stays of them and what is new.  Partitions of ``sources`` are written last.

An interrupted sync may leave partitions of ``chunks`` that the mark doesn't
describe.  Their numbers of chunks by source then differ from the mark's, and the
next sync makes them anew from all their sources.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import sync
from quern.shared import table_at

log = logging.getLogger(__name__)
#: Partitions of a table.  A change rewrites its whole partition, so choose as many as make one about a gigabyte.
BUCKETS = 64


@dataclass
class Result(sync.Outcome):
    """What a sync did, the partitions it wrote, and how many of them were left over from an interrupted one."""

    buckets: list[int] = field(default_factory=list)
    repaired: int = 0


def bucket(path, buckets: int = BUCKETS) -> Column:
    """The segment of a source."""
    return F.pmod(F.conv(F.substring(F.md5(path), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int").alias("bucket")


def _files(spark: SparkSession, path: str) -> set[str]:
    table = table_at(spark, path)
    return set() if table is None else set(table.inputFiles())


def _overwrite(rows: DataFrame, path: str, touched: list[int]) -> None:
    """Replace the partitions ``touched``, and no others, by ``rows``.

    A dynamic overwrite leaves a partition that gets no row as it was, which its
    old files tell; it is then overwritten by an empty one.
    """
    spark = rows.sparkSession
    before = _files(spark, path)
    # Files of even size: the shuffle's partitions are split and merged by what they hold.
    rows.hint("rebalance", "bucket").write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    left = before & _files(spark, path)
    for b in touched:
        if any(f"/bucket={b}/" in f for f in left):
            spark.createDataFrame([], rows.drop("bucket").schema).write.mode("overwrite").parquet(f"{path}/bucket={b}")


def _torn(chunks: DataFrame | None, mark: DataFrame) -> DataFrame:
    """(bucket) of partitions whose chunks aren't those that the mark counts, source by source."""
    want = mark.where("n_chunks > 0").select("bucket", "path", "n_chunks")
    if chunks is None:
        return want.select("bucket").distinct()
    have = chunks.groupBy("bucket", F.col("source").alias("path")).agg(F.count("*").alias("n"))
    both = have.join(want, ["bucket", "path"], "full_outer")
    return both.where("NOT (n <=> n_chunks)").select("bucket").distinct()


def sync_segments(spark: SparkSession, root: str, sources: DataFrame, chunks_of: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> Result:
    """Bring the tables below ``root`` to ``sources`` (path, sha, scope; one row a path).

    ``chunks_of`` gets the paths to make chunks of (path, sha, scope) and returns
    their rows with a column ``source``, the path.  Where nothing changed nothing is
    written.  Removed sources lose their chunks.  ``buckets`` must stay the same
    over all syncs of one root.  Only partition numbers, at most ``buckets``, and
    counts come to the driver.
    """
    # Sources are read several times, and behind them stand all texts: a path, a hash and a scope each are kept.
    now = sources.where("path IS NOT NULL").select("path", "sha", "scope", bucket("path", buckets)).persist()
    try:
        return _synced(spark, root, now, chunks_of, buckets)
    finally:
        now.unpersist()


def _synced(spark: SparkSession, root: str, now: DataFrame, chunks_of: Callable[[DataFrame], DataFrame], buckets: int) -> Result:
    at, mark_at = f"{root}/chunks", f"{root}/sources"
    stored, mark = table_at(spark, at), table_at(spark, mark_at)
    if mark is None:
        changes = now.select("path", F.lit("added").alias("change"), "bucket")
        torn: list[int] = [] if stored is None else [r["bucket"] for r in stored.select("bucket").distinct().collect()]
    else:
        changes = sync.diff(mark, now).select("path", "change", bucket("path", buckets)).persist()
        torn = [r["bucket"] for r in _torn(stored, mark).collect()]
    try:
        per_bucket = changes.groupBy("bucket").pivot("change", ["added", "changed", "removed"]).count().na.fill(0).collect()
        count = lambda kind: sum(r[kind] for r in per_bucket)
        touched = sorted({r["bucket"] for r in per_bucket} | set(torn))
        out = Result(count("added"), count("changed"), count("removed"), touched, len(torn))
        if touched:
            here, again = F.col("bucket").isin(touched), F.col("bucket").isin(torn)
            new = now.where(here).join(changes.where("change != 'removed'").select("path"), "path", "left_semi")
            fresh = new.where(~again).unionByName(now.where(again))
            rows = chunks_of(fresh.select("path", "sha", "scope")).withColumn("bucket", bucket("source", buckets))
            if stored is not None:
                kept = stored.where(here & ~again).join(changes.select(F.col("path").alias("source")), "source", "left_anti")
                rows = rows.unionByName(kept.select(*rows.columns))
            _overwrite(rows, at, touched)
            written = spark.read.schema(rows.schema).parquet(at).where(here)
            counts = written.groupBy(F.col("source").alias("path")).agg(F.count("*").alias("n_chunks"))
            marks = now.where(here).join(counts, "path", "left").select("path", "sha", "scope", F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"), "bucket")
            _overwrite(marks.groupBy("bucket", "scope").agg(F.count("*").alias("sources"), F.sum("n_chunks").alias("chunks")).select("scope", "sources", "chunks", "bucket"), f"{root}/tallies", touched)
            _overwrite(marks, mark_at, touched)
    finally:
        changes.unpersist()
    log.info("%s: %d added, %d changed, %d removed; wrote %d of %d partitions, %d of them left over", root, out.added, out.changed, out.removed, len(touched), buckets, len(torn))
    return out


def tallies(spark: SparkSession, root: str) -> DataFrame:
    """(scope, sources, chunks) of the tables below ``root``, from their partitions' tallies."""
    t = table_at(spark, f"{root}/tallies", "scope string, sources long, chunks long, bucket int")
    if t is None:
        t = spark.createDataFrame([], "scope string, sources long, chunks long")
    return t.groupBy("scope").agg(F.sum("sources").alias("sources"), F.sum("chunks").alias("chunks"))
