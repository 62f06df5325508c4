"""Ledgers as streams: append-only JSON folders, late corrections, idempotent appends, tables as sinks.

There are no event-time windows: a correction may come at any time, so state is
kept without expiry, one row a key, in RocksDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quern.shared import table_at

REACTIONS = "turn_id string, phase string, label string, reaction string, line_no long"
CACHE_LOG = "ts string, key_sha string, event string, model string, cache_creation_tokens long, cache_read_tokens long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Partitions of an appended table.
BUCKETS = 64


def read_log(spark: SparkSession, path: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.json(path)


def effective_updates(reactions: DataFrame) -> DataFrame:
    """Update-mode stream of each turn's standing reaction (turn_id, phase, label, reaction, line_no, removed).

    A retrospective line beats all live ones; among equals the higher line wins;
    ``retracted`` removes the turn until a later line revives it.  The state is one
    row a turn: the greatest line in that order.
    """
    keyed = reactions.where("coalesce(turn_id, '') NOT IN ('', 'none')")
    best = F.max(F.struct((F.col("phase").eqNullSafe("retro")).alias("retro"), F.col("line_no").cast("long").alias("line_no"), "phase", "label", "reaction")).alias("r")
    out = keyed.groupBy("turn_id").agg(best)
    return out.select("turn_id", "r.phase", "r.label", "r.reaction", "r.line_no", F.col("r.label").eqNullSafe("retracted").alias("removed"))


def cache_counts(log: DataFrame) -> DataFrame:
    """Complete-mode stream of events and store tokens by kind."""
    store = F.when(F.col("event") == "store", F.coalesce("cache_creation_tokens", F.lit(0))).otherwise(0)
    return log.groupBy("event").agg(F.count("*").alias("n"), F.sum(store).alias("creation_tokens"))


def run_to_end(writer: DataStreamWriter, spark: SparkSession) -> None:
    """Take all that is there and stop; the query's state is kept in RocksDB, and the session's settings are as before."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        query = writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    query.awaitTermination()


def into_table(stream: DataFrame, path: str, checkpoint: str, mode: str) -> DataStreamWriter:
    """Write each micro-batch's rows to its own partition ``batch`` of the table at ``path``: one that is replayed replaces itself."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)


def last_batch(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last batch: the whole result of a stream in complete mode."""
    rows = spark.read.parquet(path)
    return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch")  # one row


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Every key's row of the last batch that has one: the result of a stream in update mode."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), "batch").alias("r")).select(key, "r.*")


def append_new(stream: DataFrame, path: str, key: str, checkpoint: str, buckets: int = BUCKETS) -> DataStreamWriter:
    """Append rows whose ``key`` the table at ``path`` lacks: replays after a failure, and other streams of the same rows, add nothing.

    The table is partitioned by ``bucket``, a hash of the key, and a batch reads
    the keys of those partitions that its rows fall into.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        try:
            known = table_at(spark, path, fresh.schema)
            if known is not None:
                touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
                rows = fresh.join(known.where(F.col("bucket").isin(touched)).select(key), key, "left_anti")
            else:
                rows = fresh
            rows.hint("rebalance", "bucket").write.partitionBy("bucket").mode("append").parquet(path)
        finally:
            fresh.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def appended(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table of :func:`append_new`."""
    return spark.read.parquet(path).drop("bucket")
