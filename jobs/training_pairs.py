"""Write training pairs for an embedder: a sentence and the one after it.

    python -m jobs.training_pairs --documents DIR/documents.parquet --output DIR/pairs

Documents are cleaned of lines with banned phrases and cut into sentences.  A
pair is a sentence (``anchor``) and the next one of its document (``positive``),
with the anchor's form and modality and an id by content.  An anchor that several
documents hold is taken once, from the first of them, so no sentence is trained on
twice or stands in both splits.  A document belongs to the split ``eval`` by the
hash of its id.

``output/pairs`` holds JSON lines, partitioned by split and language;
``output/report`` counts them.  Both are overwritten, so a rerun gives the same.

Rows without a doc_id are left out; a null language is ``und``.  Rows of one
doc_id form one document of several texts, each text once.
"""

from __future__ import annotations

import gc
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import command_line
from quern.functions import text
from quern.operators import chunkers

log = logging.getLogger(__name__)
PAIRS = "id string, doc_id long, line int, pos int, anchor string, positive string, form string, modality string, split string, lang string"


def split_of(doc_id, eval_percent: int):
    """``eval`` for about ``eval_percent`` percent of the documents, by the MD5 of the id."""
    at = F.conv(F.substring(F.md5(doc_id.cast("string")), 1, 8), 16, 10).cast("long") % 100
    return F.when(at < eval_percent, "eval").otherwise("train")


def pairs_of(documents: DataFrame, eval_percent: int, banned: tuple[str, ...]) -> DataFrame:
    """The pairs of ``documents`` (doc_id, text, lang)."""
    # A document's number of texts is bounded by what the table repeats of its id; each is cut on its own.
    d = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.lit("und")).alias("lang"))
    d = d.withColumn("text", text.strip_lines("text", (text.line_with(*banned),)) if banned else F.col("text"))
    d = d.select(F.struct("doc_id", "lang").alias("key"), "text")
    pair = lambda s, i: F.struct(s["line"].cast("int").alias("line"), s["pos"].cast("int").alias("pos"), s["text"].alias("anchor"), F.get("found", i + 1)["text"].alias("positive"))
    s = chunkers.sentence_lists(d, "key", dealt=True).select("key", F.inline_outer(F.transform("found", pair))).where("positive IS NOT NULL AND positive != anchor")
    # The least place of every anchor: combined before the shuffle, so no sentence is a hot key.  A text that comes again gives the same places.
    # This is the only shuffle of the texts, and so most of the disk that a run takes: a pair's two sentences, its place, nothing else.
    s = s.groupBy("anchor").agg(F.min(F.struct("key.doc_id", "line", "pos", "key.lang", "positive")).alias("place")).select("anchor", "place.*")
    pair_id = F.concat(F.lit("PAIR-"), F.substring(F.sha1(F.concat("anchor", F.lit("\0"), "positive")), 1, 12))
    return s.select(pair_id.alias("id"), "doc_id", "line", "pos", "anchor", "positive", text.syntactic_form("anchor").alias("form"), text.modality("anchor").alias("modality"), split_of(F.col("doc_id"), eval_percent).alias("split"), "lang")


def spread(documents: DataFrame) -> DataFrame:
    """``documents``, dealt out by id if a file of few row groups gives fewer tasks with rows than there are cores."""
    tasks = documents.select(F.spark_partition_id().alias("task")).distinct().count()  # reads no column
    return documents if tasks >= documents.sparkSession.sparkContext.defaultParallelism else documents.repartition("doc_id")


def run(spark: SparkSession, documents: str, output: str, eval_percent: int = 10, banned: str = "") -> None:
    """Write the pairs of the documents at the path ``documents`` below ``output``."""
    log.info("reading documents at %s", documents)
    pairs = pairs_of(spread(spark.read.parquet(documents)), eval_percent, tuple(x for x in banned.split("|") if x))
    pairs.write.partitionBy("split", "lang").mode("overwrite").json(f"{output}/pairs", compression="gzip")
    del pairs
    let_go(spark)
    report = written(spark, output).groupBy("split", "lang", "form").agg(F.count("*").alias("pairs"), F.countDistinct("doc_id").alias("documents"))
    report.write.mode("overwrite").parquet(f"{output}/report")
    for r in spark.read.parquet(f"{output}/report").groupBy("split").agg(F.sum("pairs").alias("pairs")).orderBy("split").collect():
        log.info("wrote %d pairs of split %s below %s/pairs", r["pairs"], r["split"], output)


def let_go(spark: SparkSession) -> None:
    """Have the shuffle files removed that no plan refers to any more: Spark's cleaner follows the JVM's garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(spark: SparkSession, output: str) -> DataFrame:
    """The pairs below ``output`` as they stand."""
    return spark.read.schema(PAIRS).json(f"{output}/pairs")


if __name__ == "__main__":
    command_line("training_pairs", run)
