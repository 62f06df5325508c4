"""From raw documents to a mix: quality rules, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept.  All but the last return the columns of ``documents``; the last returns
(doc_id, size, source_size, target, taken) of the documents that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import decontam, linededup, mixing, neardocs, rules
from quern.llm.store import stored

#: SQL has no MinHash, SimHash or union-find; a test compares run() with a plain version of all stages instead.
ORACLE_SQL = None

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule of the cascade rejects go."""
    return rules.keep_documents(docs)


def line_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that loses all its words with them goes too.  ``n_chars`` follows the text."""
    out = linededup.without_repeated_lines(docs)
    out = out.where("lines_removed <= 0 OR text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    return out.withColumn("n_chars", F.when(F.col("lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop("lines_removed")


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least doc_id stays."""
    return neardocs.one_per_group(docs)


def decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
