"""Tables on a shared file system, written in generations; JSON lines in and out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the newest complete generation: the last whose ``sources`` were written."""
    at, fs = _fs(spark, root)
    if not fs.exists(at):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith("gen-"))
    done = [n for n in names if fs.exists(_fs(spark, f"{root}/{n}/sources/_SUCCESS")[0])]
    return f"{root}/{done[-1]}" if done else None


def version(spark: SparkSession, root: str) -> str | None:
    at = current(spark, root)
    rows = spark.read.parquet(f"{at}/sources").select("builder_version").take(1) if at else []
    return rows[0][0] if rows else None


def write_generation(spark: SparkSession, root: str, chunks: DataFrame, sources: DataFrame, builder_version: str) -> str:
    """Write chunks, then sources as the commit mark; older generations stay readable until :func:`clean`."""
    last = current(spark, root)
    n = int(last.rsplit("gen-", 1)[1].split("-")[0]) + 1 if last else 1
    at = f"{root}/gen-{n:09d}-{uuid.uuid4().hex[:8]}"
    cols = [c for c in ("family", "scope") if c in chunks.columns]
    chunks.write.partitionBy(*cols).parquet(f"{at}/chunks")
    sources.withColumn("builder_version", F.lit(builder_version)).write.parquet(f"{at}/sources")
    return at


def clean(spark: SparkSession, root: str) -> int:
    """Delete all generations but the current one."""
    keep = current(spark, root)
    at, fs = _fs(spark, root)
    old = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("gen-") and not str(keep).endswith(s.getPath().getName())] if keep else []
    for p in old:
        fs.delete(p, True)
    return len(old)


def write_json_by_scope(rows: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in one folder per scope, sorted by ``order`` inside each file; an empty scope counts as universal.

    Rows are dealt by ranges of scope and order, so a large scope has many files, which follow each other.
    """
    scope = F.when(F.coalesce("scope", F.lit("")) != "", F.col("scope")).otherwise("universal")
    rows.withColumn("scope", scope).repartitionByRange("scope", *order).sortWithinPartitions("scope", *order).write.partitionBy("scope").mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines with a schema; strict fails on a bad line, else bad lines are left out."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with ``line_no`` (from 1, per file) and ``bad``, true for lines that don't parse.

    Large files are read in blocks.  A line's number is its place in its block and
    the lines of the blocks before, which one small table holds.
    """
    at = [F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i")]
    raw = spark.read.text(path).select("value", *at)
    blocks = raw.groupBy("_f", "_b").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    w = Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    lines = raw.join(blocks, ["_f", "_b"]).withColumn("line_no", F.col("_before") + F.col("_i") - F.col("_first") + 1).where("trim(value) != ''")
    parsed = lines.select("line_no", F.from_json("value", schema + ", _corrupt_record string", {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.select("line_no", "r.*").withColumn("bad", F.col("_corrupt_record").isNotNull()).drop("_corrupt_record")


def append_json(rows: DataFrame, path: str) -> None:
    """Append ledger rows (receipts, turns, cache events) as JSON lines; readers see whole files only."""
    rows.write.mode("append").json(path)


SYMBOL = "id string, text string, source string, line int, language string, kind string, scope string, concern array<string>, id_family string"


def write_items(rows: DataFrame, path: str) -> None:
    """Symbols or sentences, in a folder per repository and kind of item, by source and line."""
    repo = F.substring_index("source", "/", 1)
    kind = F.col("item_kind") if "item_kind" in rows.columns else F.lit("symbol")
    rows.withColumn("repo", repo).withColumn("slice", kind).repartitionByRange("repo", "source", "line").sortWithinPartitions("repo", "source", "line").write.partitionBy("repo", "slice").mode("overwrite").json(path)


def read_items(spark: SparkSession, path: str, schema: str = SYMBOL, kind: str | None = None) -> DataFrame:
    """Written items with ``repo`` and ``slice`` from their folders; ``kind`` picks one slice; rows without text are left out."""
    rows = spark.read.schema(schema + ", repo string, slice string").option("mode", "FAILFAST").json(path).where("trim(coalesce(text, '')) != ''")
    return rows.where(F.col("slice") == kind) if kind else rows


def read_yaml(spark: SparkSession, root: str, exts: str = ".yaml,.yml", **options) -> DataFrame:
    """(source, pos, entry): the entries of YAML lists below ``root``; ``entry`` is JSON text whose scalars are strings."""
    import pandas as pd

    from quern.operators.chunkers import yaml_entries
    from quern.sources.tree import read_tree

    def load(frames):
        import json

        for pdf in frames:
            rows = []
            for f in pdf.itertuples(index=False):
                rows += [(f.path, i, json.dumps(e, ensure_ascii=False)) for i, e in enumerate(yaml_entries(f.content.decode("utf-8", "replace")))]
            yield pd.DataFrame(rows, columns=["source", "pos", "entry"])

    return read_tree(spark, root, exts=exts, **options).select("path", "content").mapInPandas(load, "source string, pos int, entry string")


def latest_version(paths: list[str]) -> str | None:
    """The path with the highest number in its name (``v10`` after ``v9``)."""
    import re

    number = lambda p: [int(x) for x in re.findall(r"[0-9]+", p.rsplit("/", 1)[-1])] or [-1]
    return max(paths, key=lambda p: (number(p), p), default=None)
