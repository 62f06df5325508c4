"""Incremental re-indexing by content hash: diff, guards, and upsert without MERGE."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import dims

BUILDER_VERSION = "1"


class SyncRefused(RuntimeError):
    """The sync would damage the index, so nothing was written."""


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change, old_scope, new_scope) of sources (path, sha, scope): added, changed, removed; what is equal is left out."""
    o = old.select("path", F.col("sha").alias("o_sha"), F.col("scope").alias("old_scope"), F.lit(True).alias("o"))
    n = new.select("path", F.col("sha").alias("n_sha"), F.col("scope").alias("new_scope"), F.lit(True).alias("n"))
    same = F.col("o_sha").eqNullSafe(F.col("n_sha")) & F.col("old_scope").eqNullSafe(F.col("new_scope"))
    both = o.join(n, "path", "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~same, "changed").otherwise("same")
    return both.select("path", change.alias("change"), "old_scope", "new_scope").where("change != 'same'")


def summary(changes: DataFrame) -> DataFrame:
    """(change, n) with a row for each kind of change."""
    return changes.sparkSession.createDataFrame([("added",), ("changed",), ("removed",)], "change string").join(changes.groupBy("change").count(), "change", "left").select("change", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def guard(old: DataFrame | None, new: DataFrame, old_version: str | None, version: str = BUILDER_VERSION, memory_prefix: str = "memory/", folders: tuple[str, ...] = ()) -> None:
    """Refuse without a manifest, on another builder version, with no tree sources, or when all memory sources vanish.

    Refuse also when one of ``folders``, the first parts of paths, vanishes as a
    whole: a checkout that isn't there must not delete its chunks.
    """
    if old is None:
        raise SyncRefused("no manifest: build and index first")
    if old_version != version:
        raise SyncRefused(f"the manifest was built by version {old_version}, this is {version}: rebuild")
    memory = F.col("path").startswith(memory_prefix)
    count = lambda df: df.agg(F.count_if(~memory).alias("tree"), F.count_if(memory).alias("memory")).first()
    was, now = count(old), count(new)
    if not now["tree"]:
        raise SyncRefused("the walk found no sources of the tree")
    if was["memory"] and not now["memory"]:
        raise SyncRefused("all memory sources are gone")
    if gone := vanished(old, new, folders):
        raise SyncRefused(f"all sources are gone of: {', '.join(gone)}")


def vanished(old: DataFrame, new: DataFrame, folders: tuple[str, ...]) -> list[str]:
    """Which of ``folders`` have sources in ``old`` and none in ``new``."""
    if not folders:
        return []
    first = lambda df: df.select(F.substring_index("path", "/", 1).alias("folder")).where(F.col("folder").isin(*folders)).distinct()
    return sorted(r["folder"] for r in first(old).join(first(new), "folder", "left_anti").collect())


def affected(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """Chunks of added or changed sources."""
    return chunks.join(changes.where("change != 'removed'").select(F.col("path").alias("source")), "source", "left_semi")


def upsert(stored: DataFrame, fresh: DataFrame, changes: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The table after a sync: old copies of touched sources go, from their old scope; fresh rows replace equal keys."""
    gone = changes.where("change != 'added'").select(F.col("path").alias("source"), F.col("old_scope").alias("scope"))
    kept = stored.join(gone, ["source", "scope"], "left_anti").join(fresh.select(key), key, "left_anti")
    return kept.unionByName(fresh)


def delete_where(stored: DataFrame, **equal) -> DataFrame:
    """``stored`` without the rows that equal all given values; an empty predicate is refused."""
    if not equal:
        raise SyncRefused("a delete needs a predicate")
    test = F.lit(True)
    for k, v in equal.items():
        test = test & (F.col(k).isin(*v) if isinstance(v, (list, tuple)) else F.col(k) == v)
    return stored.where(~F.coalesce(test, F.lit(False)))


def source_rows(chunks: DataFrame) -> DataFrame:
    """(path, sha, scope, doc_type, chunks): the manifest's row per source."""
    return chunks.groupBy(F.col("source").alias("path")).agg(F.min("source_sha").alias("sha"), F.min("scope").alias("scope"), F.min("doc_type").alias("doc_type"), F.count("*").alias("chunks"))


def tallies(chunks: DataFrame) -> DataFrame:
    """(axis, value, n): chunks by scope, by document type and in all, in one pass."""
    g = chunks.groupingSets([["scope"], ["doc_type"], []], "scope", "doc_type").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    axis = F.when(F.col("g") == 1, "scope").when(F.col("g") == 2, "doc_type").otherwise("total")
    return g.select(axis.alias("axis"), F.when(F.col("g") == 1, F.col("scope")).when(F.col("g") == 2, F.col("doc_type")).otherwise("").alias("value"), "n")


def scope_counts(chunks: DataFrame) -> DataFrame:
    """(scope, n) for every scope, with zeros."""
    dim = dims.scope_dim(chunks.sparkSession)
    return dim.join(chunks.groupBy("scope").count(), "scope", "left").select("scope_no", "scope", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


@dataclass
class Outcome:
    """What a sync did."""

    added: int
    changed: int
    removed: int

    @property
    def no_op(self) -> bool:
        return not (self.added or self.changed or self.removed)


def sync(spark, root: str, chunks: DataFrame, version: str = BUILDER_VERSION, folders: tuple[str, ...] = (), dry_run: bool = False) -> Outcome:
    """Bring the tables below ``root`` (chunks, sources, version) to ``chunks``; sources are written last, as the commit mark.

    Nothing is written if nothing changed, or for a ``dry_run``.  ``folders``: see :func:`guard`.  New generations are written beside
    the old ones, so an interrupted run leaves the old tables readable.
    """
    from quern.sources import tables

    new_sources = source_rows(chunks)
    at = tables.current(spark, root)
    guard(None if at is None else spark.read.parquet(f"{at}/sources"), new_sources, None if at is None else tables.version(spark, root), version, folders=folders)
    changes = diff(spark.read.parquet(f"{at}/sources"), new_sources).persist()
    counts = {r["change"]: r["n"] for r in summary(changes).collect()}
    out = Outcome(counts["added"], counts["changed"], counts["removed"])
    if not out.no_op and not dry_run:
        merged = upsert(spark.read.parquet(f"{at}/chunks"), affected(chunks, changes), changes)
        tables.write_generation(spark, root, merged, new_sources, version)
    changes.unpersist()
    return out
