"""The citation graph: who cites whom, and which citations resolve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text


def cite_edges(chunks: DataFrame) -> DataFrame:
    """(citer_chunk, citer_id, cite, owner_chunk): outbound cites that name another chunk's artifact_id."""
    out = chunks.select(F.col("chunk_id").alias("citer_chunk"), F.col("artifact_id").alias("citer_id"), F.explode("cites_outbound").alias("cite"))
    owners = chunks.where("coalesce(artifact_id, '') != ''").select(F.col("artifact_id").alias("cite"), F.col("chunk_id").alias("owner_chunk"))
    return out.join(owners, "cite").where("citer_chunk != owner_chunk")


def with_inbound(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``cites_inbound``: the sorted artifact ids of the chunks that cite it; citers without an id don't show."""
    inbound = cite_edges(chunks).where("coalesce(citer_id, '') != ''").select(F.col("owner_chunk").alias("_o"), "citer_id").distinct()
    inbound = inbound.groupBy("_o").agg(F.array_sort(F.collect_list("citer_id")).alias("cites_inbound"))
    return chunks.join(inbound, F.col("chunk_id") == F.col("_o"), "left").drop("_o").withColumn("cites_inbound", F.coalesce("cites_inbound", F.array().cast("array<string>")))


def first_sources(chunks: DataFrame) -> DataFrame:
    """(cite, source): each artifact id's first source by path."""
    return chunks.where("coalesce(artifact_id, '') != ''").groupBy(F.col("artifact_id").alias("cite")).agg(F.min_by("source", F.struct("source", "source_anchor")).alias("source"))


PATH_CITE = r"(?<![A-Za-z0-9_/.-])([A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+\.(?:md|yaml|java|ts|tsx|go|tf|py))(?::[0-9]+(?:-[0-9]+)?)?"


def document_cites(docs: DataFrame, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """(doc, cite, kind, line): distinct cited ids and paths of ``docs`` (doc, text), with their first line."""
    d = docs.select("doc", F.posexplode(text.lines_of("text")).alias("i", "raw"))
    found = d.select("doc", "i", F.explode(text.cites("raw")).alias("cite")).withColumn("kind", F.lit("id"))
    paths = d.select("doc", "i", F.explode(F.regexp_extract_all("raw", F.lit(PATH_CITE), 1)).alias("cite")).withColumn("kind", F.lit("path"))
    if prefixes:
        paths = paths.where(F.substring_index("cite", "/", 1).isin(*prefixes))
    return found.unionByName(paths).groupBy("doc", "cite", "kind").agg((F.min("i") + 1).alias("line"))


def resolved(cites: DataFrame, sources: DataFrame, files: DataFrame) -> DataFrame:
    """``cites`` with ``source``, ``status`` (ok, stale, unresolved).

    ``sources``: cite, source.  ``files``: path, indexed_sha, live_sha.  A cite
    whose source has another content than the indexed one, both known, is stale.
    """
    ids_ = cites.where("kind = 'id'").join(sources, "cite", "left")
    paths = cites.where("kind = 'path'").join(files.select(F.col("path").alias("cite"), F.col("path").alias("source")), "cite", "left")
    both = ids_.unionByName(paths).join(files.select(F.col("path").alias("source"), "indexed_sha", "live_sha"), "source", "left")
    stale = F.col("indexed_sha").isNotNull() & F.col("live_sha").isNotNull() & (F.col("indexed_sha") != F.col("live_sha"))
    return both.select("doc", "cite", "kind", "line", "source", F.when(F.col("source").isNull(), "unresolved").when(stale, "stale").otherwise("ok").alias("status"))


def first_definitions(chunks: DataFrame, category) -> DataFrame:
    """(term, category, source, body): the first chunk of each categorised artifact id, by source and anchor."""
    c = chunks.where("coalesce(artifact_id, '') != ''").withColumn("category", category).where("category IS NOT NULL")
    return c.groupBy(F.col("artifact_id").alias("term")).agg(F.min_by(F.struct("category", "source", "body"), F.struct("source", "source_anchor")).alias("x")).select("term", "x.*")


# Artifact id shapes and their category, in order.
CATEGORIES = (
    (r"D[0-9]+", "domain.decision"),
    (r"AP[0-9]+", "domain.anti_pattern"),
    (r"(?:ABB|ABO|ABC|ABD|ABE|ABS|ABT)-[0-9]+", "domain.anti_pattern.backend"),
    (r"(?:AWC|AWH|AWS|AWR|AWT|AWB|AWTA|AWA)-[0-9]+", "domain.anti_pattern.webapp"),
    (r"(?:AMC|AMP|AMS|AMN|AMH|AME|AMTA)-[0-9]+", "domain.anti_pattern.mobile"),
    (r"(?:SB|SI|SW|SM|SX)-[0-9]+", "domain.standard_rule.security"),
    (r"WA-[A-Z]+(?:-[0-9]+)?", "domain.standard_rule.architecture.webapp"),
    (r"(?:TBX|TBU|TBC|TBE|TAP)-[0-9]+", "domain.standard_rule.testing.backend"),
    (r"(?:TWU|TWC|TWE|TAW)-[0-9]+", "domain.standard_rule.testing.webapp"),
    (r"(?:TMU|TMC|TME|TAM)-[0-9]+", "domain.standard_rule.testing.mobile"),
    (r"(?:OL|OT|OM|OH|OE|OW|OA|OI|AO)-[0-9]+", "domain.standard_rule.observability"),
    (r"[UBWMTEI]-[0-9]+", "domain.standard_rule.quality"),
    (r"SS-[0-9]+", "domain.standard_rule.schema"),
    (r"(?:RL|RK|RM|RS)[0-9]+", "domain.retrospective_rule"),
)


def category(artifact_id):
    """The dictionary category of an artifact id; null for an id of no known shape."""
    c = text.col(artifact_id)
    out = F.lit(None).cast("string")
    for p, name in reversed(CATEGORIES):
        out = F.when(c.rlike(rf"\A(?:{p})\z"), name).otherwise(out)
    return out


def category_scope(category):
    """The scope whose dictionary holds a category: the stack that its last part names, else universal."""
    last = F.substring_index(text.col(category), ".", -1)
    return F.when(last.isin("backend", "webapp", "mobile"), last).otherwise("universal")


def definition(title, body):
    """The title; without one, the body's first sentence after a bracketed head line, of at most 240 bytes."""
    title = text.trim_space(F.coalesce(text.col(title), F.lit("")))
    b = text.trim_space(F.coalesce(text.col(body), F.lit("")))
    b = text.trim_space(F.when(b.startswith("[") & b.contains("\n"), F.regexp_replace(b, r"\A[^\n]*\n", "")).otherwise(b))
    first = text.trim_space(F.when(b.rlike(r"\A[^.!?\n]"), F.regexp_extract(b, r"\A[^.!?\n]+", 0)).otherwise(b))
    return F.when(title != "", title).when(F.octet_length(first) > 240, F.concat(text.cap_utf8(first, 240), F.lit("…"))).otherwise(first)


def dictionary_entries(chunks: DataFrame) -> DataFrame:
    """(term, category, scope, definition, cite): the first chunk of every categorised artifact id, by source and anchor."""
    c = chunks.where("coalesce(artifact_id, '') != ''").withColumn("category", category("artifact_id")).where("category IS NOT NULL")
    best = F.min_by(F.struct("category", "title", "body", "source", "source_anchor"), F.struct("source", "source_anchor")).alias("x")
    c = c.groupBy(F.col("artifact_id").alias("term")).agg(best).select("term", "x.*")
    cite = F.when(F.coalesce("source_anchor", F.lit("")) != "", F.col("source_anchor")).otherwise(F.col("source"))
    return c.select("term", "category", category_scope("category").alias("scope"), definition("title", "body").alias("definition"), cite.alias("cite"))


def bootstrap(chunks: DataFrame, existing: DataFrame) -> DataFrame:
    """The dictionary after a bootstrap: ``existing`` (scope, term, ...) as it is, and the entries of ``chunks`` whose term its scope lacks.

    A column ``added`` tells them apart; a second run adds nothing.
    """
    found = dictionary_entries(chunks).withColumn("added", F.lit(True))
    fresh = found.join(existing.select("scope", "term"), ["scope", "term"], "left_anti")
    return existing.withColumn("added", F.lit(False)).unionByName(fresh, allowMissingColumns=True)


def bootstrap_stats(chunks: DataFrame, existing: DataFrame) -> DataFrame:
    """One row: chunks read, with an id, entries found, added and skipped."""
    read = chunks.agg(F.count("*").alias("chunks_read"), F.count_if(F.coalesce("artifact_id", F.lit("")) != "").alias("with_id"))
    found = dictionary_entries(chunks).join(existing.select("scope", "term").distinct().withColumn("_known", F.lit(True)), ["scope", "term"], "left")
    return read.crossJoin(F.broadcast(found.agg(F.count("*").alias("found"), F.count_if(F.col("_known").isNull()).alias("added"), F.count("_known").alias("skipped"))))  # one row each


def merged_terms(existing: DataFrame, found: DataFrame) -> DataFrame:
    """``existing`` (term, ...) and the terms of ``found`` that it lacks."""
    return existing.unionByName(found.join(existing.select("term"), "term", "left_anti"), allowMissingColumns=True)
