"""Between retrieval and a prompt: flat metadata, provenance, merged queries, rendered context, summaries.

``hits``: qid, rank, id, scope, source, source_anchor, artifact_id, doc, distance,
a bounded number of them per query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text

ALWAYS = ("source", "scope", "doc_type")
TEXTS = ("source_sha", "source_anchor", "artifact_id", "title", "section", "severity", "status")
LISTS = ("cites_outbound", "cites_inbound", "tech_tags")
#: What a code repository's chunks leave out.
NOT_IN_REPOS = ("artifact_id", "severity", "status", "cites_inbound")
SNIPPET = 160
# Folders of the knowledge base that hold prose worth indexing, and the curated ones among them.
PROSE_FOLDERS = ("patterns", "anti-patterns", "decisions", "standards", "architecture", "skills", "templates", "dictionary", "runbooks")
CURATED_FOLDERS = ("decisions", "anti-patterns", "patterns", "dictionary")


def flat_metadata(df: DataFrame, leave_out: tuple[str, ...] = ()) -> Column:
    """A map of a chunk's fields for stores that hold scalars: empty ones are left out, lists are joined by commas.

    The fields in ``ALWAYS`` are there even if empty.
    """
    here = [c for c in (*ALWAYS, *TEXTS, *LISTS) if c in df.columns and c not in leave_out]
    value = lambda c: F.array_join(c, ",") if c in LISTS else F.col(c).cast("string")
    m = F.create_map(*[x for c in here for x in (F.lit(c), F.coalesce(value(c), F.lit("")))])
    return F.map_filter(m, lambda k, v: k.isin(*ALWAYS) | (v != ""))


def _below(path, folders) -> Column:
    return F.concat(F.lit("/"), F.regexp_replace(text.col(path), r"\\", "/")).rlike("/(?:" + "|".join(folders) + ")/")


def prose_candidate(repo, path, knowledge_base: str = "knowledge-base") -> Column:
    """Whether a file's prose is indexed: any of a code repository, only those in certain folders of the knowledge base."""
    return (text.col(repo) != knowledge_base) | _below(path, PROSE_FOLDERS)


def not_curated(path) -> Column:
    return ~_below(path, CURATED_FOLDERS)


def backup(path) -> Column:
    return F.lower(text.col(path)).endswith(".bak")


def scope_filter(df: DataFrame, scopes: list[str] | None) -> DataFrame:
    """All rows without scopes, else those of the scopes."""
    return df.where(F.col("scope").isin(*scopes)) if scopes else df


def first_set(*values) -> Column:
    """The first value that is neither null nor empty nor zero."""
    unset = lambda v: F.when(v.cast("string").isin("", "0"), None).otherwise(v)
    return F.coalesce(*[unset(text.col(v)) for v in values])


def merged_queries(first: DataFrame, second: DataFrame) -> DataFrame:
    """Hits of two queries for one question, the second's behind the first's: not sorted again, and repeats stay for later steps to settle."""
    both = first.withColumn("query_no", F.lit(1)).unionByName(second.withColumn("query_no", F.lit(2)))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("query_no", "distance", "id")))


def provenance(hits: DataFrame, known: DataFrame, prefix: str = "knowledge-base/") -> DataFrame:
    """``hits`` with ``source`` and ``source_anchor`` prefixed where only that form is ``known`` (cite)."""
    out, k = hits, known.select("cite").distinct()
    for c in ("source", "source_anchor"):
        plain, longer = k.select(F.col("cite").alias("_p"), F.lit(True).alias("_plain")), k.select(F.col("cite").alias("_l"), F.lit(True).alias("_long"))
        out = out.withColumn("_k", F.concat(F.lit(prefix), F.col(c))).join(plain, F.col(c) == F.col("_p"), "left").join(longer, F.col("_k") == F.col("_l"), "left")
        out = out.withColumn(c, F.when(F.col("_plain").isNull() & F.col("_long") & (F.col(c) != ""), F.col("_k")).otherwise(F.col(c))).drop("_k", "_p", "_l", "_plain", "_long")
    return out


def block(artifact_id="artifact_id", anchor="source_anchor", source="source", distance="distance", scope="scope", doc="doc") -> Column:
    """One hit as text: what to cite it by, how near it is, and its body."""
    some = lambda c, name: F.when(F.coalesce(text.col(c), F.lit("")) != "", F.concat(F.lit(f" {name}="), text.col(c)))
    head = F.coalesce(some(artifact_id, "artifact_id"), some(anchor, "source"), some(source, "source"), F.lit(""))
    near = F.concat(F.lit(" (distance="), F.format_string("%.4f", text.col(distance)), F.lit(", scope="), text.col(scope), F.lit(")"))
    return F.concat(F.lit("---"), head, near, F.lit(" ---\n"), F.regexp_replace(text.col(doc), r"\n\z", ""), F.lit("\n\n"))


def contexts(hits: DataFrame) -> DataFrame:
    """(qid, context): the blocks of a query's hits by rank."""
    rows = F.array_sort(F.collect_list(F.struct("rank", block().alias("b"))))
    return hits.groupBy("qid").agg(F.array_join(F.transform(rows, lambda x: x["b"]), "").alias("context"))


def prompts(questions: DataFrame, context: DataFrame, order: str = "Answer as one JSON object, without any other text.") -> DataFrame:
    """(qid, prompt) of ``questions`` (qid, request); a question without hits gets no context."""
    q = questions.join(context, "qid", "left")
    return q.select("qid", F.concat(F.lit("REQUEST:\n"), text.trim_space("request"), F.lit("\n\nCONTEXT, nearest first:\n\n"), F.coalesce("context", F.lit("")), F.lit("\n" + order + "\n")).alias("prompt"))


def summaries(hits: DataFrame) -> DataFrame:
    """(qid, rank, distance, scope, source, artifact_id, snippet) to keep with a run: ``SNIPPET`` characters of each hit."""
    return hits.select("qid", "rank", "distance", "scope", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("artifact_id", F.lit("")).alias("artifact_id"), text.first_runes("doc", SNIPPET).alias("snippet"))


def sources_in_order(hits: DataFrame, c: str = "source") -> DataFrame:
    """(qid, sources): the distinct sources of a query's hits, in the order in which they first come."""
    rows = F.array_sort(F.collect_list(F.struct("rank", F.col(c).alias("v"))))
    return hits.where(F.coalesce(c, F.lit("")) != "").groupBy("qid").agg(F.array_distinct(F.transform(rows, lambda x: x["v"])).alias("sources"))


def claim_stats(outputs: DataFrame) -> DataFrame:
    """(case_id, parsed, evidenced, partial, unmatched, cites): assessments of an answer (case_id, raw) by verdict, and its distinct cites as they come."""
    kind = "struct<validate:struct<claim_assessments:array<struct<verdict:string,cites:array<string>>>>>"
    a = outputs.select("case_id", F.coalesce(F.from_json("raw", kind)["validate"]["claim_assessments"], F.array()).alias("a"))
    of = lambda v: F.size(F.filter("a", lambda x: x["verdict"] == v)).cast("long")
    cites = F.array_distinct(F.filter(F.flatten(F.transform("a", lambda x: F.coalesce(x["cites"], F.array().cast("array<string>")))), lambda c: F.coalesce(c, F.lit("")) != ""))
    return a.select("case_id", F.size("a").cast("long").alias("parsed"), *[of(v).alias(v) for v in ("evidenced", "partial", "unmatched")], cites.alias("cites"))


def verdict_of(raw) -> tuple[Column, Column]:
    """(verdict, proceed) of a challenge or validate answer; null where it is no JSON."""
    pick = lambda name, other: F.coalesce(text.json_field(raw, "challenge", name), text.json_field(raw, "validate", other))
    return pick("verdict", "overall_verdict"), pick("proceed", "proceed")
