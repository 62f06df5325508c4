"""Counts by axis, reports as text, and what a generated document must hold.

Reports are columns of text, put together in SQL from rows that people read; only
the last step, one row, goes to the driver or a file.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import graph

MOST_BYTES, LEAST_BYTES = 96 * 1024, 120
SECTIONS = (
    ("eval_case", "Cases to add"), ("eval_pointer", "Turns to look at again"), ("investigate", "Wrong or partial verdicts"), ("corpus_gap", "Cites that nothing resolves"), ("dictionary_term", "Terms to define"),
)


def counted(df: DataFrame, *axes: str) -> DataFrame:
    """(axis, value, n): rows by each axis in one pass; a row counts once for every value of an array axis, empty values as ''."""
    kinds = dict(df.dtypes)

    def pairs(a: str) -> Column:
        if kinds[a].startswith("array"):
            values = F.when(F.size(F.coalesce(a, F.array().cast(kinds[a]))) > 0, F.array_distinct(a)).otherwise(F.array(F.lit("")))
        else:
            values = F.array(F.coalesce(F.col(a).cast("string"), F.lit("")))
        return F.transform(values, lambda v: F.struct(F.lit(a).alias("axis"), v.alias("value")))

    each = F.flatten(F.array(*map(pairs, axes)))
    return df.select(F.explode(each).alias("x")).groupBy("x.axis", "x.value").agg(F.count("*").alias("n"))


def yaml_text(raw) -> Column:
    """A JSON object as YAML text: Spark's JSON parser reads it, PyYAML writes it, keys in their order; empty for what is no JSON."""
    @F.pandas_udf("string")
    def render(rows: pd.Series) -> pd.Series:
        import yaml

        def one(x):
            try:
                return yaml.safe_dump(json.loads(x), sort_keys=False, allow_unicode=True)
            except (TypeError, ValueError):
                return ""

        return rows.map(one)

    return render(text.col(raw))


def case_yaml(turn_id="turn_id", scope="scope", request="request", claim="claim", diff="diff", verdict="verdict", cites="cites") -> Column:
    """A proposal as an entry of a suite: its request, or its claim with the diff and what is expected of it."""
    quoted = lambda c: F.to_json(F.array(F.coalesce(text.col(c), F.lit(""))))
    plain = lambda c: F.expr(f"substring({c}, 2, length({c}) - 2)") if isinstance(c, str) else F.substring(c, F.lit(2), F.length(c) - 2)
    head = F.concat(F.lit("  - id: "), text.col(turn_id), F.lit("\n    scope: ["), F.array_join(F.coalesce(text.col(scope), F.array().cast("array<string>")), ", "), F.lit("]\n"))
    lines = F.array_join(F.transform(F.split(F.regexp_replace(F.coalesce(text.col(diff), F.lit("")), r"\n+\z", ""), "\n"), lambda x: F.concat(F.lit("      "), x, F.lit("\n"))), "")
    expected = F.concat(
        F.when(F.coalesce(text.col(verdict), F.lit("")) != "", F.concat(F.lit("      verdict: "), text.col(verdict), F.lit("\n"))).otherwise(""),
        F.when(F.size(F.coalesce(text.col(cites), F.array().cast("array<string>"))) > 0, F.concat(F.lit("      must_cite_any_of: ["), F.array_join(text.col(cites), ", "), F.lit("]\n"))).otherwise(""),
    )
    with_claim = F.concat(F.lit("    claim: "), plain(quoted(claim)), F.lit("\n    diff: |\n"), lines, F.lit("    expected:\n"), expected)
    return F.concat(head, F.when(F.coalesce(text.col(claim), F.lit("")) == "", F.concat(F.lit("    request: "), plain(quoted(request)), F.lit("\n"))).otherwise(with_claim))


def proposal_lines(proposals: DataFrame) -> DataFrame:
    """(kind, id, line): each proposal as Markdown, for a report or a ticket."""
    item = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"- {label}: "), value, F.lit("\n"))).otherwise("")
    line = F.concat(
        F.lit("### "), F.col("id"), F.lit("\n"), item("turn", F.col("turn_id")), item("label", F.col("label")), item("scope", F.array_join("scope", ",")), item("verdict", F.col("verdict")),
        item("request", text.one_line("request", 200)), item("claim", text.one_line("claim", 200)), item("cites", F.array_join("cites", ", ")), item("evidence", text.one_line("evidence", 200)),
    )
    return proposals.select("kind", "id", line.alias("line"))


def harvest_report(proposals: DataFrame) -> DataFrame:
    """(place, kind, n, body): a section for every kind of proposal, also for those without one."""
    dim = proposals.sparkSession.createDataFrame([(i, k, t) for i, (k, t) in enumerate(SECTIONS)], "place int, kind string, title string")
    rows = F.array_sort(F.collect_list(F.struct("id", "line")))
    p = proposal_lines(proposals).groupBy("kind").agg(F.count("*").alias("n"), F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("lines"))
    p = dim.join(p, "kind", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return p.select("place", "kind", "n", F.concat(F.lit("## "), "title", F.lit(" ("), F.col("n").cast("string"), F.lit(")\n\n"), F.coalesce("lines", F.lit("(none)\n"))).alias("body"))


def first_attempt_blockers(violations: DataFrame, results: DataFrame) -> DataFrame:
    """(case_id, body): the blockers of a case's first attempt, so that a repaired regression still shows."""
    v = violations.where("severity = 'BLOCKER'")
    line = F.concat(F.lit("  ["), "code", F.lit("] @ "), "location", F.when(F.col("value") != "", F.concat(F.lit(" ("), "value", F.lit(")"))).otherwise(""))
    v = v.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    return v.join(results.select("case_id", "attempts"), "case_id").select("case_id", F.concat(F.col("case_id").cast("string"), F.lit(" (attempts="), F.col("attempts").cast("string"), F.lit("):\n"), "lines").alias("body"))


def diff_lines(table: DataFrame) -> DataFrame:
    """(case_id, line) of a comparison (case_id, now, was) in columns."""
    return table.select("case_id", F.concat(F.rpad(F.col("case_id").cast("string"), 46, " "), F.lit(" "), F.rpad("now", 10, " "), F.lit(" "), F.rpad("was", 10, " ")).alias("line"))


def digest_problems(documents: DataFrame, digests: DataFrame, known: DataFrame) -> DataFrame:
    """(doc, bytes_in, bytes_out, unresolved, accepted): digests (doc, text) of ``documents`` (doc, text).

    A document above ``MOST_BYTES`` is not digested; a digest under ``LEAST_BYTES``, or
    one that cites an id which neither its document nor ``known`` (cite) holds, is refused.
    """
    d = documents.select("doc", F.octet_length("text").alias("bytes_in"), text.cites("text").alias("own"))
    g = digests.select("doc", F.octet_length(text.trim_space("text")).alias("bytes_out"), text.cites("text").alias("said"))
    both = d.join(g, "doc", "left").select("doc", "bytes_in", F.coalesce("bytes_out", F.lit(0)).alias("bytes_out"), F.explode_outer(F.array_except(F.coalesce("said", F.array().cast("array<string>")), "own")).alias("cite"))
    both = both.join(known.select("cite", F.lit(True).alias("is_known")).distinct(), "cite", "left").groupBy("doc", "bytes_in", "bytes_out").agg(F.count_if(F.col("cite").isNotNull() & F.col("is_known").isNull()).alias("unresolved"))
    ok = (F.col("bytes_in") <= MOST_BYTES) & (F.col("bytes_out") >= LEAST_BYTES) & (F.col("unresolved") == 0)
    return both.select("doc", "bytes_in", "bytes_out", "unresolved", ok.alias("accepted"))


def cite_check(docs: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(doc, ok, stale, unresolved): how the cites of documents stand."""
    r = graph.resolved(graph.document_cites(docs), graph.first_sources(chunks), files)
    return r.groupBy("doc").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "stale", "unresolved")])


def split_rows(rows: DataFrame, key: str = "id", seed: int = 7, share: float = 0.1, least: int = 50) -> DataFrame:
    """``rows`` with ``part`` (train, eval): a share of them, ``least`` at the least, by the order of a seeded hash of their key.

    The cut is a hash value found by counting buckets of hashes, so nothing is sorted as a whole.
    """
    h = rows.withColumn("_h", F.xxhash64(F.lit(seed), key))
    n = rows.count()
    wanted = min(n, max(least, int(n * share)))
    bucket = F.shiftrightunsigned("_h", 52)  # 4096 of them
    sizes = sorted((r["b"], r["n"]) for r in h.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect())
    edge, before = 0, 0
    for b, size in sizes:
        edge = b
        if before + size >= wanted:
            break
        before += size
    rest = h.where(bucket == edge).withColumn("_r", F.row_number().over(Window.orderBy(bucket, "_h", key))).withColumn("part", F.when(F.col("_r") <= wanted - before, "eval").otherwise("train")).drop("_r")
    return h.where(bucket != edge).withColumn("part", F.when(bucket < edge, "eval").otherwise("train")).unionByName(rest).drop("_h")


def triplet_accuracy(triples: DataFrame) -> DataFrame:
    """(n, accuracy): how often the anchor is nearer to the positive than to the negative (three embeddings a row)."""
    from quern.operators.vectors import cosine

    return triples.agg(F.count("*").alias("n"), F.avg((cosine("anchor", "positive") > cosine("anchor", "negative")).cast("int")).alias("accuracy"))
