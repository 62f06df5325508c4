"""Queries of file cites, all finding codes, segments, filtered search and streams into tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import evalx, segments, vectors
from quern.plans import generate
from quern.queries import _DIFF, _FAM, _HITS, _NEW, _asked, _pair, _vectors, query, table
from quern.shared import new_folder
from quern.sources import tree

# ---------------------------------------------------------------- cites that name files

#: Forms of a cite of document n, by n % 9; "decisions" is a folder of the knowledge base, "core-api" a repository.
_FORMS = (
    "concat('decisions/d', n, '.md')", "concat('knowledge-base/decisions/d', n, '.md#D', n)", "concat(' decisions/d', n, '.md#L1-L9 ')", "concat('core-api/src/d', n, '.java')", "concat('D', n, '#note')",
    "concat('other/d', n, '.md')", "concat('d', n, '.md')", "concat('decisions/d', n)", "''",
)
_CITE = "CASE " + " ".join(f"WHEN doc_id % 9 = {i} THEN {f}" for i, f in enumerate(_FORMS)) + " END"
_CITES = f"(SELECT doc_id, {_CITE} AS cite FROM (SELECT doc_id, CAST(doc_id AS STRING) AS n FROM documents))"


@query(f"SELECT doc_id, cite, (doc_id % 9 IN (0, 1, 2, 3) AND doc_id % 4 <> 1) OR (doc_id % 9 = 4 AND doc_id % 4 <> 2) AS resolves FROM {_CITES}")
def file_cites(spark, d):
    """Cites of files with anchors, with and without the knowledge base's folder, of a repository and of neither; three of four files exist."""
    n = F.col("doc_id").cast("string")
    docs = table(spark, d, "documents").select("doc_id", n.alias("n"))
    cites = docs.selectExpr("doc_id", f"{_CITE} AS cite")
    here = docs.where("doc_id % 4 <> 1")
    files = here.select(F.concat(F.lit("decisions/d"), "n", F.lit(".md")).alias("path")).unionByName(here.select(F.concat(F.lit("core-api/src/d"), "n", F.lit(".java")).alias("path")))
    known = docs.where("doc_id % 4 <> 2").select(F.concat(F.lit("D"), "n").alias("cite"))
    good = evalx.resolving_cites(cites, known, files, ("decisions", "core-api"))
    return cites.join(good.withColumn("resolves", F.lit(True)), "cite", "left").select("doc_id", "cite", F.coalesce("resolves", F.lit(False)).alias("resolves"))


_CODES = (
    ("k % 6 = 5", "output_not_parseable_json", "(root)"),
    ("k % 6 = 2 AND k % 5 <> 0", "invalid_without_contradicts", "contradicts"),
    ("k % 6 = 3 AND k % 7 <> 0", "clarify_required_but_empty", "clarify"),
    ("k % 6 <> 5 AND k % 4 = 0", "request_too_short", "request"),
    ("k % 6 = 4", "out_of_scope_with_confirms", "confirms"),
    ("k % 6 = 4 AND k % 5 = 0", "out_of_scope_with_contradicts", "contradicts"),
    ("k % 6 = 2 AND k % 5 <> 0 AND k % 7 <> 0", "empty_assessment", "challenge"),
    ("k % 6 <> 5 AND k % 3 = 0", "confirms_unsupported", "confirms[0].cites"),
    ("k % 6 <> 5 AND k % 3 = 0", "short_claim", "confirms[0].claim"),
    ("k % 6 <> 5 AND k % 5 = 0", "contradicts_unsupported", "contradicts[0].cites"),
    ("k % 6 <> 5 AND k % 5 = 0", "short_claim", "contradicts[0].claim"),
    ("k % 6 <> 5 AND k % 3 = 1 AND k % 8 >= 4", "cite_unresolved", "confirms[0].cites[0]"),
)


@query("WITH o AS (SELECT o_orderkey AS k FROM orders) " + " UNION ALL ".join(f"SELECT k AS case_id, '{code}' AS code, '{at}' AS location FROM o WHERE {where}" for where, code, at in _CODES))
def violation_codes(spark, d):
    """Every order as one model's answer, of all verdicts, with the findings that its key calls for, file cites among them."""
    k = F.col("o_orderkey")
    verdict, proceed = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, v in enumerate(("VALID", "VALID_WITH_CAVEATS", "INVALID", "NEEDS_CLARIFICATION", "OUT_OF_SCOPE")):
        verdict, proceed = F.when(k % 6 == i, v).otherwise(verdict), F.when(k % 6 == i, evalx.PROCEED[v]).otherwise(proceed)
    none = F.array().cast("array<string>")
    claim = lambda words, cites: F.array(F.struct(F.lit(words).alias("claim"), cites.alias("cites")))
    no_claim = F.array().cast("array<struct<claim:string,cites:array<string>>>")
    file = F.concat(F.lit("decisions/f"), (k % 8).cast("string"), F.lit(".md#L"), k.cast("string"))
    confirms = F.when(k % 3 == 0, claim("brief", none)).when(k % 3 == 1, claim("a claim of more than twenty bytes", F.array(file))).otherwise(no_claim)
    answer = F.struct(
        F.when(k % 4 == 0, "shortreq").otherwise("please look at this now").alias("request"), verdict.alias("verdict"), proceed.alias("proceed"), confirms.alias("confirms"),
        F.when(k % 5 == 0, claim("also brief", none)).otherwise(no_claim).alias("contradicts"), F.when(k % 7 == 0, F.array(F.lit("why?"))).otherwise(none).alias("clarify"),
    )
    out = table(spark, d, "orders").select(k.alias("case_id"), F.when(k % 6 == 5, "no json").otherwise(F.to_json(F.struct(answer.alias("challenge")))).alias("raw"))
    files = table(spark, d, "orders").select((k % 8).alias("n")).distinct().where("n < 4").select(F.concat(F.lit("decisions/f"), F.col("n").cast("string"), F.lit(".md")).alias("path"))
    known = table(spark, d, "orders").where("false").select(F.lit("").alias("cite"))
    return evalx.challenge_violations(out, known, files, ("decisions",)).select("case_id", "code", "location")


# ---------------------------------------------------------------- segments


@query(f"SELECT 'docs/' || path AS source, sha, scope, n_changes FROM ({_NEW}), (SELECT count(*) AS n_changes FROM ({_DIFF}))")
def segment_sync(spark, d):
    """Segments made of the old sources, then brought to the new ones: their chunks afterwards, and how many changes the second sync found."""
    at = new_folder(spark, "segments")
    named = lambda s: s.select(F.concat(F.lit("docs/"), F.col("path").cast("string")).alias("path"), F.coalesce("sha", F.lit("")).alias("sha"), "scope")
    chunks_of = lambda s: s.select(F.col("path").alias("source"), "sha", "scope", F.concat_ws(":", "path", "sha").alias("chunk_id"))
    old, new = _pair(spark, d)
    segments.sync_segments(spark, at, named(old), chunks_of, 16)
    done = segments.sync_segments(spark, at, named(new), chunks_of, 16)
    n = F.lit(done.added + done.changed + done.removed).cast("long")
    return spark.read.parquet(f"{at}/chunks").select("source", F.when(F.col("sha") != "", F.col("sha")).alias("sha"), "scope", n.alias("n_changes"))


@query(f"SELECT coalesce(scope, 'none') AS scope, count(*) AS sources, count(*) FILTER (path % 3 <> 0) AS chunks FROM ({_NEW}) GROUP BY ALL")
def segment_tallies(spark, d):
    """Sources and chunks by scope after three syncs, the last one back to the second's state, from stored tallies; every third source has no chunk."""
    at = new_folder(spark, "tallies")
    old, new = (s.select(F.col("path").cast("string").alias("path"), F.coalesce("sha", F.lit("")).alias("sha"), F.coalesce("scope", F.lit("none")).alias("scope")) for s in _pair(spark, d))
    chunks_of = lambda s: s.where("CAST(path AS LONG) % 3 <> 0").select(F.col("path").alias("source"), F.col("sha").alias("chunk_id"))
    for state in (new, old, new):
        segments.sync_segments(spark, at, state, chunks_of, 16)
    return segments.tallies(spark, at)


# ---------------------------------------------------------------- search with a filter behind it


@query(f"""
WITH {_HITS}, n AS (SELECT qid, id, distance, {_FAM} AS family FROM h QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, id) <= 15)
SELECT qid, id, (row_number() OVER (PARTITION BY qid ORDER BY distance, id))::INT AS rank FROM n WHERE family = 'corpus' QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, id) <= 5
""")
def filtered_topk(spark, d):
    """Five hits of one family out of the nearest fifteen: what the filter turns away isn't made up for."""
    n = 5
    hits = vectors.nearest_in_blocks(_asked(spark, d), _vectors(spark, d), vectors.over_fetch(n), 6).drop("rank")
    return vectors.filtered_after(hits, F.col("family") == "corpus", n).select("qid", "id", "rank")


@query("""
WITH t AS (SELECT p_partkey AS id, lpad(p_partkey::VARCHAR, 9, '0') AS anchor_id, p_brand AS scope, (p_size % 3)::VARCHAR AS role, p_partkey % 4 = 0 AS relaxed FROM part), k AS (SELECT * FROM t WHERE id % 5 <> 0)
SELECT 'scope' AS axis, scope AS value, count(*) AS n FROM k GROUP BY scope UNION ALL SELECT 'role', role, count(*) FROM k GROUP BY role UNION ALL SELECT 'relaxed', '', count(*) FILTER (relaxed) FROM k
UNION ALL SELECT 'dropped', '', (SELECT count(*) FROM t) - (SELECT count(*) FROM k) UNION ALL SELECT 'relaxed_id', anchor_id, 1 FROM (SELECT anchor_id FROM k WHERE relaxed ORDER BY anchor_id LIMIT 10)
""")
def mining_report(spark, d):
    """What mining gave: a fifth of the anchors have no negative, and ten of the relaxed ones are shown (a report's limit)."""
    p = table(spark, d, "part").select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("anchor_id"), F.col("p_brand").alias("scope"), (F.col("p_size") % 3).cast("string").alias("anchor_role"), (F.col("p_partkey") % 4 == 0).alias("relaxed"), "p_partkey")
    return vectors.mining_summary(p.where("p_partkey % 5 <> 0"), p.select(F.col("anchor_id").alias("id")))


# ---------------------------------------------------------------- cites of commit messages


@query("""
WITH m AS (SELECT doc_id, 'Fix D' || (doc_id % 7) || ' and SB-' || doc_id || ', see CI' || (doc_id % 5) || '; D' || (doc_id % 7) || ' again' || chr(10) || coalesce(text, '') AS message FROM documents),
f AS (SELECT doc_id, unnest([0, 1, 2, 3, 4]) AS p, unnest([regexp_extract_all(message, '\\bD[0-9]{1,4}\\b'), regexp_extract_all(message, '\\bAP[0-9]{1,4}\\b'), regexp_extract_all(message, '\\b[A-Z]{2,4}-[A-Z]?[0-9]+[a-z]?\\b'), regexp_extract_all(message, '\\bCI[0-9]{1,4}\\b'), regexp_extract_all(message, '\\bPC[0-9]{1,4}\\b')]) AS c FROM m),
u AS (SELECT doc_id, p, unnest(c) AS cite, generate_subscripts(c, 1) AS i FROM f)
SELECT doc_id, (SELECT string_agg(cite, ',' ORDER BY p, i) FROM (SELECT cite, min(p) AS p, min(i) AS i FROM u WHERE u.doc_id = m.doc_id GROUP BY cite)) AS cites FROM m
""")
def commit_message_cites(spark, d):
    """Ids that the messages of commits name; every document stands behind a subject line with some."""
    n = F.col("doc_id")
    s = lambda c: c.cast("string")
    message = F.concat(F.lit("Fix D"), s(n % 7), F.lit(" and SB-"), s(n), F.lit(", see CI"), s(n % 5), F.lit("; D"), s(n % 7), F.lit(" again\n"), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.array_join(text.commit_cites(message), ",").alias("cites"))


# ---------------------------------------------------------------- trees


@query("SELECT CASE WHEN doc_id % 4 = 0 THEN 'a' WHEN doc_id % 4 = 1 THEN 'b' ELSE 'c' END AS folder, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes FROM documents WHERE doc_id % 4 < 2 GROUP BY ALL")
def tree_bytes(spark, d):
    """Documents written as files in three folders, and the sizes of two of them read as a tree by path, without contents."""
    at = new_folder(spark, "tree")
    n = F.col("doc_id") % 4
    docs = table(spark, d, "documents").select(F.coalesce("text", F.lit("")).alias("value"), F.when(n == 0, "a").when(n == 1, "b").otherwise("c").alias("folder"))
    docs.write.partitionBy("folder").text(f"{at}/x")
    t = tree.read_tree(spark, at.removeprefix("file:"), exts=".txt", content="false")
    t = t.where(F.col("path").startswith("x/folder=a/") | F.col("path").startswith("x/folder=b/"))
    return t.groupBy(F.regexp_extract("path", "folder=([a-z])/", 1).alias("folder")).agg(F.sum("length").alias("bytes"))


# ---------------------------------------------------------------- generation in waves


def _shaky(prompts: list[str]) -> list[str]:
    """A stand-in whose calls fail for every third anchor, and whose answers for every seventh are no JSON."""
    n = int(prompts[0].rsplit(" ", 1)[1])
    if n % 3 == 0:
        raise RuntimeError("no answer")
    return ["no json" if n % 7 == 0 else json.dumps({"answer": prompts[0].upper()})]


def _steady(prompts: list[str]) -> list[str]:
    return [json.dumps({"answer": "again " + prompts[0]})]


@query("""
WITH p AS (SELECT p_partkey AS k, p_name || ' ' || p_partkey AS anchor, CASE WHEN p_partkey % 3 = 0 THEN 'call' WHEN p_partkey % 7 = 0 THEN 'parse' END AS failure FROM part)
SELECT k::VARCHAR AS anchor_id, CASE WHEN failure IS NULL THEN upper(anchor) ELSE 'again ' || anchor END AS positive, NULL AS failure FROM p UNION ALL SELECT k::VARCHAR, NULL, failure FROM p WHERE failure IS NOT NULL
""")
def generated_in_waves(spark, d):
    """Two runs into the same ledgers: the second asks only for what failed in the first."""
    at = new_folder(spark, "generated")
    anchors = table(spark, d, "part").selectExpr("CAST(p_partkey AS STRING) AS anchor_id", "concat(p_name, ' ', p_partkey) AS anchor")
    for model in (_shaky, _steady):
        generate.generate(spark, anchors, model, at, wave=10_000, calls=4)
    return generate.ledgers(spark, at).select("anchor_id", "positive", "failure")


@query("SELECT kind, (SELECT count(*) FROM part WHERE CASE kind WHEN 'call' THEN p_partkey % 3 = 0 WHEN 'parse' THEN p_partkey % 3 <> 0 AND p_partkey % 7 = 0 ELSE false END) AS n FROM (VALUES ('call'), ('parse'), ('empty'), ('identical'), ('length')) t(kind)")
def failure_kinds(spark, d):
    anchors = table(spark, d, "part").selectExpr("CAST(p_partkey AS STRING) AS anchor_id", "concat(p_name, ' ', p_partkey) AS anchor")
    return generate.failures_by_kind(generate.paraphrases(anchors, _shaky))
