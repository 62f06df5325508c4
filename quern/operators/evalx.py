"""Evaluation reports: violations, grading, aggregates, gate verdicts, comparisons with a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text

SEVERITIES = {"BLOCKER": 0, "WARNING": 1, "INFO": 2}
# The proceed value that a verdict requires.
PROCEED = {"VALID": "proceed_directly", "VALID_WITH_CAVEATS": "confirm_with_user", "INVALID": "abort", "NEEDS_CLARIFICATION": "confirm_with_user", "OUT_OF_SCOPE": "abort"}
# Requests that are no requests.
PLACEHOLDERS = ("clarification", "clarification_required", "clarification_not_required", "no_changes_required", "request_clarification", "none_required", "none", "n/a", "na")
CHALLENGE = (
    "struct<challenge:struct<request:string,verdict:string,proceed:string,confirms:array<struct<claim:string,cites:array<string>>>,contradicts:array<struct<claim:string,cites:array<string>>>,"
    "clarify:array<string>,applicable_rules:struct<standards:array<string>,patterns:array<string>,anti_patterns_to_avoid:array<string>,decisions_to_honor:array<string>>>>"
)
#: The knowledge base's folder, which a cited path may name or not.
HOME = "knowledge-base"
RULE_LISTS = ("standards", "patterns", "anti_patterns_to_avoid", "decisions_to_honor")
ASSESSMENT = "struct<assessments:array<struct<claim_id:string,verdict:string,evidence:string,cites:array<string>>>,verdict:string,proceed:string>"


FINDING = "struct<severity:string,code:string,location:string,value:string,cite:string>"


def _entry(severity: str, code: str, location, value="", cite=None) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), as_col(location).alias("location"), F.coalesce(as_col(value).cast("string"), F.lit("")).alias("value"), as_col(cite).cast("string").alias("cite"))


def _some(*cases: tuple[Column, Column]) -> Column:
    """The entries whose test holds."""
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), entry) for test, entry in cases]))


def _list(c) -> Column:
    return F.coalesce(c, F.array())


def _cited(at: Column, items: Column) -> Column:
    """Entries of a list of cites: each one, to be resolved, and every second occurrence."""
    place = lambda i: F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))
    each = F.transform(_list(items), lambda x, i: _entry("BLOCKER", "cite_unresolved", place(i), x, x))
    again = F.transform(_list(items), lambda x, i: _some((F.size(F.filter(F.slice(items, 1, i), lambda y: y == x)) == 1, _entry("INFO", "duplicate_cite", place(i), x))))
    return F.concat(F.filter(each, lambda x: x["cite"].isNotNull()), F.flatten(again))


def _claims_of(side: str):
    """The findings on one claim of a list, as a function of the claim and its place."""

    def entries(e: Column, i: Column) -> Column:
        at = F.concat(F.lit(side + "["), i.cast("string"), F.lit("]"))
        claim = F.octet_length(text.trim_space(e["claim"]))
        own = _some((F.size(_list(e["cites"])) == 0, _entry("BLOCKER", f"{side}_unsupported", F.concat(at, F.lit(".cites")))), ((claim > 0) & (claim < 20), _entry("INFO", "short_claim", F.concat(at, F.lit(".claim")), e["claim"])))
        return F.concat(own, _cited(F.concat(at, F.lit(".cites")), e["cites"]))

    return entries


# Fixed value: what a cited path looks like: folders, and a name with an extension.
PATH = r"\A[a-zA-Z][a-zA-Z0-9_ ./+-]*\.[a-zA-Z0-9_]+\z"


def canonical_path(path, home: str = HOME) -> Column:
    """A path of the knowledge base with or without its folder's name, or one of a repository, in one form."""
    return F.regexp_replace(text.col(path), rf"\A{home}/", "")


def _forms(cite, prefixes: tuple[str, ...], home: str = HOME) -> tuple[Column, Column, Column]:
    """What a cite may name: a term as it stands, a term before an anchor, a path in its canonical form; null where it can't."""
    whole = text.trim_space(cite)
    base = F.regexp_extract(whole, r"\A[^#]*", 0)
    path = F.when(base.contains("/") & base.rlike(PATH) & F.substring_index(base, "/", 1).isin(home, *prefixes), canonical_path(base, home))
    return F.nullif(whole, F.lit("")), F.when(whole != "", base), path


def resolving_cites(cites: DataFrame, known: DataFrame, files: DataFrame | None = None, prefixes: tuple[str, ...] = (), home: str = HOME) -> DataFrame:
    """The distinct ``cite`` of ``cites`` that name a term of ``known`` (cite) or a path of ``files`` (path).

    An anchor (``#D1``, ``#L3-L9``) is cut off first; a term may also hold one
    itself.  A path counts only if its first folder is ``home`` or one of
    ``prefixes``.  Each distinct cite is looked up once, by at most three keys.
    """
    whole, base, path = _forms("cite", prefixes, home)
    keys = F.array_distinct(F.array_compact(F.array(F.concat(F.lit("term:"), whole), F.concat(F.lit("term:"), base), F.concat(F.lit("path:"), path))))
    asked = cites.select("cite").distinct().select("cite", F.explode(keys).alias("key"))
    have = known.select(F.concat(F.lit("term:"), "cite").alias("key"))
    if files is not None:
        have = have.unionByName(files.select(F.concat(F.lit("path:"), canonical_path("path", home)).alias("key")))
    return asked.join(have, "key", "left_semi").select("cite").distinct()


def _unresolved(entries: DataFrame, known: DataFrame, files: DataFrame | None = None, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Entries (case_id, e) as findings; those of a cite stay only if nothing resolves it.

    The entries are computed once and sifted by each form of a cite.  What has no
    such form gets a key of its own, so no key is hot.
    """
    own = F.concat(F.lit("\0"), F.xxhash64("case_id", "e.code", "e.location").cast("string"))
    terms = known.select(F.col("cite").alias("_key"))
    tables = [terms, terms, None if files is None else files.select(canonical_path("path").alias("_key"))]
    for form, table in zip(_forms("e.cite", prefixes), tables, strict=True):
        if table is not None:
            entries = entries.join(table, F.coalesce(form, own) == F.col("_key"), "left_anti")
    return entries.select("case_id", "e.severity", "e.code", "e.location", "e.value")


def challenge_violations(outputs: DataFrame, known: DataFrame, files: DataFrame | None = None, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """(case_id, severity, code, location, value): all findings on model outputs (case_id, raw).

    Cites resolve by the terms ``known`` (cite) and the paths ``files`` (path), see
    :func:`resolving_cites`.  An output that is no JSON
    object gives one blocker.  Each output is parsed once; its findings form one array.
    """
    p = outputs.withColumn("j", F.from_json("raw", CHALLENGE)).select("case_id", "raw", F.col("j.challenge").alias("c"))
    n_of = lambda c: F.size(_list(F.col(c)))
    found = [_some((F.col("c").isNull(), _entry("BLOCKER", "output_not_parseable_json", "(root)", F.substring("raw", 1, 80))))]
    found += [F.flatten(F.transform(_list(F.col(f"c.{side}")), _claims_of(side))) for side in ("confirms", "contradicts")]
    found += [_cited(F.lit(f"applicable_rules.{name}"), F.col(f"c.applicable_rules.{name}")) for name in RULE_LISTS]
    want = F.lit(None).cast("string")
    for k, v in PROCEED.items():
        want = F.when(F.col("c.verdict") == k, v).otherwise(want)
    verdict, good = F.col("c.verdict"), F.col("c").isNotNull()
    request = F.lower(text.trim_space(F.coalesce(F.col("c.request"), F.lit(""))))
    empty = (request == "") | request.isin(*PLACEHOLDERS)
    nothing = (n_of("c.confirms") == 0) & (n_of("c.contradicts") == 0) & (n_of("c.clarify") == 0)
    found.append(_some(
        (want.isNotNull() & ~F.col("c.proceed").eqNullSafe(want), _entry("BLOCKER", "verdict_proceed_mismatch", "proceed", F.col("c.proceed"))),
        ((verdict == "INVALID") & (n_of("c.contradicts") == 0), _entry("BLOCKER", "invalid_without_contradicts", "contradicts")),
        ((verdict == "NEEDS_CLARIFICATION") & (n_of("c.clarify") == 0), _entry("BLOCKER", "clarify_required_but_empty", "clarify")),
        (good & empty, _entry("BLOCKER", "placeholder_request", "request", F.col("c.request"))),
        (good & ~empty & ((F.octet_length(request) < 10) | ~request.contains(" ")), _entry("BLOCKER", "request_too_short", "request", F.col("c.request"))),
        ((verdict == "OUT_OF_SCOPE") & (n_of("c.confirms") > 0), _entry("WARNING", "out_of_scope_with_confirms", "confirms")),
        ((verdict == "OUT_OF_SCOPE") & (n_of("c.contradicts") > 0), _entry("WARNING", "out_of_scope_with_contradicts", "contradicts")),
        (verdict.isin("VALID_WITH_CAVEATS", "INVALID", "NEEDS_CLARIFICATION") & nothing, _entry("WARNING", "empty_assessment", "challenge")),
    ))
    return _unresolved(p.select("case_id", F.explode(F.concat(*[x.cast(f"array<{FINDING}>") for x in found])).alias("e")), known, files, prefixes)


def assessment_violations(outputs: DataFrame, claims: DataFrame, known: DataFrame, files: DataFrame | None = None, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Findings on assessments (case_id, raw) of ``claims`` (case_id, claim_id): unknown, missing, unsupported, unresolved.

    Each output is parsed once and meets its case's claims as one array; its findings form another.
    """
    c = claims.groupBy("case_id").agg(F.array_sort(F.collect_set("claim_id")).alias("claims"))
    p = outputs.select("case_id", "raw", F.from_json("raw", ASSESSMENT)["assessments"].alias("a")).join(c, "case_id", "left")
    p = p.withColumn("claims", _list(F.col("claims"))).withColumn("assessed", F.transform("a", lambda x: x["claim_id"]))
    place = lambda i: F.concat(F.lit("assessments["), i.cast("string"), F.lit("]"))

    def of_assessment(x: Column, i: Column) -> Column:
        own = _some(
            (~F.coalesce(F.array_contains("claims", x["claim_id"]), F.lit(False)), _entry("BLOCKER", "unknown_claim", place(i), x["claim_id"])),
            (F.size(_list(x["cites"])) == 0, _entry("BLOCKER", "assessment_unsupported", place(i))),
        )
        each = F.transform(_list(x["cites"]), lambda y, k: _entry("BLOCKER", "cite_unresolved", F.concat(place(i), F.lit(".cites["), k.cast("string"), F.lit("]")), y, F.coalesce(y, F.lit(""))))
        return F.concat(own, each)

    missing = F.transform(F.array_except("claims", _list(F.col("assessed"))), lambda x: _entry("BLOCKER", "claim_not_assessed", F.concat(F.lit("claims."), x), x))
    found = [
        _some((F.col("a").isNull(), _entry("BLOCKER", "output_not_parseable_json", "(root)", F.substring("raw", 1, 80)))),
        F.when(F.col("a").isNotNull(), missing).otherwise(F.array()),
        F.flatten(F.transform(_list(F.col("a")), of_assessment)),
    ]
    return _unresolved(p.select("case_id", F.explode(F.concat(*[x.cast(f"array<{FINDING}>") for x in found])).alias("e")), known, files, prefixes)


def in_order(violations: DataFrame) -> DataFrame:
    rank = F.when(F.col("severity") == "BLOCKER", 0).when(F.col("severity") == "WARNING", 1).otherwise(2)
    return violations.orderBy("case_id", rank, "location", "code", "value")


def severity_counts(violations: DataFrame) -> DataFrame:
    """(case_id, blockers, warnings, infos)."""
    is_ = lambda s: F.count_if(F.col("severity") == s)
    return violations.groupBy("case_id").agg(is_("BLOCKER").alias("blockers"), is_("WARNING").alias("warnings"), is_("INFO").alias("infos"))


def graded(results: DataFrame, expected: DataFrame) -> DataFrame:
    """``results`` with ``matched``: null without a contract, else whether verdict, blockers and cites are as expected."""
    e = expected.select("case_id", F.col("verdict").alias("e_verdict"), "max_blockers", "must_cite_any_of", "must_not_cite_any_of", F.lit(True).alias("has"))
    r = results.join(e, "case_id", "left")
    out = F.coalesce("raw_output", F.lit(""))
    verdict = (F.coalesce("e_verdict", F.lit("")) == "") | (F.col("e_verdict") == F.col("verdict"))
    blockers = F.col("max_blockers").isNull() | (F.col("blockers") <= F.col("max_blockers"))
    must = F.col("must_cite_any_of").isNull() | F.exists("must_cite_any_of", lambda c: F.contains(out, c))
    none = F.col("must_not_cite_any_of").isNull() | ~F.exists("must_not_cite_any_of", lambda c: F.contains(out, c))
    return r.withColumn("matched", F.when(F.col("has"), verdict & blockers & must & none)).drop("e_verdict", "max_blockers", "must_cite_any_of", "must_not_cite_any_of", "has")


def report(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Totals per suite or overall: clean cases, findings, first-try rate, graded rate (null when nothing was graded)."""
    matched = F.avg(F.col("matched").cast("int")) if "matched" in results.columns else F.lit(None).cast("double")
    aggs = [
        F.count("*").alias("total_cases"), F.count_if(F.col("blockers") == 0).alias("clean_cases"), F.sum("blockers").alias("total_blockers"), F.sum("warnings").alias("total_warnings"),
        F.sum("infos").alias("total_infos"), F.coalesce(F.count_if(F.col("attempts") == 1) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("first_try_rate"), matched.alias("graded_rate"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"),
    ]
    return results.groupBy(*by).agg(*aggs) if by else results.agg(*aggs)


def new_blockers(results: DataFrame, baseline: DataFrame) -> DataFrame:
    """Cases with blockers now that the baseline had clean: no error, no blockers, no warnings."""
    clean = baseline.where("coalesce(error, '') = '' AND blockers = 0 AND warnings = 0").select("case_id")
    return results.where("blockers > 0").join(clean, "case_id", "left_semi").select("case_id").distinct()


def gate(results: DataFrame, min_clean: int, max_blockers: int, min_first_try: float = 0.0, baseline: DataFrame | None = None) -> DataFrame:
    """One row: pass, reasons, and the numbers of errors and of new blockers; :func:`gate_cases` names the cases."""
    fresh = new_blockers(results, baseline) if baseline is not None else results.where("false").select("case_id")
    r = report(results).crossJoin(F.broadcast(fresh.agg(F.count("*").alias("new_blockers"))))  # one row each
    reasons = F.array_compact(F.array(
        F.when(F.col("clean_cases") < min_clean, F.lit("clean cases below threshold")), F.when(F.col("total_blockers") > max_blockers, F.lit("blockers above threshold")),
        F.when((F.lit(min_first_try) > 0) & (F.col("first_try_rate") < min_first_try), F.lit("first-try rate below threshold")), F.when(F.col("new_blockers") > 0, F.lit("new blockers on clean cases")),
        F.when(F.col("errors") > 0, F.lit("errors")),
    ))
    return r.withColumn("reasons", reasons).select((F.size("reasons") == 0).alias("pass"), "reasons", "errors", "new_blockers")


def gate_cases(results: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """(case_id, why): the cases that keep a gate shut by themselves, with an error or a new blocker."""
    errors = results.where("coalesce(error, '') != ''").select("case_id", F.lit("error").alias("why"))
    return errors if baseline is None else errors.unionByName(new_blockers(results, baseline).withColumn("why", F.lit("new blocker")))


def diff_table(results: DataFrame, baseline: DataFrame) -> DataFrame:
    """(case_id, now, was): blockers/warnings of each case now and in the baseline."""
    pair = lambda b, w: F.concat(F.col(b).cast("string"), F.lit("/"), F.col(w).cast("string"))
    b = baseline.select("case_id", F.col("blockers").alias("b"), F.col("warnings").alias("w"))
    return results.join(b, "case_id", "left").select("case_id", F.when(F.coalesce("error", F.lit("")) != "", "ERROR").otherwise(pair("blockers", "warnings")).alias("now"), F.coalesce(pair("b", "w"), F.lit("-")).alias("was"))


RANK = {"pass": 0, "skip": 1, "usage": 2, "fail": 3}


def suite_set_verdict(verdicts: DataFrame) -> DataFrame:
    """The worst verdict of a set of suites."""
    rank = F.lit(0)
    for k, v in RANK.items():
        rank = F.when(F.col("verdict") == k, v).otherwise(rank)
    return verdicts.agg(F.max_by("verdict", rank).alias("verdict"))


def bucket_score(expected: DataFrame, surfaced: DataFrame) -> DataFrame:
    """(case_id, bucket, found, missing): expected cites against surfaced ones."""
    e = expected.groupBy("case_id", "bucket").agg(F.array_sort(F.collect_set("cite")).alias("e"))
    s = surfaced.groupBy("case_id", "bucket").agg(F.collect_set("cite").alias("s"))
    both = e.join(s, ["case_id", "bucket"], "left").withColumn("s", F.coalesce("s", F.array().cast("array<string>")))
    return both.select("case_id", "bucket", F.array_intersect("e", "s").alias("found"), F.array_except("e", "s").alias("missing"))
