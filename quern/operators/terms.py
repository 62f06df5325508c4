"""The terms that may be cited: where they are defined, which resolve, which are listed, and what a model may choose from.

A term file lies in the folder of a layer; a folder below that names its scope,
and a file without one belongs to the apex scope, which every request includes.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators.chunkers import parsed_yaml

# Layers in the order in which they define terms, and their folders.
LAYERS = (("dictionary", "dictionary"), ("concept", "concepts"), ("constraint", "constraints"), ("glossary", "glossary"))
APEX = "business"
# Folders under which a cited path may lie.  A deployment passes its own.
PREFIXES = ("decisions", "anti-patterns", "standards", "patterns", "workflows", "prompts", "retrospectives", "templates", "skills", "operations", "architecture", "dictionary")


def layer_of(path) -> Column:
    out = F.lit(None).cast("string")
    for layer, folder in LAYERS:
        out = F.when(text.col(path).startswith(folder + "/"), layer).otherwise(out)
    return out


def term_scope(path) -> Column:
    """The folder below the layer's; the apex scope for a file that lies in the layer's folder itself."""
    parts = F.split(text.col(path), "/")
    return F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).otherwise(APEX)


def entries_of(files: DataFrame) -> DataFrame:
    """(path, pos, term, synonyms) of term ``files`` (path, text): YAML lists; a file that isn't one gives none."""

    def read(frames):
        from yaml import YAMLError

        for pdf in frames:
            rows = []
            for path, body in zip(pdf["path"], pdf["text"], strict=True):
                try:
                    top = parsed_yaml(body or "")
                except YAMLError:
                    continue
                for pos, e in enumerate(top if isinstance(top, list) else []):
                    if isinstance(e, dict):
                        synonyms = e.get("synonyms")
                        rows.append((path, pos, e["term"] if isinstance(e.get("term"), str) else "", [s for s in synonyms if isinstance(s, str)] if isinstance(synonyms, list) else []))
            yield pd.DataFrame(rows, columns=["path", "pos", "term", "synonyms"])

    return files.select("path", "text").where(F.col("path").endswith(".yaml")).mapInPandas(read, "path string, pos int, term string, synonyms array<string>")


def named(entries: DataFrame) -> DataFrame:
    """(name, layer, scope, listed, place): every term and synonym, in the order in which they are read.

    An entry's term comes before its synonyms; entries go by layer, path and position.
    """
    number = F.lit(None).cast("int")
    for i, (layer, _) in enumerate(LAYERS):
        number = F.when(F.col("layer") == layer, i).otherwise(number)
    e = entries.withColumn("layer", layer_of("path")).where("layer IS NOT NULL").withColumn("scope", term_scope("path"))
    names = F.concat(F.array(F.struct(F.col("term").alias("name"), F.lit(True).alias("listed"))), F.transform(F.coalesce("synonyms", F.array().cast("array<string>")), lambda s: F.struct(s.alias("name"), F.lit(False).alias("listed"))))
    e = e.select("layer", "scope", number.alias("_l"), "path", "pos", F.posexplode(names).alias("_i", "x")).where("x.name != ''")
    return e.select("x.name", "layer", "scope", "x.listed", F.struct("_l", "path", "pos", "_i").alias("place"))


def known_terms(names: DataFrame) -> DataFrame:
    """(cite): everything that resolves, terms and synonyms."""
    return names.select(F.col("name").alias("cite")).distinct()


def listed_terms(names: DataFrame) -> DataFrame:
    """(term, layer, scope): the terms that are offered; where a name comes again, only its first place counts, and a synonym is never offered."""
    first = names.groupBy(F.col("name").alias("term")).agg(F.min_by(F.struct("layer", "scope", "listed"), "place").alias("x"))
    return first.where("x.listed").select("term", "x.layer", "x.scope")


def layer_counts(listed: DataFrame) -> DataFrame:
    """(layer, n) for every layer."""
    dim = listed.sparkSession.createDataFrame([(layer,) for layer, _ in LAYERS], "layer string")
    return dim.join(listed.groupBy("layer").count(), "layer", "left").select("layer", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def in_scopes(listed: DataFrame, scopes: list[str]) -> DataFrame:
    """The terms of the apex scope and the given ones."""
    return listed.where(F.col("scope").isin(APEX, *scopes))


def cite_terms(listed: DataFrame, scopes: list[str]) -> DataFrame:
    """(term): all that a request for ``scopes`` may cite but paths: its scopes' terms, and dictionary terms of any scope."""
    return listed.where((F.col("scope").isin(APEX, *scopes) | (F.col("layer") == "dictionary")) & ~F.col("term").contains("/")).select("term").distinct()


def matching(terms: DataFrame, pattern: str) -> DataFrame:
    return terms.where(F.col("term").rlike(pattern))


# ---------------------------------------------------------------- what a model may answer


# The characters of a cited path below its first folder, of the name's extension, and of an anchor.
PATH_CHARS, EXTENSION_CHARS, ANCHOR_CHARS = "A-Za-z0-9_ ./+-", "A-Za-z0-9_", "A-Za-z0-9._-"


def path_pattern(prefixes=PREFIXES) -> str:
    """A pattern for cited files below ``prefixes``, with an optional anchor; empty without prefixes."""
    below = f"/[{PATH_CHARS}]*[.][{EXTENSION_CHARS}]+"
    return f"^(?:{'|'.join(map(re.escape, prefixes))}){below}(?:#[{ANCHOR_CHARS}]+)?$" if prefixes else ""


def strings(**one_of) -> dict:
    """A JSON schema for a string that meets one of the given keywords; those without a value don't count."""
    kinds = [{"type": "string", keyword: value} for keyword, value in one_of.items() if value]
    return {"anyOf": kinds} if kinds else {"type": "string"}


def at_most(most: int, items: dict | None = None) -> dict:
    return {"type": "array", "maxItems": most} | ({"items": items} if items else {})


def choice(values: list[str], most: int = 8) -> dict:
    """A JSON schema for a list out of ``values``; only the empty list if there are none."""
    return at_most(most, {"type": "string", "enum": values}) if values else at_most(0)


def cites_schema(terms: list[str], prefixes=PREFIXES, most: int = 12) -> dict:
    """A JSON schema for a list of cites.  Where paths can be told by their folders, each is one of these or of ``terms``; else any string is one."""
    return at_most(most, strings(pattern=path_pattern(prefixes), enum=terms)) if prefixes else {"type": "array", "items": strings()}


def answer_schema(listed: DataFrame, scopes: list[str], prefixes=PREFIXES) -> dict:
    """The JSON schema of a challenge answer.  The driver gets the terms of a dictionary, which people write."""
    every = sorted(r["term"] for r in cite_terms(listed, scopes).collect())
    fits = lambda p: [t for t in every if re.fullmatch(p, t)]
    claim = {"type": "array", "items": {"type": "object", "required": ["claim", "cites"], "properties": {"claim": {"type": "string"}, "cites": cites_schema(every, prefixes)}}}
    rules = {"standards": choice(fits(r"[A-Z]+-[A-Z0-9-]+")), "patterns": choice([t for t in every if "-" not in t and not re.fullmatch(r"[A-Z]+[0-9]+", t)]), "anti_patterns_to_avoid": choice(fits(r"A[A-Z]*-?[0-9]+")), "decisions_to_honor": choice(fits(r"D[0-9]+"))}
    verdicts = ["VALID", "VALID_WITH_CAVEATS", "INVALID", "NEEDS_CLARIFICATION", "OUT_OF_SCOPE"]
    body = {"request": {"type": "string"}, "verdict": {"type": "string", "enum": verdicts}, "proceed": {"type": "string", "enum": ["proceed_directly", "confirm_with_user", "abort"]}, "confirms": claim, "contradicts": claim, "clarify": {"type": "array", "items": {"type": "string"}}, "applicable_rules": {"type": "object", "properties": rules}}
    return {"type": "object", "required": ["challenge"], "properties": {"challenge": {"type": "object", "required": ["request", "verdict", "proceed"], "properties": body}}}


#: What to tell a model whose answer had a finding of this code.
GUIDANCE = {
    "output_not_parseable_json": "Answer with one JSON object and nothing else.",
    "cite_unresolved": "Cite only identifiers and paths from the retrieved context; leave a list empty rather than guess.",
    "confirms_unsupported": "Give every confirmed claim at least one cite.",
    "contradicts_unsupported": "Give every contradicted claim at least one cite.",
    "verdict_proceed_mismatch": "Let proceed follow from the verdict.",
    "invalid_without_contradicts": "An INVALID verdict needs a contradicted claim; otherwise choose another verdict.",
    "clarify_required_but_empty": "Ask at least one question where clarification is needed.",
    "placeholder_request": "Repeat the request in its own words.",
    "request_too_short": "Repeat the whole request.",
}


def guidance(violations: DataFrame) -> DataFrame:
    """(case_id, addendum): per case with blockers, what to fix: the findings in order of place, then advice for each code, once."""
    advice = F.lit(None).cast("string")
    for code, line in GUIDANCE.items():
        advice = F.when(F.col("code") == code, line).otherwise(advice)
    item = F.struct("location", "code", "value", advice.alias("advice"))
    v = violations.where("severity = 'BLOCKER'").groupBy("case_id").agg(F.array_sort(F.collect_set(item)).alias("v"))
    line = lambda x: F.concat(F.lit("- ["), x["code"], F.lit("] at "), x["location"], F.when(x["value"] != "", F.concat(F.lit(": "), x["value"])).otherwise(""))
    hints = F.array_sort(F.array_distinct(F.array_compact(F.transform("v", lambda x: x["advice"]))))
    return v.select("case_id", F.concat(F.lit("Your last answer had these problems:\n"), F.array_join(F.transform("v", line), "\n"), F.lit("\nPlease:\n"), F.array_join(F.transform(hints, lambda x: F.concat(F.lit("- "), x)), "\n")).alias("addendum"))
