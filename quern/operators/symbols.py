"""Declarations found line by line: Java, TypeScript, Terraform, Markdown headings, dictionary terms, API collections.

Each language is an ordered list of (kind, pattern); the first pattern that fits
a line names it.  All of it is built-in SQL over exploded lines, except the
recursive walk of an API collection.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import dims, ids, text
from quern.operators import chunkers

S, W = text.SPACE, "[A-Za-z0-9_]"


def _mods(*words: str) -> str:
    return "(?:" + "|".join(f"{w}{S}+" for w in words) + ")*"


EXPORT = rf"(?:export{S}+(?:default{S}+)?)?"
# What a declaration looks like in each language, in order.
PATTERNS: dict[str, tuple[tuple[str, str], ...]] = {
    "java": (
        ("package", rf"\A{S}*package{S}+([A-Za-z0-9_.]+){S}*;"),
        ("annotation", rf"\A{S}*(?:public{S}+|private{S}+|protected{S}+)?@interface{S}+({W}+)"),
        ("class", rf"\A{S}*{_mods('public', 'private', 'protected', 'static', 'final', 'abstract', 'sealed', 'non-sealed')}class{S}+({W}+)"),
        ("interface", rf"\A{S}*{_mods('public', 'private', 'protected', 'static', 'sealed', 'non-sealed')}interface{S}+({W}+)"),
        ("enum", rf"\A{S}*{_mods('public', 'private', 'protected', 'static', 'final')}enum{S}+({W}+)"),
    ),
    "typescript": (
        ("interface", rf"\A{S}*{EXPORT}interface{S}+({W}+)"),
        ("type", rf"\A{S}*{EXPORT}type{S}+({W}+){S}*[<=]"),
        ("enum", rf"\A{S}*{EXPORT}(?:const{S}+)?enum{S}+({W}+)"),
        ("hook", rf"\A{S}*{EXPORT}(?:async{S}+)?function{S}+(use[A-Z]{W}*){S}*[<(]"),
        ("component", rf"\A{S}*{EXPORT}(?:async{S}+)?function{S}+([A-Z]{W}+){S}*[<(]"),
        ("hook", rf"\A{S}*{EXPORT}const{S}+(use[A-Z]{W}*){S}*(?::[^=]+)?{S}*={S}*(?:async{S}+)?\("),
        ("component", rf"\A{S}*{EXPORT}const{S}+([A-Z]{W}+){S}*(?::[^=]+)?{S}*={S}*(?:async{S}+)?\("),
        ("endpoint", rf"\A{S}+({W}+){S}*:{S}*build(?:er)?\.(?:query|mutation|infiniteQuery){text.RIGHT}"),
        ("constant", rf"\A{S}*(?:export{S}+)?const{S}+([A-Z][A-Z0-9_]+){S}*(?::[^=]+)?{S}*="),
    ),
    "hcl": (
        ("resource", rf'\Aresource{S}+"([^"]+)"{S}+"([^"]+)"{S}*\{{'),
        ("resource", rf'\Adata{S}+"([^"]+)"{S}+"([^"]+)"{S}*\{{'),
        ("module", rf'\Amodule{S}+"([^"]+)"{S}*\{{'),
        ("variable", rf'\Avariable{S}+"([^"]+)"{S}*\{{'),
        ("output", rf'\Aoutput{S}+"([^"]+)"{S}*\{{'),
        ("config_key", rf'\Aprovider{S}+"([^"]+)"{S}*\{{'),
    ),
}
TEST_FILE = r"/(?:__tests__|e2e|tests)/|(?i:\.(?:test|spec)\.tsx?\z)"
# Heading id prefixes and their family.
ID_FAMILIES = {
    "decision": ("D",), "anti_pattern": ("AP",), "pattern": ("PC",), "failure_mode": ("FM",), "symbol": ("SB",), "input_validation": ("IV",), "immutable_fields": ("IMF",), "webapp_arch": ("WA",),
    "mobile_ap": ("AM", "AMC", "AMP", "AMS", "AMN", "AMH", "AME", "AMTA"), "webapp_ap": ("AW", "AWC", "AWH", "AWS", "AWR", "AWT", "AWB", "AWTA", "AWA"),
    "backend_ap": ("AB", "ABB", "ABO", "ABC", "ABD", "ABE", "ABS", "ABT"),
}


def _named(lang: str, kind: str, pattern: str) -> tuple[Column, Column]:
    fits = F.col("raw").rlike(pattern)
    name = F.regexp_extract("raw", pattern, 1)
    if pattern.startswith(r"\Aresource"):
        name = F.concat_ws(".", name, F.regexp_extract("raw", pattern, 2))
    elif pattern.startswith(r"\Adata"):
        name = F.concat_ws(".", F.lit("data"), name, F.regexp_extract("raw", pattern, 2))
    return fits, F.struct(F.lit(kind).alias("kind"), name.alias("text"))


def finish(found: DataFrame, language: str, projects=None) -> DataFrame:
    """(source, repo, line, kind, text[, id_family]) with id, language, scope and concerns."""
    if "id_family" not in found.columns:
        found = found.withColumn("id_family", F.lit(None).cast("string"))
    return found.select(
        ids.symbol_id("source", "line", "text").alias("id"), "text", "source", "line", F.lit(language).alias("language"), "kind",
        dims.repo_scope("repo", projects).alias("scope"), text.path_concerns("source").alias("concern"), "id_family",
    )


def declarations(files: DataFrame, language: str, projects=None) -> DataFrame:
    """Symbols of ``files`` (repo, source, text) in one language of :data:`PATTERNS`."""
    if language == "typescript":
        files = files.where(~F.concat(F.lit("/"), F.regexp_replace("source", r"\\", "/")).rlike(TEST_FILE))
    d = files.select("repo", "source", F.posexplode(text.lines_of("text")).alias("i", "raw"))
    cases = [_named(language, k, p) for k, p in PATTERNS[language]]
    hit = F.when(*cases[0])
    for fits, value in cases[1:]:
        hit = hit.when(fits, value)
    d = d.withColumn("hit", hit).where("hit IS NOT NULL").select("repo", "source", (F.col("i") + 1).alias("line"), "hit.kind", "hit.text")
    return finish(d, language, projects)


def heading_symbols(files: DataFrame, projects=None) -> DataFrame:
    """H2 to H4 headings: an id of a known family, else a named concept."""
    d = files.select("repo", "source", F.posexplode(text.lines_of("text")).alias("i", "raw"))
    d = d.withColumn("t", text.trim_space(F.regexp_extract("raw", rf"(?d)\A#{{2,4}}{S}+(.+?){S}*\z", 1))).where("t != ''")
    prefix, num = (F.regexp_extract("t", rf"\A([A-Z]{{1,4}})-?([0-9]+){text.RIGHT}", g) for g in (1, 2))
    fam = F.lit(None).cast("string")
    for name, prefixes in ID_FAMILIES.items():
        fam = F.when(prefix.isin(*prefixes), name).otherwise(fam)
    d = d.withColumn("id_family", fam)
    named = F.col("id_family").isNotNull()
    return finish(d.select("repo", "source", (F.col("i") + 1).alias("line"), F.when(named, "id").otherwise("class").alias("kind"), F.when(named, F.concat(prefix, num)).otherwise(F.col("t")).alias("text"), "id_family"), "markdown", projects)


def dictionary_terms(files: DataFrame, projects=None) -> DataFrame:
    """One symbol per entry with a term of a dictionary file (a list of maps)."""

    def read(frames):
        import yaml

        for pdf in frames:
            rows = []
            for f in pdf.itertuples(index=False):
                try:
                    top = chunkers.parsed_yaml(f.text or "")
                except yaml.YAMLError:
                    continue
                for i, e in enumerate(top if isinstance(top, list) else []):
                    if isinstance(e, dict) and isinstance(e.get("term"), str) and e["term"]:
                        rows.append((f.repo, f.source, i + 1, "term", e["term"]))
            yield pd.DataFrame(rows, columns=["repo", "source", "line", "kind", "text"])

    return finish(files.select("repo", "source", "text").mapInPandas(read, "repo string, source string, line int, kind string, text string"), "yaml", projects)


def collection_symbols(files: DataFrame, projects=None) -> DataFrame:
    """Collection, folder, endpoint and variable names of API collection files (JSON with nested items)."""

    def read(frames):
        for pdf in frames:
            rows = []
            for f in pdf.itertuples(index=False):
                try:
                    top = json.loads(f.text or "")
                except ValueError:
                    continue
                if not isinstance(top, dict):
                    continue
                found = []
                if (name := (top.get("info") or {}).get("name")):
                    found.append(("package", name))
                stack = list(reversed(top.get("item") or []))
                while stack:  # nesting has no bound, so no recursion
                    item = stack.pop()
                    if item.get("item"):
                        found.append(("module", item.get("name", "")))
                        stack += reversed(item["item"])
                    elif item.get("request") is not None:
                        found.append(("endpoint", item.get("name", "")))
                found += [("variable", v.get("key", "")) for v in top.get("variable") or []]
                rows += [(f.repo, f.source, i + 1, k, t) for i, (k, t) in enumerate(found) if t]
            yield pd.DataFrame(rows, columns=["repo", "source", "line", "kind", "text"])

    return finish(files.select("repo", "source", "text").mapInPandas(read, "repo string, source string, line int, kind string, text string"), "json", projects)


#: Registry of extractors by language: a seam for more of them.
EXTRACTORS = {
    "java": lambda f, p=None: declarations(f, "java", p), "typescript": lambda f, p=None: declarations(f, "typescript", p), "hcl": lambda f, p=None: declarations(f, "hcl", p),
    "markdown": heading_symbols, "yaml": dictionary_terms, "json": collection_symbols,
}


def items(symbols: DataFrame, sentences: DataFrame) -> DataFrame:
    """Symbols and sentences in one frame, told apart by ``item_kind``."""
    both = symbols.withColumn("item_kind", F.lit("symbol")).unionByName(sentences.withColumn("item_kind", F.lit("sentence")), allowMissingColumns=True)
    return both.withColumn("item_id", ids.item_id("item_kind", "id"))
