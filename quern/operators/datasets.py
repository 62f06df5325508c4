"""Training rows from catalogs, retrospectives, patterns, lifecycle triples and history; packing and sanitising.

A training row: system, messages (array of role and content), tier, scope, source, role, family, metadata (map).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import dims, ids, text
from quern.operators import chunkers

SYSTEM = "You answer questions about this platform from its knowledge base."
TIERS = {"decisions": 1, "antipatterns": 1, "failure_modes": 1, "patterns": 2, "retros": 2, "triples": 2, "history": 3}
SHORT = 60
FILES_CAP = 10
DIGEST = 800


def part(label: str, c) -> Column:
    """``label`` and the value, null where the value is blank: ``concat_ws`` leaves it out."""
    c = text.col(c)
    return F.when(text.trim_space(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(label), text.trim_space(c)))


def paragraphs(*parts: Column) -> Column:
    return F.concat_ws("\n\n", *parts)


def example(df: DataFrame, user: Column, answer: Column, family: str, role: str, scope: Column, source: Column, tier: int, metadata: Column | None = None) -> DataFrame:
    turn = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    scope = F.when(F.coalesce(scope, F.lit("")) != "", scope).otherwise("universal")
    return df.select(
        F.lit(SYSTEM).alias("system"), F.array(turn("user", user), turn("assistant", answer)).alias("messages"), F.lit(tier).alias("tier"), scope.alias("scope"), source.alias("source"),
        F.lit(role).alias("role"), F.lit(family).alias("family"), (F.create_map().cast("map<string,string>") if metadata is None else metadata).alias("metadata"),
    )


def decisions(entries: DataFrame) -> DataFrame:
    """Rows from decisions (pos, id, name, date, context, decision, alternatives, rationale, outcome, source); a repeated id is numbered."""
    n = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    e = entries.withColumn("_n", n).withColumn("_id", F.when(F.col("_n") > 1, F.concat("id", F.lit("-"), F.col("_n").cast("string"))).otherwise(F.col("id")))
    answer = paragraphs(part("Decision: ", "decision"), part("Context: ", "context"), part("Alternatives: ", "alternatives"), part("Rationale: ", "rationale"), part("Outcome: ", "outcome"))
    e = e.withColumn("_a", answer).where("_a != ''")
    return example(e, F.concat(F.lit("What was decided in "), "_id", F.coalesce(F.concat(F.lit(" ("), "name", F.lit(")")), F.lit("")), F.lit(", and why?")), F.col("_a"), "decision", "decide", F.lit("universal"), F.col("_id"), TIERS["decisions"])


def anti_patterns(entries: DataFrame) -> DataFrame:
    answer = paragraphs(part("What happened: ", "what_happened"), part("Root cause: ", "root_cause"), part("Instead: ", "alternative"), part("Context: ", "context"))
    e = entries.withColumn("_a", answer).where("_a != ''")
    return example(e, F.concat(F.lit("What is anti-pattern "), "id", F.coalesce(F.concat(F.lit(" ("), "name", F.lit(")")), F.lit("")), F.lit(", and how is it avoided?")), F.col("_a"), "anti-pattern", "avoid", F.lit("universal"), F.col("id"), TIERS["antipatterns"])


def failure_modes(entries: DataFrame) -> DataFrame:
    """Rows from entries that have both a prompt and a correct answer."""
    e = entries.where((text.trim_space(F.coalesce("user_prompt", F.lit(""))) != "") & (text.trim_space(F.coalesce("correct_assistant_response", F.lit(""))) != ""))
    answer = paragraphs(part("", "correct_assistant_response"), part("Why: ", "rationale"), part("See: ", "cite"))
    return example(e, text.trim_space("user_prompt"), answer, "failure-mode", "correct", F.col("scope"), F.col("id"), TIERS["failure_modes"])


def failure_mode_chunks(entries: DataFrame) -> DataFrame:
    """One retrievable chunk per complete entry."""
    e = entries.where((text.trim_space(F.coalesce("user_prompt", F.lit(""))) != "") & (text.trim_space(F.coalesce("correct_assistant_response", F.lit(""))) != ""))
    body = paragraphs(part("Failure: ", "what_the_model_does_wrong"), part("Asked: ", "user_prompt"), part("Correct: ", "correct_assistant_response"), part("Why: ", "rationale"), part("See: ", "cite"))
    scope = F.when(F.coalesce("scope", F.lit("")) != "", F.col("scope")).otherwise("universal")
    return e.select(ids.failure_mode_id("id").alias("chunk_id"), F.col("id").alias("artifact_id"), scope.alias("scope"), F.lit("failure_modes").alias("family"), body.alias("body"))


def section_rows(files: DataFrame, level: int | None) -> DataFrame:
    """(source, project, title, body) sections at ``level``; with None a file's H2 or, if it has none, H3 sections."""

    def split(frames):
        for pdf in frames:
            rows = []
            for f in pdf.itertuples(index=False):
                body = f.text or ""
                use = level or (2 if any(x.startswith("## ") for x in chunkers.scan_lines(body)) else 3)
                rows += [(f.source, f.project, t, b) for t, b in chunkers.dataset_sections(body, use)]
            yield pd.DataFrame(rows, columns=["source", "project", "title", "body"])

    return files.select("source", "project", "text").mapInPandas(split, "source string, project string, title string, body string")


def retros(files: DataFrame, projects: dict[str, str] | None = None) -> DataFrame:
    """Rows from retrospectives: one per H2 section of 60 bytes or more; files of unknown projects are left out."""
    known = dims.PROJECT_SCOPES | {"platform": "platform-process"} if projects is None else projects
    s = section_rows(files.where(F.col("project").isin(*known)), 2).where(F.octet_length(text.trim_space("body")) >= SHORT)
    s = s.withColumn("title", F.regexp_replace("title", r"\A[0-9.]*[0-9][0-9.]*[ )-]+", ""))
    avoid = F.lower("title").rlike(r"(?:anti|wrong|fail|mistake|avoid|problem)")
    s = s.withColumn("_role", F.when(avoid, "avoid").otherwise("practice"))
    out = example(s, F.concat(F.lit("What did "), "project", F.lit(" learn about: "), "title", F.lit("?")), text.trim_space("body"), "retro", "practice", dims.repo_scope("project", known), F.col("source"), TIERS["retros"], F.create_map(F.lit("role"), "_role"))
    return out.withColumn("role", F.col("metadata")["role"])


def patterns(files: DataFrame, stacks: dict[str, str]) -> DataFrame:
    """Rows from pattern files: one per section; ``stacks`` maps base names to scopes, others are left out."""
    s = section_rows(files.where(F.col("project").isin(*stacks)), None).where(text.trim_space("body") != "")
    return example(s, F.concat(F.lit("How is this done here: "), "title", F.lit("?")), text.trim_space("body"), "pattern", "practice", dims.repo_scope("project", stacks), F.concat("source", F.lit("#"), text.slug_words("title")), TIERS["patterns"])


def triples(files: DataFrame) -> DataFrame:
    """(project, stem, workflow, prompt, retrospective): complete lifecycles; of repeated kinds the last path stays.

    ``files``: path, project, stem, kind.
    """
    best = files.groupBy("project", "stem").pivot("kind", ["workflow", "prompt", "retrospective"]).agg(F.max("path"))
    return best.dropna(subset=["workflow", "prompt", "retrospective"])


def digest(c) -> Column:
    """A document's first H1 and first paragraph after it, capped at 800 bytes."""
    body = text.col(c)
    title = F.regexp_extract(body, r"(?md)^# ([^\n]+)$", 1)
    para = F.regexp_extract(body, r"(?md)^# [^\n]+\n(?:[ \t]*\n)*((?:[^\n#][^\n]*\n?)+)", 1)
    return text.cap_utf8(F.concat_ws("\n\n", F.nullif(text.trim_space(title), F.lit("")), F.nullif(text.trim_space(para), F.lit(""))), DIGEST)


# ---------------------------------------------------------------- history


def split_message(c) -> tuple[Column, Column]:
    """(subject, body) of a commit message."""
    msg = F.regexp_replace(text.col(c), r"\n+\z", "")
    return text.trim_space(F.regexp_extract(msg, r"(?d)\A[^\n]*", 0)), text.trim_space(F.regexp_replace(msg, r"\A[^\n]*\n?", ""))


def parsed_commits(commits: DataFrame, attribution=text.ATTRIBUTION) -> DataFrame:
    """``commits`` (message, ...) with subject, body without attribution, and cite_ids."""
    subject, body = split_message("message")
    return commits.withColumn("subject", subject).withColumn("body", text.collapse_blank_lines(text.strip_lines(body, attribution))).withColumn("cite_ids", text.commit_cites("message"))


def top_files(files="files", cap: int = FILES_CAP) -> tuple[Column, Column]:
    """(the ``cap`` most changed files by changed lines, then path; how many more there are)."""
    f = text.col(files)
    changed = lambda x: x["additions"] + x["deletions"]
    order = F.array_sort(f, lambda a, b: F.when(changed(a) != changed(b), changed(b) - changed(a)).when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0).cast("int"))
    return F.slice(order, 1, cap), F.greatest(F.size(f) - cap, F.lit(0))


def commit_summaries(commits: DataFrame, cap: int = FILES_CAP) -> DataFrame:
    top, more = top_files("files", cap)
    line = lambda x: F.concat(F.lit("- "), x["path"], F.lit(" ("), x["status"], F.lit(", +"), x["additions"].cast("string"), F.lit("/-"), x["deletions"].cast("string"), F.lit(")"), F.when(F.coalesce(x["old_path"], F.lit("")) != "", F.concat(F.lit(" ← "), x["old_path"])).otherwise(""))
    head = F.concat(F.lit("Files touched"), F.when(more > 0, F.concat(F.lit(f" (top {cap} by changed lines; "), more.cast("string"), F.lit(" more)"))).otherwise(""), F.lit(":\n"))
    answer = paragraphs(F.col("subject"), part("", "body"), F.when(F.size("files") > 0, F.concat(head, F.array_join(F.transform(top, line), "\n"))))
    meta = F.map_filter(F.create_map(F.lit("sha"), "sha", F.lit("author"), "author", F.lit("committed_at"), F.date_format("committed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("parent_sha"), "parent_sha", F.lit("cite_ids"), F.array_join("cite_ids", ",")), lambda k, v: (k != "cite_ids") | (v != ""))
    user = F.concat(F.lit("What changed in commit "), "short_sha", F.lit(" on "), "repo", F.lit(", and why?"))
    return example(commits, user, answer, "commit-summary", "validate", F.col("scope"), F.concat_ws("@", "repo", "short_sha"), TIERS["history"], meta)


def file_snapshots(commits: DataFrame) -> DataFrame:
    s = commits.select("*", F.explode("snapshots").alias("s"))
    closed = lambda c: F.when(c.endswith("\n"), c).otherwise(F.concat(c, F.lit("\n")))
    answer = paragraphs(
        F.concat(F.lit("Status: "), "s.status", F.when(F.coalesce("s.old_path", F.lit("")) != "", F.concat(F.lit(" (from "), "s.old_path", F.lit(")"))).otherwise("")),
        F.concat(F.lit("Content at this commit:\n```\n"), closed(F.col("s.content")), F.lit("```")), F.when(F.coalesce("s.diff_unified", F.lit("")) != "", F.concat(F.lit("Unified diff in this commit:\n```diff\n"), closed(F.col("s.diff_unified")), F.lit("```"))),
        F.concat(F.lit("Commit context: "), "subject"), part("", "body"),
    )
    user = F.concat(F.lit("What does `"), "s.path", F.lit("` in `"), "repo", F.lit("` look like as of commit "), "short_sha", F.lit(", and how did it change?"))
    return example(s, user, answer, "file-snapshot", "domain", F.col("scope"), F.concat(F.concat_ws("@", "repo", "short_sha"), F.lit(":"), F.col("s.path")), TIERS["history"], F.create_map(F.lit("sha"), "sha", F.lit("path"), F.col("s.path"), F.lit("status"), F.col("s.status")))


def history_chunks(commits: DataFrame) -> DataFrame:
    """(chunk_id, family, scope, body): a chunk per commit, and one per file snapshot."""
    top, _ = top_files("files")
    c = commits.select(ids.history_id("commit", F.concat_ws("@", "repo", "sha")).alias("chunk_id"), F.lit("history").alias("family"), "scope", paragraphs(F.col("subject"), part("", "body"), F.array_join(F.transform(top, lambda x: x["path"]), "\n")).alias("body"))
    s = commits.select("repo", "sha", "scope", "subject", F.explode("snapshots").alias("s"))
    s = s.select(ids.history_id("snapshot", F.concat(F.concat_ws("@", "repo", "sha"), F.lit(":"), F.col("s.path"))).alias("chunk_id"), F.lit("code_history").alias("family"), "scope", paragraphs(F.col("s.path"), F.col("subject"), part("", "s.content")).alias("body"))
    return c.unionByName(s)


def pending(commits: DataFrame, cursors: DataFrame, since=None) -> DataFrame:
    """(repo, pending): commits newer than each repository's cursor (repo, sha).

    Where the cursor is unknown, those newer than ``since``, or all of them.  A commit that is listed several
    times is one cursor, at its latest time.
    """
    at = commits.join(cursors.select("repo", "sha").distinct(), ["repo", "sha"]).groupBy("repo").agg(F.max("committed_at").alias("_at"))
    at = commits.join(at, "repo", "left").withColumn("_at", F.coalesce("_at", F.lit(since)))
    return at.where("_at IS NULL OR committed_at > _at").groupBy("repo").agg(F.count("*").alias("pending"))


# ---------------------------------------------------------------- packing


def sanitized(rows: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """``rows`` with banned lines cut from every string leaf, and ``lines_stripped``."""
    strings = [f.name for f in rows.schema if f.dataType.simpleString() == "string"]
    count = F.lit(0)
    for c in strings:
        count = count + F.coalesce(text.stripped_count(c, patterns), F.lit(0))
    count = count + F.aggregate("messages", F.lit(0), lambda a, m: a + text.stripped_count(m["role"], patterns) + text.stripped_count(m["content"], patterns))
    count = count + F.aggregate(F.map_values("metadata"), F.lit(0), lambda a, v: a + F.coalesce(text.stripped_count(v, patterns), F.lit(0)))
    out = rows.withColumn("lines_stripped", count)
    for c in strings:
        out = out.withColumn(c, text.strip_lines(c, patterns))
    out = out.withColumn("messages", F.transform("messages", lambda m: F.struct(text.strip_lines(m["role"], patterns).alias("role"), text.strip_lines(m["content"], patterns).alias("content"))))
    return out.withColumn("metadata", F.transform_values("metadata", lambda k, v: text.strip_lines(v, patterns)))


def sanitized_docs(docs: DataFrame, patterns=text.DOC_ATTRIBUTION) -> DataFrame:
    """(source, text, lines_stripped) of the documents that change: a dry run shows them, a write replaces them."""
    out = docs.select("source", text.strip_lines("text", patterns).alias("text"), text.stripped_count("text", patterns).alias("lines_stripped"))
    return out.where("lines_stripped > 0")


def pack_stats(packed: DataFrame) -> DataFrame:
    return packed.agg(F.count("*").alias("rows"), F.sum("lines_stripped").alias("lines_stripped"), F.count_if(F.col("lines_stripped") > 0).alias("rows_changed"))


#: Registry of sources by kind, in canonical order: a seam for more of them.
KINDS = ("decisions", "antipatterns", "failure_modes", "patterns", "retros", "triples")


def ordered_kinds(kinds: list[str]) -> list[str]:
    """Distinct kinds in canonical order, unknown ones at the end."""
    return sorted(dict.fromkeys(kinds), key=lambda k: (KINDS.index(k) if k in KINDS else len(KINDS), k))
