"""Documents to chunks: Markdown sections, YAML entries, code windows, sentences.

Line-local work is built-in SQL.  Markdown sections need a fold over lines and
sections (fences, packing, merging), so they run in ``mapInPandas``, one
document at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import dims, ids, text

MAX_BYTES, MIN_BYTES = 1500, 200
WINDOW_LINES, OVERLAP_LINES = 80, 20
# The keys of a catalog entry's id and title, in order.
ID_KEYS = ("id", "rule_id", "term", "AP", "D", "code")
TITLE_KEYS = ("title", "name", "term", "definition")
BLANK = " \t\n\f\r\v"


def size(s: str) -> int:
    return len(s.encode("utf-8", "surrogatepass"))


def scan_lines(body: str) -> list[str]:
    parts = body.split("\n")
    if parts and parts[-1] == "":
        parts.pop()
    return [p[:-1] if p.endswith("\r") else p for p in parts]


# ---------------------------------------------------------------- Markdown


class Section:
    __slots__ = ("body", "heading", "title")

    def __init__(self, title: str, heading: str, body: str = ""):
        self.title, self.heading, self.body = title, heading, body


def split_sections(body: str, level: int, keep_preamble: bool = False) -> tuple[str, list[Section]]:
    """(title, sections) at headings of one level outside fences; text before the first heading goes unless it is kept."""
    mark, title, out, fenced = "#" * level + " ", "", [], False
    name, held = "", [] if keep_preamble else None

    def close():
        if held is not None:
            body = "".join(held)
            if name or body.strip(BLANK):
                out.append(Section(name, name, body))

    for line in scan_lines(body):
        bare = line.strip(BLANK)
        if bare.startswith("```"):
            fenced = not fenced
        elif not fenced and not title and bare.startswith("# "):
            title = bare[2:].strip(BLANK)
            continue
        elif not fenced and bare.startswith(mark):
            close()
            name, held = bare[len(mark) :].strip(BLANK), []
            continue
        if held is not None:
            held.append(line + "\n")
    close()
    return title, out


def paragraphs(body: str) -> list[str]:
    """Blank-line separated paragraphs, each with its line ends; a fence never breaks."""
    out, part, fenced = [], "", False
    for line in scan_lines(body):
        bare = line.strip(BLANK)
        if bare.startswith("```"):
            fenced = not fenced
        elif not fenced and not bare:
            if part:
                out.append(part)
            part = ""
            continue
        part += line + "\n"
    return [*out, part] if part else out


def pack(parts: list[str], most: int = MAX_BYTES) -> list[str]:
    """Paragraphs packed in order into texts of at most ``most`` bytes; one that is longer stands alone."""
    out, held = [], ""
    for p in parts:
        p = p.rstrip("\n") + "\n\n"
        if held and size(held) + size(p) > most:
            out.append(held.rstrip("\n"))
            held = ""
        held += p
    return [*out, held.rstrip("\n")] if held else out


def merge_short(sections: list[Section], least: int = MIN_BYTES) -> list[Section]:
    """A section under ``least`` bytes takes in the next ones until it is long enough."""
    out: list[Section] = []
    for s in sections:
        if out and size(out[-1].body) < least:
            last = out[-1]
            out[-1] = Section(f"{last.title} + {s.title}", f"{last.heading} + {s.heading}", last.body.rstrip("\n") + "\n\n" + s.body)
        else:
            out.append(s)
    return out


def slug(heading: str, index: int) -> str:
    s = "".join("-" if c in " -_" else c for c in heading.lower() if c in " -_" or ("a" <= c <= "z") or ("0" <= c <= "9")).strip("-")
    return s[:80] or f"section-{index}"


def markdown_sections(body: str, keep_preamble: bool = False) -> tuple[str, list[Section]]:
    title, sections = split_sections(body, 2, keep_preamble)
    if not sections:
        sections = [Section(title, "", body)]
        sections[0].heading = title
    pieces: list[Section] = []
    for s in sections:
        if size(s.body) <= MAX_BYTES:
            pieces.append(s)
            continue
        _, subs = split_sections(s.body, 3, keep_preamble)
        if len(subs) <= 1:
            pieces += [Section(s.title, s.heading, p) for p in pack(paragraphs(s.body))]
            continue
        for sub in subs:
            name, head = f"{s.title} > {sub.title}", f"{s.heading} > {sub.heading}"
            pieces += [Section(name, head, p) for p in ([sub.body] if size(sub.body) <= MAX_BYTES else pack(paragraphs(sub.body)))]
    return title, merge_short(pieces)


CHUNK = "source string, source_sha string, scope string, doc_type string, seq int, source_anchor string, title string, section string, artifact_id string, severity string, status string, body string"


def markdown_chunks(files: DataFrame, keep_preamble: bool = False) -> DataFrame:
    """Chunks of Markdown ``files`` (source, source_sha, scope, doc_type, text), with ids and outbound cites."""

    def split(frames):
        for pdf in frames:
            rows = []
            for f in pdf.itertuples(index=False):
                title, sections = markdown_sections(f.text or "", keep_preamble)
                for i, s in enumerate(sections):
                    head = f"[{f.doc_type}] {title}" + (f" > {s.title}" if s.title else "")
                    rows.append((f.source, f.source_sha, f.scope, f.doc_type, i, f"{f.source}#{slug(s.heading, i)}", s.title, s.heading, None, None, None, head + "\n\n" + s.body.strip(BLANK)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNK.split(", ")])

    return with_ids(files.select("source", "source_sha", "scope", "doc_type", "text").mapInPandas(split, CHUNK))


def parsed_yaml(raw: str):
    """A YAML text with all scalars as strings, by libyaml where it is there."""
    import yaml

    return yaml.load(raw, Loader=getattr(yaml, "CBaseLoader", yaml.BaseLoader))


def yaml_entries(raw: str) -> list[dict]:
    """The entries of a catalog: a top-level list, or all lists of a top-level map.  Scalars stay strings."""
    top = parsed_yaml(raw)
    if isinstance(top, list):
        return top
    if isinstance(top, dict):
        return [e for v in top.values() if isinstance(v, list) for e in v]
    return []


def yaml_chunks(files: DataFrame) -> DataFrame:
    """One chunk per catalog entry; a file that isn't YAML gives none."""

    def split(frames):
        import yaml

        for pdf in frames:
            rows = []
            for f in pdf.itertuples(index=False):
                try:
                    entries = yaml_entries(f.text or "")
                except yaml.YAMLError:
                    continue
                for i, e in enumerate(entries):
                    get = (lambda *keys, e=e: next((e[k] for k in keys if isinstance(e.get(k), str)), "")) if isinstance(e, dict) else lambda *keys: ""
                    artifact = get(*ID_KEYS)
                    body = yaml.safe_dump(e, sort_keys=True, allow_unicode=True, default_flow_style=False, width=10**9).rstrip("\n")
                    anchor = f"{f.source}#{artifact or f'item-{i}'}"
                    rows.append((f.source, f.source_sha, f.scope, f.doc_type, i, anchor, get(*TITLE_KEYS), None, artifact or None, get("severity").upper() or None, get("status").upper() or None, body))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNK.split(", ")])

    return with_ids(files.select("source", "source_sha", "scope", "doc_type", "text").mapInPandas(split, CHUNK))


def with_ids(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_id", ids.chunk_id("source", "source_anchor", "body")).withColumn("cites_outbound", text.cites("body"))


def chunk_files(files: DataFrame) -> DataFrame:
    """Markdown and structured YAML of ``files`` as chunks; other YAML gives none but stays a source."""
    ext = dims.extension("source")
    catalog = (ext == ".yaml") & F.col("source").rlike(r"(?:\A|/)(?:decisions|anti-patterns|standards|dictionary|patterns|eval)/")
    return markdown_chunks(files.where(ext == ".md")).unionByName(yaml_chunks(files.where(catalog)))


# ---------------------------------------------------------------- the same steps in SQL


def heading_sections(docs: DataFrame, key: str = "doc_id", level: int = 2) -> DataFrame:
    """(key, section, heading, body): sections by line windows; built-in SQL only.

    ``section`` numbers the headings outside fences from 1; lines before the first belong to none.
    """
    mark = "#" * level + " "
    d = docs.select(key, F.posexplode(text.lines_of("text")).alias("line", "raw"))
    w = Window.partitionBy(key).orderBy("line")
    bare = text.trim_space("raw")
    d = d.withColumn("fence", bare.startswith("```")).withColumn("inside", F.sum(F.col("fence").cast("int")).over(w) % 2 == 1)
    d = d.withColumn("head", ~F.col("fence") & ~F.col("inside") & bare.startswith(mark))
    d = d.withColumn("section", F.sum(F.col("head").cast("int")).over(w))
    named = F.max(F.when(F.col("head"), text.trim_space(F.expr(f"substring({'raw'}, instr(raw, '{mark}') + {len(mark)})"))))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line", "raw")))), lambda x: x["raw"]), "\n")
    return d.where("section > 0").groupBy(key, "section").agg(named.alias("heading"), body.alias("body"))


def code_windows(files: DataFrame, lines: int = WINDOW_LINES, overlap: int = OVERLAP_LINES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Windows of ``files`` (repo, path, language, text): (repo, path, start, end, anchor, body, chunk_id).

    Windows begin every ``lines - overlap`` lines; the last one ends with the file.  An empty file has none.
    """
    step = lines - overlap
    d = files.select("repo", "path", "language", *keep, text.lines_of("text").alias("ls")).withColumn("n", F.size("ls")).where("n > 0")
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - lines) / step)).cast("int")
    d = d.withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    start, end = F.col("k") * step + 1, F.least(F.col("k") * step + lines, F.col("n"))
    d = d.select("repo", "path", "language", *keep, start.alias("start"), end.alias("end"), F.slice("ls", start, end - start + 1).alias("part"))
    source = F.concat_ws("/", "repo", "path")
    d = d.withColumn("anchor", F.concat(source, F.lit("#L"), F.col("start").cast("string"), F.lit("-L"), F.col("end").cast("string")))
    d = d.withColumn("body", F.concat(F.lit("[code/"), F.col("language"), F.lit("] "), F.col("anchor"), F.lit("\n"), F.array_join("part", "\n"), F.lit("\n")))
    return d.withColumn("chunk_id", ids.chunk_id(source, "anchor", "body")).drop("part")


# Inline marks of Markdown, and what stays of them.
INLINE = (
    (rf"\A{text.SPACE}*[-*+]{text.SPACE}+", ""), (rf"\A{text.SPACE}*[0-9]+\.{text.SPACE}+", ""), (r"<[^>]+>", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"`[^`]+`", ""), (r"\*+([^*]+)\*+", "$1"),
)


#: A line without any of these is left as it is by all patterns of ``INLINE``.
INLINE_SIGN = rf"[<\[`*]|\A{text.SPACE}*(?:[-+]|[0-9])"


def strip_inline(c) -> Column:
    """A Markdown line without bullets, tags, link targets, code spans and emphasis."""
    out = text.col(c)
    for pattern, to in INLINE:
        out = F.regexp_replace(out, "(?d)" + pattern, to)
    return text.trim_space(F.when(text.col(c).rlike(INLINE_SIGN), out).otherwise(text.col(c)))


def split_sentences(c) -> Column:
    return F.split(text.col(c), rf"(?<=[.!?]){text.SPACE}+")


def meaningful(c) -> Column:
    """Long enough for a sentence: 20 bytes, a blank and an ASCII letter."""
    c = text.col(c)
    return (F.octet_length(c) >= 20) & c.contains(" ") & c.rlike("[A-Za-z]")


def _between(lines, cuts) -> Column:
    """The runs of ``lines`` before, between and after the positions ``cuts``: array of (at, ls), ``at`` from 0."""
    n = F.size(cuts)
    start = lambda k: F.when(k == 0, 0).otherwise(F.get(cuts, k - 1) + 1)
    end = lambda k: F.coalesce(F.get(cuts, k), F.size(lines))
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(start(k).alias("at"), F.slice(lines, start(k) + 1, end(k) - start(k)).alias("ls")))


def _places(lines, test: Callable[[Column], Column]) -> Column:
    """The positions from 0 of the lines that meet ``test``."""
    return F.array_compact(F.transform(lines, lambda x, i: F.when(test(x), i)))


def sentence_lists(docs: DataFrame, key: str = "source", dealt: bool = False) -> DataFrame:
    """(key, found): the sentences of each row of ``docs`` (key, text) in order, as an array of (line, pos, text).

    Every row is a document of its own and is read in place: runs of lines outside fences, in them paragraphs, in
    these sentences.  Rows are dealt out by key first, unless they are ``dealt`` already: a file of few row groups would
    give few tasks.
    """
    fence = lambda x: text.trim_space(x).startswith("```")
    skip = lambda x: text.bound(text.trim_space(x), lambda b: (b == "") | b.rlike(r"\A(?:#|>|\||---|===|<!--)"))
    d = docs.where(F.octet_length("text") > 0).select(key, "text")
    d = d if dealt else d.repartition(F.xxhash64(key))
    d = d.select(key, text.lines_of("text").alias("ls"), F.contains("text", F.lit("```")).alias("fenced"))
    d = d.withColumn("fences", F.when(F.col("fenced"), _places(F.col("ls"), fence)).otherwise(F.array().cast("array<int>")))
    # Fences open and close by turns, so every other run is outside; an open one reaches to the end.
    d = d.select(key, F.filter(_between(F.col("ls"), F.col("fences")), lambda r, i: i % 2 == 0).alias("runs"))
    inner = lambda r, p: F.struct((r["at"] + p["at"]).alias("at"), p["ls"].alias("ls"))
    cut = lambda r: text.bound(_places(r["ls"], skip), lambda c: F.transform(_between(r["ls"], c), lambda p: inner(r, p)))
    d = d.select(key, F.filter(F.flatten(F.transform("runs", cut)), lambda p: F.size(p["ls"]) > 0).alias("paras"))
    d = d.select(key, F.transform("paras", lambda p: F.struct(p["at"].alias("at"), F.transform(p["ls"], strip_inline).alias("ls"))).alias("paras"))
    some = lambda p: F.filter(p["ls"], lambda x: x != "")
    first = lambda p: p["at"] + F.get(_places(p["ls"], lambda x: x != ""), F.lit(0)) + 1
    d = d.select(key, F.transform("paras", lambda p: F.struct(first(p).alias("line"), F.transform(split_sentences(F.array_join(some(p), " ")), text.trim_space).alias("ss"))).alias("paras"))
    placed = lambda p: F.filter(F.transform(p["ss"], lambda x, i: F.struct(p["line"].alias("line"), i.alias("pos"), x.alias("text"))), lambda s: meaningful(s["text"]))
    return d.select(key, F.flatten(F.transform("paras", placed)).alias("found"))


def sentences(docs: DataFrame, key: str = "source") -> DataFrame:
    """(key, line, pos, text): sentences of Markdown ``docs`` (key, text), with the line where their paragraph begins.

    Fenced code, headings, quotes, tables, rules and comments break paragraphs and are left out.
    """
    # The outer form, as for the inner one the planner adds a filter by size, which it computes all lists for once more.
    return sentence_lists(docs, key).select(key, F.inline_outer("found")).where("text IS NOT NULL")


# ---------------------------------------------------------------- folds over arrays, for DataFrame callers


def fold(f: Callable[[list[str]], list[str]]):
    """A pandas UDF that applies an order-dependent fold to an array column."""

    from pyspark.sql.types import ArrayType, StringType

    @F.pandas_udf(ArrayType(StringType()))
    def run(parts: pd.Series) -> pd.Series:
        return parts.map(lambda x: f(list(x)) if x is not None else None)

    return run


HEADING_AT_START = re.compile(r"(#{1,6}) ")


def dataset_sections(body: str, level: int) -> list[tuple[str, str]]:
    """(title, body) at headings of ``level`` that stand at column 0; fence lines stay in the body."""
    out, fenced, mark = [], False, "#" * level + " "
    for line in scan_lines(body):
        if line.strip(BLANK).startswith("```"):
            fenced = not fenced
        elif not fenced and line.startswith(mark):
            out.append([line[len(mark) :].strip(BLANK), ""])
            continue
        if out:
            out[-1][1] += line + "\n"
    return [(t, b) for t, b in out]
