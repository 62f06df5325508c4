"""Command line: ``python -m quern.cli GROUP COMMAND ...``.

Exit codes: 0 done or passed, 1 a gate failed or a sync was refused, 2 bad usage.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import dims, text
from quern.operators import chunkers, datasets, evalx, graph, ledger, sync, vectors
from quern.plans import index
from quern.session import session
from quern.sources import gitlog, tables, tree

REACTIONS = "turn_id string, ts string, subcommand string, verdict string, reaction string, phase string, label string, note string, unresolved_cites array<string>"
CACHE = "ts string, key_sha string, event string, model string, cache_creation_tokens long, cache_read_tokens long, note string"
CASES = "case_id string, verdict string, blockers int, warnings int, infos int, attempts int, error string"
ROWS = "system string, messages array<struct<role:string,content:string>>, tier int, scope string, source string, role string, family string, metadata map<string,string>"
VECTORS = "id string, family string, scope string, source string, doc string, embedding array<float>"


def show(df: DataFrame, n: int = 1000) -> None:
    for r in df.limit(n).collect():
        print("\t".join("" if v is None else str(v) for v in r))


def corpus(spark, root: str, memory: str | None) -> DataFrame:
    files = tree.knowledge_files(spark, root)
    if memory:
        files = files.unionByName(tree.memory_files(spark, memory))
    return index.build(files)


def corpus_build(spark, a) -> int:
    chunks = corpus(spark, a.root, a.memory)
    tables.write_generation(spark, a.out, chunks, sync.source_rows(chunks), sync.BUILDER_VERSION)
    show(sync.scope_counts(spark.read.parquet(f"{tables.current(spark, a.out)}/chunks")).orderBy("scope_no").drop("scope_no"))
    return 0


def corpus_sync(spark, a) -> int:
    try:
        done = sync.sync(spark, a.out, corpus(spark, a.root, a.memory))
    except sync.SyncRefused as e:
        print(f"refused: {e}", file=sys.stderr)
        return 1
    print(f"added {done.added}, changed {done.changed}, removed {done.removed}")
    return 0


def corpus_status(spark, a) -> int:
    at = tables.current(spark, a.out)
    if at is None:
        print("no manifest", file=sys.stderr)
        return 1
    show(sync.summary(sync.diff(spark.read.parquet(f"{at}/sources"), sync.source_rows(corpus(spark, a.root, a.memory)))))
    return 0


def corpus_index(spark, a) -> int:
    chunks = spark.read.parquet(f"{tables.current(spark, a.out)}/chunks")
    index.vectors(chunks, a.family).write.mode("append" if a.append else "overwrite").partitionBy("family", "scope").parquet(a.vectors)
    show(spark.read.parquet(a.vectors).groupBy("family", "scope").count().orderBy("family", "scope"))
    return 0


def repo_ingest(spark, a) -> int:
    files = tree.repo_files(spark, a.root, a.repo)
    w = chunkers.code_windows(files, keep=("sha",))
    chunks = w.select("chunk_id", F.concat_ws("/", "repo", "path").alias("source"), F.col("sha").alias("source_sha"), dims.repo_scope("repo").alias("scope"), F.lit("code").alias("doc_type"), "body")
    tables.write_generation(spark, a.out, chunks, sync.source_rows(chunks), sync.BUILDER_VERSION)
    print(chunks.count())
    return 0


def history_scan(spark, a) -> int:
    commits = datasets.parsed_commits(gitlog.read_log(spark, gitlog.pairs(a.repos), since=a.since or "")).withColumn("scope", dims.repo_scope("repo"))
    both = datasets.commit_summaries(commits).unionByName(datasets.file_snapshots(commits))
    tables.write_json_by_scope(both, a.out, ["source"])
    return 0


def dataset_pack(spark, a) -> int:
    rows = spark.read.schema(ROWS).option("mode", "FAILFAST").option("recursiveFileLookup", "true").json(a.input)
    packed = datasets.sanitized(rows, (text.line_with(*a.ban),) if a.ban else text.ATTRIBUTION)
    packed.drop("lines_stripped").write.mode("overwrite").json(a.out)
    show(datasets.pack_stats(packed))
    return 0


def retrieve(spark, a) -> int:
    scopes = dims.with_universal(a.scope) if a.scope else None
    q = spark.createDataFrame([("q", scopes, index.HashEmbedder(a.dim)([a.question])[0])], "qid string, scopes array<string>, embedding array<float>")
    hits = vectors.scoped_families(q, spark.read.schema(VECTORS).parquet(a.vectors), a.n)
    show(vectors.with_reserve(hits, a.n).orderBy("rank").select("rank", F.round("distance", 4), "source", text.one_line("doc", 120)))
    return 0


def prompt_check(spark, a) -> int:
    docs = spark.read.text(a.docs, wholetext=True).select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("text"))
    at = tables.current(spark, a.out)
    chunks = spark.read.parquet(f"{at}/chunks")
    files = spark.read.parquet(f"{at}/sources").select("path", F.col("sha").alias("indexed_sha"))
    live = tree.read_tree(spark, a.root, content="false").select("path", F.col("sha").alias("live_sha"))
    found = graph.resolved(graph.document_cites(docs), graph.first_sources(chunks), live.join(files, "path", "left"))
    bad = found.where("status = 'unresolved'").orderBy("doc", "line")
    show(bad.select("doc", "line", "cite"))
    return int(bad.limit(1).count() > 0)


def eval_gate(spark, a) -> int:
    cases = tables.read_json(spark, a.report, CASES)
    base = tables.read_json(spark, a.baseline, CASES) if a.baseline else None
    g = evalx.gate(cases, a.min_clean, a.max_blockers, a.min_first_try, base).first()
    print("PASS" if g["pass"] else "FAIL\n" + "\n".join(g["reasons"]))
    if not g["pass"]:
        show(evalx.gate_cases(cases, base).orderBy("case_id", "why"))
    if not g["pass"] and base is not None:
        show(evalx.diff_table(cases, base).orderBy("case_id"))
    return 0 if g["pass"] else 1


def harvest_run(spark, a) -> int:
    log = tables.json_log(spark, a.reactions, REACTIONS).where("NOT bad")
    turns = tables.read_json(spark, a.turns, "turn_id string, scope array<string>, request string, verdict string, claim string, diff string, cites array<string>")
    sig = ledger.signals(log, turns)
    if sig.count() < a.least:
        print(f"fewer than {a.least} effective signals")
        return 0
    done = tables.read_json(spark, a.cursor, "turn_id string") if a.cursor else None
    show(ledger.proposals(sig, done).orderBy("id").select("id", "label", "request", "evidence"))
    return 0


def cache_status(spark, a) -> int:
    s = ledger.cache_stats(tables.read_json(spark, a.log, CACHE, strict=False)).first().asDict()
    print("\n".join(f"{k}\t{v}" for k, v in s.items()))
    return 0


COMMANDS = {
    ("corpus", "build"): (corpus_build, "root out [memory]"), ("corpus", "sync"): (corpus_sync, "root out [memory]"), ("corpus", "status"): (corpus_status, "root out [memory]"),
    ("corpus", "index"): (corpus_index, "out vectors [family=corpus] [append?]"), ("repo", "ingest"): (repo_ingest, "root repo out"), ("history", "scan"): (history_scan, "repos out [since]"),
    ("dataset", "pack"): (dataset_pack, "input out [ban*]"), ("retrieve", "ask"): (retrieve, "question vectors [scope*] [n#10] [dim#64]"), ("prompt", "check"): (prompt_check, "docs root out"),
    ("eval", "gate"): (eval_gate, "report [baseline] [min-clean#0] [max-blockers#0] [min-first-try~0]"), ("harvest", "run"): (harvest_run, "reactions turns [cursor] [least#15]"), ("cache", "status"): (cache_status, "log"),
}


def parser() -> argparse.ArgumentParser:
    """Each command's arguments: plain ones are required; in brackets options, ``*`` repeatable, ``?`` a flag, ``#`` an int, ``~`` a float."""
    top = argparse.ArgumentParser(prog="quern")
    top.add_argument("--master", default="local[*]")
    groups = top.add_subparsers(required=True)
    made: dict = {}
    for (group, name), (run, spec) in COMMANDS.items():
        if group not in made:
            made[group] = groups.add_parser(group).add_subparsers(required=True)
        p = made[group].add_parser(name)
        p.set_defaults(run=run)
        for arg in spec.split():
            if arg[0] != "[":
                p.add_argument(arg)
                continue
            arg = arg[1:-1]
            if arg.endswith("*"):
                p.add_argument("--" + arg[:-1], action="append", default=[])
            elif arg.endswith("?"):
                p.add_argument("--" + arg[:-1], action="store_true")
            elif "#" in arg or "~" in arg:
                key, _, value = arg.partition("#" if "#" in arg else "~")
                p.add_argument("--" + key, type=int if "#" in arg else float, default=(int if "#" in arg else float)(value))
            else:
                key, _, value = arg.partition("=")
                p.add_argument("--" + key, default=value or None)
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(session(a.master), a)


if __name__ == "__main__":
    sys.exit(main())
