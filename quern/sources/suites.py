"""Suites and reports with their checks; recall inputs and remote recall; diffs; small state files."""

from __future__ import annotations

import json
import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUITE = "suite_id string, case_id string, scope array<string>, request string, claim string, diff string"
RECALL = "qid string, scope string, text string, expected_source string"
HITS = "array<struct<query_id:string,hits:array<struct<sentence_id:string,source:string,score:double>>>>"
# The lines between which a remote run prints its result.
BEGIN, END = "===RECALL_JSON===", "===END_RECALL_JSON==="


class BadSuite(ValueError):
    """A suite that can't be run as it stands."""


def _yaml(path: str):
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.load(f, Loader=yaml.BaseLoader)


def _checked(rows: list[dict], needed: tuple[str, ...], what: str) -> list[dict]:
    """The rows, if there are some, each has what is needed, and ids differ."""
    if not rows:
        raise BadSuite(f"{what} is empty")
    seen = set()
    for i, r in enumerate(rows, 1):
        missing = [k for k in needed if not r.get(k)]
        if missing:
            raise BadSuite(f"{what}: entry {i} lacks {', '.join(missing)}")
        if r["id"] in seen:
            raise BadSuite(f"{what}: {r['id']} comes twice")
        seen.add(r["id"])
    return rows


def suite(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a suite file: it needs a name, cases, and distinct ids."""
    top = _yaml(path) or {}
    if not top.get("suite_id"):
        raise BadSuite("a suite names itself")
    rows = _checked(top.get("cases") or [], ("id",), path)
    return spark.createDataFrame([(top["suite_id"], r["id"], list(r.get("scope") or []), r.get("request"), r.get("claim"), r.get("diff")) for r in rows], SUITE)


def recall_suite(spark: SparkSession, path: str) -> DataFrame:
    """The queries of a recall suite: each has an id of its own, a text and an expected source."""
    rows = _checked((_yaml(path) or {}).get("queries") or [], ("id", "text", "expected_source"), path)
    return spark.createDataFrame([(r["id"], r.get("scope"), r["text"], r["expected_source"]) for r in rows], RECALL)


def report(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The cases of a run's report; a missing or broken file is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{folder}/report.json")


def write_recall_inputs(sentences: DataFrame, queries: DataFrame, folder: str) -> None:
    """What a remote ranking reads: sentences (id, text, source) and queries (id, text) as JSON lines."""
    sentences.select("id", "text", "source").write.mode("overwrite").json(f"{folder}/sentences")
    queries.select(F.col("qid").alias("id"), "text").write.mode("overwrite").json(f"{folder}/queries")


def remote_hits(spark: SparkSession, printed: str) -> DataFrame:
    """(qid, rank, id, source, score) from the output of a remote run, between its marks."""
    if BEGIN not in printed or END not in printed.split(BEGIN, 1)[1]:
        raise BadSuite("the output holds no result")
    body = printed.split(BEGIN, 1)[1].split(END, 1)[0]
    try:
        queries = json.loads(body)["queries"]
    except (ValueError, KeyError, TypeError) as e:
        raise BadSuite("the result is no JSON") from e
    one = spark.createDataFrame([(json.dumps(queries),)], "raw string").select(F.explode(F.from_json("raw", HITS)).alias("q"))
    return one.select(F.col("q.query_id").alias("qid"), F.posexplode_outer("q.hits").alias("rank", "h")).select("qid", (F.col("rank") + 1).alias("rank"), F.col("h.sentence_id").alias("id"), F.col("h.source").alias("source"), F.col("h.score").alias("score"))


def complete(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """``hits`` of the ``queries``; a query without an answer is an error, answers to other questions are dropped."""
    lost = [r["qid"] for r in queries.join(hits.select("qid").distinct(), "qid", "left_anti").select("qid").orderBy("qid").limit(5).collect()]
    if lost:
        raise BadSuite(f"no answer for {', '.join(map(str, lost))}")
    return hits.join(queries.select("qid"), "qid", "left_semi")


def diff_of(ref: str, folder: str) -> str:
    """A diff: a file's content, else the changes since a commit, else those of a commit."""
    if os.path.isfile(ref):
        with open(ref, encoding="utf-8", errors="replace") as f:
            return f.read()
    for command in (["diff", ref], ["show", "--format=", ref]):
        done = subprocess.run(["git", "-C", folder, *command, "--"], capture_output=True, text=True, errors="replace", check=False)
        if done.returncode == 0 and done.stdout:
            return done.stdout
    raise BadSuite(f"{ref} names no file and no commit with changes")


def instruction_files(spark: SparkSession, roots: list[str], name: str) -> DataFrame:
    """(repo, source, text): one file of a fixed name from each repository that has it."""
    found = [(os.path.basename(r.rstrip("/")), os.path.join(r, name)) for r in roots if os.path.isfile(os.path.join(r, name))]
    if not found:
        return spark.createDataFrame([], "repo string, source string, text string")
    text = spark.read.text([p for _, p in found], wholetext=True).select(F.regexp_replace(F.col("_metadata.file_path"), r"\Afile:/+", "/").alias("path"), F.col("value").alias("text"))
    return text.join(F.broadcast(spark.createDataFrame(found, "repo string, path string")), "path").select("repo", F.concat_ws("/", "repo", F.lit(name)).alias("source"), "text")


def save_state(path: str, state: dict) -> None:
    """A cursor or manifest as JSON, written beside and renamed."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path + ".part", "w", encoding="utf-8") as f:
        json.dump(state, f, indent=1, sort_keys=True)
    os.replace(path + ".part", path)


def load_state(path: str) -> dict:
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)
