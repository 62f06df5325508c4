"""Model calls over tables: batch classification, checked generation with one retry, paraphrases.

A model is any callable from a list of prompts to a list of answers (or one that
raises).  It runs inside Arrow batches on the executors; how many calls run at
once is the number of partitions.  Nothing here retries across batches: rows that
failed come out with their failure, and a rerun picks up those that have no
answer yet.  :func:`generate` writes wave by wave, so that what is lost with an
executor or a driver is at most a wave.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text
from quern.shared import table_at

log = logging.getLogger(__name__)

Model = Callable[[list[str]], list[str]]
BATCH = 100
FAILURES = ("call", "parse", "empty", "identical", "length")
LEDGERS = "anchor_id string, anchor string, positive string, attempts int, failure string, failed boolean"
#: Anchors of a wave, and calls at once.
WAVE, CALLS = 10_000, 8


def stub(prompts: list[str]) -> list[str]:
    """An offline model: gives every prompt back as a JSON answer, in upper case."""
    return [json.dumps({"answer": p.upper()}) for p in prompts]


def classify(items: DataFrame, model: Model, key: str = "id", batch: int = BATCH) -> DataFrame:
    """(key, semantic_role, concerns) for the rows without a role yet; ids that the model makes up, and rows that it skips, are left out."""

    def run(frames):
        for pdf in frames:
            rows = []
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                known = set(part[key])
                prompt = json.dumps([{"id": k, "text": t} for k, t in zip(part[key], part["text"], strict=True)])
                try:
                    got = json.loads(model([prompt])[0])
                except Exception:  # the batch stays unclassified and is picked up by the next run
                    continue
                rows += [(x["id"], x.get("role"), [c for c in x.get("concerns") or [] if isinstance(c, str)]) for x in got if isinstance(x, dict) and x.get("id") in known and x.get("role")]
            yield pd.DataFrame(rows, columns=[key, "semantic_role", "concerns"])

    todo = items.where("semantic_role IS NULL").select(F.col(key).cast("string").alias(key), "text")
    return todo.mapInPandas(run, f"{key} string, semantic_role string, concerns array<string>")


def merged(items: DataFrame, tags: DataFrame, key: str = "id") -> DataFrame:
    """``items`` with new roles, and concerns united without repeats."""
    t = tags.select(F.col(key).alias("_k"), F.col("semantic_role").alias("_r"), F.col("concerns").alias("_c"))
    none = F.array().cast("array<string>")
    out = items.join(t, items[key] == F.col("_k"), "left")
    return out.withColumn("semantic_role", F.coalesce("semantic_role", "_r")).withColumn("concern", F.array_union(F.coalesce("concern", none), F.coalesce("_c", none))).drop("_k", "_r", "_c")


def checked(requests: DataFrame, model: Model, problems: Callable[[str], list[str]], tries: int = 2) -> DataFrame:
    """(case_id, raw, attempts, problems): an answer with problems is asked for again with them listed, up to ``tries`` times."""

    def run(frames):
        for pdf in frames:
            rows = []
            for case, prompt in zip(pdf["case_id"], pdf["prompt"], strict=True):
                ask, raw, bad, n = prompt, None, ["no answer"], 0
                for n in range(1, tries + 1):
                    try:
                        raw = model([ask])[0]
                    except Exception as e:
                        raw, bad = None, [f"call failed: {e}"]
                        continue
                    bad = problems(raw)
                    if not bad:
                        break
                    ask = prompt + "\n\nThe last answer had these problems:\n" + "\n".join(f"- {b}" for b in bad)
                rows.append((case, raw, n, bad))
            yield pd.DataFrame(rows, columns=["case_id", "raw", "attempts", "problems"])

    return requests.select(F.col("case_id").cast("string").alias("case_id"), "prompt").mapInPandas(run, "case_id string, raw string, attempts int, problems array<string>")


def paraphrases(triples: DataFrame, model: Model, done: DataFrame | None = None, tries: int = 2) -> DataFrame:
    """(anchor_id, anchor, positive, attempts, failure) of triples whose anchor isn't in ``done``.

    ``failure`` is null or one of :data:`FAILURES`; callers write the two kinds to two sinks.
    """
    if done is not None:
        triples = triples.join(done.select("anchor_id"), "anchor_id", "left_anti")

    def once(anchor: str) -> tuple[str | None, str | None]:
        try:
            raw = model([anchor])[0]
        except Exception:
            return None, "call"
        try:
            answer = json.loads(raw)["answer"]
        except (ValueError, KeyError, TypeError):
            return None, "parse"
        if not isinstance(answer, str) or not answer.strip():
            return None, "empty"
        if answer.strip() == anchor.strip():
            return None, "identical"
        return (answer, None) if 0.3 <= len(answer) / max(1, len(anchor)) <= 3 else (None, "length")

    def run(frames):
        for pdf in frames:
            rows = []
            for key, anchor in zip(pdf["anchor_id"], pdf["anchor"], strict=True):
                for n in range(1, tries + 1):
                    answer, failure = once(anchor or "")
                    if failure is None:
                        break
                rows.append((key, anchor, answer, n, failure))
            yield pd.DataFrame(rows, columns=["anchor_id", "anchor", "positive", "attempts", "failure"])

    return triples.select(F.col("anchor_id").cast("string").alias("anchor_id"), "anchor").mapInPandas(run, "anchor_id string, anchor string, positive string, attempts int, failure string")


def generate(spark: SparkSession, triples: DataFrame, model: Model, root: str, wave: int = WAVE, calls: int = CALLS, tries: int = 2) -> int:
    """Ask for the positives of ``triples`` (anchor_id, anchor) that have none below ``root``; how many were asked for.

    Answers and failures go to two ledgers below ``root`` (partitions ``failed``),
    which each wave appends to before the next begins.  A rerun asks for what has
    no answer, so also for what failed.  ``wave`` anchors are one job, of which at
    most ``calls`` tasks call the model, each one call at a time.  Repeated anchors
    are asked for once.  What is to be asked for is found once and dealt to waves
    below ``root/_todo``, which each run overwrites, so a wave reads its own rows only.
    """
    done = table_at(spark, root, LEDGERS)  # as it stands now: later waves don't show
    todo = triples.select(F.col("anchor_id").cast("string").alias("anchor_id"), "anchor").where("anchor_id IS NOT NULL").dropDuplicates(["anchor_id"])
    if done is not None:
        todo = todo.join(done.where("NOT failed").select("anchor_id"), "anchor_id", "left_anti")
    n = todo.count()
    waves = -(-n // wave)
    if waves:
        todo = todo.withColumn("wave", F.pmod(F.xxhash64("anchor_id"), F.lit(waves)).cast("int"))
        todo.repartition("wave").write.partitionBy("wave").mode("overwrite").parquet(f"{root}/_todo")
    for i in range(waves):
        part = table_at(spark, f"{root}/_todo/wave={i}", "anchor_id string, anchor string")
        if part is not None:  # no anchor may fall to a wave
            out = paraphrases(part.repartition(calls), model, tries=tries).withColumn("failed", F.col("failure").isNotNull())
            out.write.partitionBy("failed").mode("append").parquet(root)
        log.info("%s: wave %d of %d written", root, i + 1, waves)
    return n


def ledgers(spark: SparkSession, root: str) -> DataFrame:
    """The answers and failures below ``root``, told apart by ``failed``."""
    return spark.read.schema(LEDGERS).parquet(root)


def failures_by_kind(pairs: DataFrame) -> DataFrame:
    """(kind, n): how many anchors that have no answer yet failed in which way, for every kind; an anchor counts once for each."""
    kinds = pairs.sparkSession.createDataFrame([(k,) for k in FAILURES], "kind string")
    answered = pairs.where("failure IS NULL").select("anchor_id")
    open_ = pairs.where("failure IS NOT NULL").join(answered, "anchor_id", "left_anti").select("anchor_id", F.col("failure").alias("kind")).distinct()
    return F.broadcast(kinds).join(open_.groupBy("kind").agg(F.count("*").alias("c")), "kind", "left").select("kind", F.coalesce("c", F.lit(0)).alias("n"))


def generation_stats(pairs: DataFrame) -> DataFrame:
    """One row: answers, failures, mean length ratio, and how many anchors with artifact ids kept one."""
    ok = F.col("failure").isNull()
    ids = F.size(text.cites("anchor")) > 0
    kept = F.arrays_overlap(text.cites("anchor"), text.cites("positive"))
    return pairs.agg(
        F.count_if(ok).alias("answers"), F.count_if(~ok).alias("failures"), F.avg(F.when(ok, F.length("positive") / F.greatest(F.length("anchor"), F.lit(1)))).alias("length_ratio"),
        F.count_if(ok & ids).alias("with_ids"), F.count_if(ok & ids & kept).alias("ids_kept"),
    )
