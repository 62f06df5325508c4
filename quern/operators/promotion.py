"""Verdict surfaces that may block: their state, promotion and demotion, enforcement; freshness of a gate's receipts.

The state is a small JSON file of surfaces.  Whatever can't be read counts as
advisory, so that enforcement never stops a run by itself.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.ledger import HARD_PROCEED

STATE = "surface string, blocking boolean, decision string, receipts array<string>, promoted_at string, demoted_at string, reason string"
FINGERPRINTS = ("suite_id", "git_sha", "suite_sha", "corpus_sha", "repo_sha")


class Refused(ValueError):
    """A promotion or demotion that lacks its ground."""


def load(path: str) -> dict[str, dict]:
    """Surface to its record; empty where the file is missing."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def save(path: str, state: dict[str, dict]) -> None:
    """Write beside, then rename: a reader sees the old file or the new one."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path + ".part", "w", encoding="utf-8") as f:
        json.dump(state, f, indent=1, sort_keys=True)
    os.replace(path + ".part", path)


def _known(surface: str) -> None:
    if surface not in HARD_PROCEED:
        raise Refused(f"{surface} is no surface that can be promoted")


def promote(path: str, surface: str, decision: str, receipts: list[str], now: str) -> None:
    """Let a surface block; needs a decision and two receipts at least."""
    _known(surface)
    if not decision:
        raise Refused("a promotion names its decision")
    if len(receipts) < 2:
        raise Refused(f"a promotion needs two receipts, not {len(receipts)}")
    save(path, load(path) | {surface: {"blocking": True, "decision": decision, "receipts": receipts, "promoted_at": now}})


def demote(path: str, surface: str, reason: str, now: str) -> None:
    """Make a surface advisory again; its record stays, with the reason."""
    _known(surface)
    if not reason:
        raise Refused("a demotion names its reason")
    state = load(path)
    save(path, state | {surface: state.get(surface, {}) | {"blocking": False, "demoted_at": now, "reason": reason}})


def state_frame(spark, path: str) -> DataFrame:
    """The state as a table; an unreadable file gives an empty one."""
    try:
        rows = [{"surface": k, **v} for k, v in load(path).items()]
    except (OSError, ValueError):
        rows = []
    names = [c.split()[0] for c in STATE.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], STATE)


def enforced(verdicts: DataFrame, state: DataFrame) -> DataFrame:
    """``verdicts`` (surface, proceed, ...) with ``status`` and ``blocked``: only a promoted surface's hard value blocks."""
    s = state.select(F.col("surface").alias("_s"), F.coalesce("blocking", F.lit(False)).alias("_b"), F.col("decision").alias("blocked_by"))
    hard = F.lit(False)
    for surface, proceed in HARD_PROCEED.items():
        hard = F.when(F.col("surface") == surface, F.col("proceed") == proceed).otherwise(hard)
    out = verdicts.join(F.broadcast(s), F.col("surface") == F.col("_s"), "left")  # one row a surface
    blocks = F.coalesce(F.col("_b"), F.lit(False))
    out = out.withColumn("status", F.when(blocks, "blocking").otherwise("advisory")).withColumn("blocked", blocks & F.coalesce(hard, F.lit(False)))
    return out.withColumn("blocked_by", F.when(F.col("blocked"), F.col("blocked_by"))).drop("_s", "_b")


def freshness(suites: DataFrame, receipts: DataFrame) -> DataFrame:
    """(suite_id, status, run_id): fresh with a PASS receipt of all five fingerprints, stale without one.

    ``suites``: suite_id, optional and the four hashes.  A suite without a hash has
    no file: it is skipped if optional, else missing.  The newest receipt counts.
    """
    r = receipts.where("verdict = 'PASS'").groupBy(*FINGERPRINTS).agg(F.max_by("run_id", "line_no").alias("run_id"))
    on = [F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}")) for c in FINGERPRINTS]
    test = on[0]
    for x in on[1:]:
        test = test & x
    absent = F.coalesce("s.suite_sha", F.lit("")) == ""
    status = F.when(absent & F.col("s.optional"), "skipped").when(absent, "missing").when(F.col("r.run_id").isNull(), "stale").otherwise("fresh")
    return suites.alias("s").join(r.alias("r"), test, "left").select("s.suite_id", status.alias("status"), F.when(~absent, F.col("r.run_id")).alias("run_id"))


def gate_exit(fresh: DataFrame) -> int:
    """0 if all suites are fresh or skipped, 1 if one is stale, 2 if one is missing."""
    rank = F.when(F.col("status") == "missing", 2).when(F.col("status") == "stale", 1).otherwise(0)
    return fresh.agg(F.coalesce(F.max(rank), F.lit(0))).first()[0]


def override(suites: DataFrame, reason: str, at: str) -> DataFrame:
    """The audit lines of a gate that is passed over: one a suite."""
    if not reason:
        raise Refused("an override names its reason")
    return suites.select("suite_id", F.lit("OVERRIDE").alias("verdict"), F.lit(reason).alias("override_reason"), F.lit(at).alias("ts"), *FINGERPRINTS[1:])
