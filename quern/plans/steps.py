"""Step plans: dependency graph, validation, splitting, statistics; and a small driver-side runner."""

from __future__ import annotations

import json
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_STEPS = 25
MAX_BACKOFF = 30.0


@dataclass
class Step:
    id: str
    depends_on: list[str] = field(default_factory=list)
    executor: str = "local"
    prompt: str = ""
    max_attempts: int = 1
    backoff: float = 0.0


class Executor(Protocol):
    def execute(self, step: Step, inputs: dict[str, str]) -> str: ...


def problems(steps: list[Step], executors: set[str] | None = None) -> list[str]:
    """What makes a plan invalid: repeated ids, unknown dependencies, cycles, unknown executors, no or too many steps."""
    names = [s.id for s in steps]
    out = [f"step {n} is defined twice" for n in sorted({n for n in names if names.count(n) > 1})]
    out += [f"step {s.id} depends on unknown {d}" for s in steps for d in s.depends_on if d not in names]
    out += [f"step {s.id} has unknown executor {s.executor}" for s in steps if executors is not None and s.executor not in executors]
    if not steps:
        out.append("a plan needs a step")
    if not out:
        try:
            in_order(steps)
        except ValueError as e:
            out.append(str(e))
    return out


def in_order(steps: list[Step]) -> list[str]:
    """Topological order: among ready steps, the one that became ready first, in plan order."""
    left = {s.id: len(set(s.depends_on)) for s in steps}
    ready = deque(s.id for s in steps if not left[s.id])
    out = []
    while ready:
        done = ready.popleft()
        out.append(done)
        for s in steps:
            if done in s.depends_on:
                left[s.id] -= 1
                if not left[s.id]:
                    ready.append(s.id)
    if len(out) < len(steps):
        raise ValueError("the plan has a cycle")
    return out


def run(steps: list[Step], executors: dict[str, Executor], seed: dict[str, str] | None = None, sleep: Callable[[float], None] = time.sleep) -> list[dict]:
    """Results in order; a step is tried up to ``max_attempts`` times with doubling pauses of at most 30 s, and skipped after a failed one it needs."""
    done, out = dict(seed or {}), []
    by = {s.id: s for s in steps}
    for name in in_order(steps):
        s = by[name]
        if any(d not in done for d in s.depends_on):
            out.append({"step_id": name, "status": "skipped", "attempts": 0, "output": None})
            continue
        for attempt in range(1, s.max_attempts + 1):
            try:
                done[name] = executors[s.executor].execute(s, {d: done[d] for d in s.depends_on})
                out.append({"step_id": name, "status": "ok", "attempts": attempt, "output": done[name]})
                break
            except Exception as e:  # a step may fail in any way; the plan goes on
                if attempt == s.max_attempts:
                    out.append({"step_id": name, "status": "failed", "attempts": attempt, "output": str(e)})
                elif s.backoff:
                    sleep(min(MAX_BACKOFF, s.backoff * 2 ** (attempt - 1)))
    return out


def from_json(raw: str, executors: set[str] | None = None) -> list[Step]:
    """A plan from a model's JSON answer: steps with id, prompt and dependencies; what makes it invalid is raised, all of it at once."""
    try:
        top = json.loads(raw)
        rows = top["steps"] if isinstance(top, dict) else top
        made = [Step(str(r["id"]), [str(x) for x in r.get("depends_on") or []], r.get("executor") or "local", r.get("prompt") or "", int(r.get("max_attempts") or 1)) for r in rows]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError(f"no plan: {e}") from e
    if bad := problems(made, executors):
        raise ValueError("; ".join(bad))
    return made


def expected_schema(example) -> dict:
    """The JSON schema that an example of an answer stands for: its keys are required, and values have its types."""
    if isinstance(example, dict):
        return {"type": "object", "required": sorted(example), "properties": {k: expected_schema(v) for k, v in example.items()}}
    if isinstance(example, list):
        return {"type": "array", "items": expected_schema(example[0])} if example else {"type": "array"}
    kinds = {bool: "boolean", int: "integer", float: "number", str: "string"}
    return {"type": kinds[type(example)]} if type(example) in kinds else {}


def split(steps: DataFrame, most: int = MAX_STEPS) -> DataFrame:
    """``steps`` (plan_id, step_pos from 0, ...) with ``part`` and ``part_id``, and ``seeded_from``, the part before."""
    part = F.floor(F.col("step_pos") / most).cast("int")
    name = lambda p: F.concat("plan_id", F.lit("-part-"), (p + 1).cast("string"))
    return steps.withColumn("part", part).withColumn("part_id", name(F.col("part"))).withColumn("seeded_from", F.when(F.col("part") > 0, name(F.col("part") - 1)))


def levels(steps: DataFrame) -> DataFrame:
    """(plan_id, step_id, level, position): the longest dependency chain before each step, and its place, from 0, in the order of running.

    ``steps``: plan_id, step_id, depends_on, and step_pos, without which steps stand by their ids.  Of the steps that are ready
    the one runs first that became ready first, those of one moment by
    ``step_pos``; so steps run level by level, inside a level by the place of the
    dependency that ran last.  Steps on or behind a cycle stay out.

    A plan has at most ``MAX_STEPS`` steps (a longer one is an error: :func:`split` it
    first), so each one is folded in one SQL expression: a round a level hands its
    steps their dependencies' places.
    """
    steps = steps.join(steps.groupBy("plan_id").agg(F.count("*").alias("_n")), "plan_id")
    too_long = F.raise_error(F.concat(F.lit("a plan has more steps than "), F.lit(str(MAX_STEPS)), F.lit(": "), F.col("plan_id").cast("string")))
    steps = steps.withColumn("plan_id", F.when(F.col("_n") > MAX_STEPS, too_long.cast(steps.schema["plan_id"].dataType)).otherwise(F.col("plan_id")))
    pos = F.col("step_pos").cast("long") if "step_pos" in steps.columns else F.lit(0).cast("long")
    one = F.struct(pos.alias("pos"), "step_id", F.array_distinct("depends_on").alias("deps"))
    s = steps.groupBy("plan_id").agg(F.array_sort(F.collect_list(one)).alias("steps"))
    known = "map<string,struct<level:int,position:int>>"
    ready = lambda acc, x: ~F.map_contains_key(acc, x["step_id"]) & F.forall(x["deps"], lambda d: F.map_contains_key(acc, d))
    last = lambda acc, x: F.coalesce(F.array_max(F.transform(x["deps"], lambda d: F.element_at(acc, d)["position"])), F.lit(-1))
    # Those ready now, by their last dependency's place, then their own in the plan.
    found = lambda acc: F.array_sort(F.transform(F.filter(F.col("steps"), lambda x: ready(acc, x)), lambda x: F.struct(last(acc, x).alias("last"), x["pos"].alias("pos"), x["step_id"].alias("step_id"))))
    placed = lambda acc, i: F.transform(found(acc), lambda x, k: F.struct(x["step_id"], F.struct((i - 1).cast("int").alias("level"), (F.size(acc) + k).cast("int").alias("position"))))
    add = lambda acc, i: F.map_concat(acc, F.map_from_entries(placed(acc, i))).cast(known)
    folded = F.aggregate(F.sequence(F.lit(1), F.size("steps")), F.create_map().cast(known), add)
    return s.select("plan_id", F.explode(folded).alias("step_id", "x")).select("plan_id", "step_id", "x.level", "x.position")


def aggregate(results: DataFrame) -> DataFrame:
    """Per plan: steps, attempts, first-try rate, peak context, token sums."""
    return results.groupBy("plan_id").agg(
        F.count("*").alias("steps"), F.sum("attempts").alias("attempts"), F.avg((F.col("attempts") == 1).cast("int")).alias("first_try_rate"), F.max("context_tokens").alias("peak_context"), F.sum("output_tokens").alias("output_tokens")
    )
