"""Streams into tables: corrections in later runs, replays, what a batch reads; and the order of steps."""

import json
import os
import random

import pytest

from quern.plans import steps
from quern.streaming import ledgers


def save(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def effective(spark, tmp_path):
    log = ledgers.read_log(spark, str(tmp_path / "log"), ledgers.REACTIONS, per_trigger=1)
    at = str(tmp_path / "out")
    ledgers.run_to_end(ledgers.into_table(ledgers.effective_updates(log), f"{at}/table", f"{at}/mark", "update"), spark)
    return {r["turn_id"]: (r["phase"], r["line_no"], r["removed"]) for r in ledgers.latest(spark, f"{at}/table", "turn_id").collect()}


def test_corrections_of_later_runs(spark, tmp_path):
    """Three runs over a growing log; after each, the standing reactions are those of all lines so far."""
    rng = random.Random(8)
    lines, best = [], {}
    before = spark.conf.get(ledgers.PROVIDER, None)
    for run in range(3):
        for part in range(2):
            rows = []
            for _ in range(20):
                r = {"turn_id": rng.choice(["t1", "t2", "t3", "t4", "none", "", None]), "phase": rng.choice(["live", "live", "retro"]), "label": rng.choice(["", "wrong", "retracted"]), "reaction": "accept", "line_no": len(lines) + 1}
                lines.append(r)
                rows.append(r)
                if r["turn_id"] not in (None, "", "none"):
                    best[r["turn_id"]] = max(best.get(r["turn_id"], (False, 0)), (r["phase"] == "retro", r["line_no"]))
            save(tmp_path / "log", f"{run}-{part}.json", rows)
        want = {t: (lines[n - 1]["phase"], n, lines[n - 1]["label"] == "retracted") for t, (_, n) in best.items()}
        assert effective(spark, tmp_path) == want
    assert spark.conf.get(ledgers.PROVIDER, None) == before


def test_replayed_batch_replaces_itself(spark, tmp_path):
    """A batch that was written but not committed is written again: nothing is there twice."""
    save(tmp_path / "log", "a.json", [{"turn_id": "t1", "phase": "live", "label": "", "reaction": "accept", "line_no": 1}])
    first = effective(spark, tmp_path)
    commits = tmp_path / "out" / "mark" / "commits"
    for f in os.listdir(commits):
        os.remove(commits / f)
    assert effective(spark, tmp_path) == first
    assert spark.read.parquet(str(tmp_path / "out" / "table")).count() == 1


def test_appends_read_only_the_partitions_of_their_keys(spark, tmp_path):
    path = str(tmp_path / "table")
    row = lambda n: {"turn_id": f"t{n}", "phase": "live", "label": "", "reaction": "", "line_no": n}
    save(tmp_path / "log", "a.json", [row(n) for n in range(200)] + [row(5)])
    go = lambda mark: ledgers.append_new(ledgers.read_log(spark, str(tmp_path / "log"), ledgers.REACTIONS), path, "turn_id", str(tmp_path / mark)).start().awaitTermination()
    go("m1")
    assert ledgers.appended(spark, path).count() == 200
    # Partitions that the next batch's keys don't fall into may even be unreadable.
    new = ["t3", "t900"]
    buckets = {r[0] for r in spark.createDataFrame([(x,) for x in new], "k string").selectExpr("pmod(xxhash64(k), 64)").collect()}
    for folder in os.listdir(path):
        if folder.startswith("bucket=") and int(folder[7:]) not in buckets:
            for f in os.listdir(f"{path}/{folder}"):
                if f.endswith(".parquet"):
                    with open(f"{path}/{folder}/{f}", "r+b") as x:
                        x.write(b"XXXX")
    save(tmp_path / "log", "b.json", [row(3), row(900)])
    go("m1")
    rows = spark.read.parquet(*[f"{path}/bucket={b}" for b in buckets])
    assert rows.where("turn_id IN ('t3', 't900')").count() == 2


@pytest.mark.parametrize("seed", range(3))
def test_positions_are_those_of_a_queue(spark, seed):
    rng = random.Random(seed)
    plans, rows = {}, []
    for p in range(12):
        names = [f"s{i}" for i in rng.sample(range(25), rng.randint(1, 25))]
        rank = {n: k for k, n in enumerate(rng.sample(names, len(names)))}
        plan = [steps.Step(n, [m for m in names if rank[m] < rank[n] and rng.random() < 0.15]) for n in names]
        plans[str(p)] = {n: i for i, n in enumerate(steps.in_order(plan))}
        rows += [(str(p), i, s.id, s.depends_on) for i, s in enumerate(plan)]
    got = steps.levels(spark.createDataFrame(rows, "plan_id string, step_pos int, step_id string, depends_on array<string>")).collect()
    for p, want in plans.items():
        assert {r["step_id"]: r["position"] for r in got if r["plan_id"] == p} == want


def test_steps_of_a_cycle_stay_out(spark):
    rows = [("p", 0, "a", []), ("p", 1, "b", ["c"]), ("p", 2, "c", ["b"]), ("p", 3, "d", ["b"]), ("p", 4, "e", ["a"])]
    got = steps.levels(spark.createDataFrame(rows, "plan_id string, step_pos int, step_id string, depends_on array<string>")).collect()
    assert sorted((r["step_id"], r["level"], r["position"]) for r in got) == [("a", 0, 0), ("e", 1, 1)]
