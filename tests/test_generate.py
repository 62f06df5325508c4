import json
import os

import pytest

from quern.plans import generate


def test_classify_resumes_and_merges(spark):
    def model(prompts):
        rows = json.loads(prompts[0])
        if any(r["text"] == "bad" for r in rows):
            raise RuntimeError
        return [json.dumps([{"id": r["id"], "role": "rule", "concerns": ["ui", "ui2"]} for r in rows if r["text"] != "skip"] + [{"id": "made up", "role": "x"}])]

    items = spark.createDataFrame([("1", "a", None, ["ui"]), ("2", "skip", None, None), ("3", "c", "old", [])], "id string, text string, semantic_role string, concern array<string>").coalesce(1)
    tags = generate.classify(items, model)
    assert [(r["id"], r["semantic_role"]) for r in tags.collect()] == [("1", "rule")]
    got = {r["id"]: (r["semantic_role"], r["concern"]) for r in generate.merged(items, tags).collect()}
    assert got == {"1": ("rule", ["ui", "ui2"]), "2": (None, []), "3": ("old", [])}
    bad = spark.createDataFrame([("9", "bad", None)], "id string, text string, semantic_role string")
    assert generate.classify(bad, model).count() == 0


def test_checked_retries_once(spark):
    model = lambda p: ["good" if "problems" in p[0] and "hard" not in p[0] else "bad"]
    r = spark.createDataFrame([("a", "easy"), ("b", "hard")], "case_id string, prompt string")
    got = {x["case_id"]: (x["raw"], x["attempts"], x["problems"]) for x in generate.checked(r, model, lambda raw: [] if raw == "good" else ["is bad"]).collect()}
    assert got == {"a": ("good", 2, []), "b": ("bad", 2, ["is bad"])}


def test_paraphrases(spark):
    def model(p):
        if p[0] == "boom":
            raise RuntimeError
        return ["nonsense" if p[0] == "np" else json.dumps({"answer": {"same": "same", "e": " ", "x D1": "y D1", "w D2": "other words"}.get(p[0], p[0] * 9)})]

    t = spark.createDataFrame([(x, x) for x in ("boom", "np", "same", "e", "x D1", "w D2", "long", "done")], "anchor_id string, anchor string")
    out = generate.paraphrases(t, model, spark.createDataFrame([("done",)], "anchor_id string"))
    got = {r["anchor_id"]: r["failure"] for r in out.collect()}
    assert got == {"boom": "call", "np": "parse", "same": "identical", "e": "empty", "x D1": None, "w D2": None, "long": "length"}
    s = generate.generation_stats(out).first()
    assert (s["answers"], s["failures"], s["with_ids"], s["ids_kept"]) == (2, 5, 2, 1)


def test_waves_resume(spark, tmp_path):
    """A run that breaks off in its second wave keeps the first; the next run asks only for what has no answer."""
    asked = tmp_path / "asked"
    asked.mkdir()

    def model_of(name, fails):
        def model(p):
            (asked / f"{name}-{p[0]}").touch()
            if p[0] in fails:
                raise RuntimeError
            return [json.dumps({"answer": p[0] + " again"})]

        return model

    rows = [(f"k{i}", f"text {i}") for i in range(40)] + [("k1", "text 1"), (None, "x")]
    t = spark.createDataFrame(rows, "anchor_id string, anchor string")
    root = str(tmp_path / "ledgers")
    wrote, real = [], generate.paraphrases

    def breaks(*args, **kw):
        if len(wrote) == 2:
            raise OSError("the driver is lost")
        wrote.append(1)
        return real(*args, **kw)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(generate, "paraphrases", breaks)
        with pytest.raises(OSError):
            generate.generate(spark, t, model_of("a", {"text 3", "text 4"}), root, wave=10, calls=2)
    first = generate.ledgers(spark, root)
    answered = {r.anchor for r in first.where("NOT failed").collect()}
    assert 0 < len(answered) < 38
    n = generate.generate(spark, t, model_of("b", set()), root, wave=10, calls=2)
    assert n == 40 - len(answered)
    assert {f[2:] for f in os.listdir(asked) if f.startswith("b-")} == {f"text {i}" for i in range(40)} - answered
    every = generate.ledgers(spark, root)
    assert every.where("NOT failed").count() == 40 and every.where("NOT failed").select("anchor_id").distinct().count() == 40
    assert {r.kind: r.n for r in generate.failures_by_kind(first).collect()}["call"] == first.where("failed").count()
    assert {r.n for r in generate.failures_by_kind(every).collect()} == {0}
    assert generate.generate(spark, t, model_of("c", set()), root) == 0 and not [f for f in os.listdir(asked) if f.startswith("c-")]


def test_waves_read_their_own_rows_only(spark, tmp_path, monkeypatch):
    """What is to be asked for is found once a run; waves don't go back to the source, and empty ones write nothing."""
    source, root = str(tmp_path / "source"), str(tmp_path / "root")
    spark.createDataFrame([(str(i), f"anchor {i}") for i in range(40)], "anchor_id string, anchor string").write.parquet(source)
    seen, real = [], generate.paraphrases

    def watched(part, *args, **kwargs):
        seen.extend(part.inputFiles())
        return real(part, *args, **kwargs)

    monkeypatch.setattr(generate, "paraphrases", watched)
    assert generate.generate(spark, spark.read.parquet(source), generate.stub, root, wave=2, calls=2) == 40
    assert seen and not [f for f in seen if f"{root}/_todo/wave=" not in f] and len(seen) == len(set(seen))
    assert {(r["anchor_id"], r["failed"]) for r in generate.ledgers(spark, root).collect()} == {(str(i), False) for i in range(40)}
    assert generate.generate(spark, spark.read.parquet(source), generate.stub, root, wave=2, calls=2) == 0
