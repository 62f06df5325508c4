import json

import pytest
from pyspark.sql import functions as F

from quern.operators import ledger, promotion, reports, terms
from quern.plans import nightly, steps
from quern.sources import suites, tables


def test_promotion_state(spark, tmp_path):
    at = str(tmp_path / "state.json")
    assert promotion.load(at) == {} and promotion.state_frame(spark, at).count() == 0
    for bad in (("retrieve", "D1", ["a", "b"]), ("challenge", "", ["a", "b"]), ("challenge", "D1", ["a"])):
        with pytest.raises(promotion.Refused):
            promotion.promote(at, *bad, "2026-01-01")
    promotion.promote(at, "challenge", "D1", ["a", "b"], "2026-01-01")
    v = spark.createDataFrame([("challenge", "abort"), ("challenge", "confirm_with_user"), ("validate", "block"), ("challenge", None)], "surface string, proceed string")
    assert [r["blocked"] for r in promotion.enforced(v, promotion.state_frame(spark, at)).collect()] == [True, False, False, False]
    with pytest.raises(promotion.Refused):
        promotion.demote(at, "challenge", "", "2026-02-01")
    promotion.demote(at, "challenge", "it blocked a valid request", "2026-02-01")
    state = promotion.load(at)["challenge"]
    assert not state["blocking"] and state["decision"] == "D1" and state["reason"]
    assert not any(r["blocked"] for r in promotion.enforced(v, promotion.state_frame(spark, at)).collect())
    (tmp_path / "state.json").write_text("{")
    assert promotion.state_frame(spark, at).count() == 0  # unreadable: advisory


def test_gate_exit_and_override(spark):
    f = lambda *s: spark.createDataFrame([(x,) for x in s], "status string")
    assert [promotion.gate_exit(f(*s)) for s in (("fresh", "skipped"), ("fresh", "stale"), ("stale", "missing"))] == [0, 1, 2]
    s = spark.createDataFrame([("a", "g", "s", "c", "r")], "suite_id string, git_sha string, suite_sha string, corpus_sha string, repo_sha string")
    assert promotion.override(s, "why", "now").first()["verdict"] == "OVERRIDE"
    with pytest.raises(promotion.Refused):
        promotion.override(s, "", "now")


def test_suites(spark, tmp_path):
    def written(body):
        (tmp_path / "s.yaml").write_text(body)
        return str(tmp_path / "s.yaml")

    assert suites.suite(spark, written("suite_id: s\ncases:\n- id: a\n  scope: [x]\n  request: r\n- id: b")).count() == 2
    for bad in ("cases:\n- id: a", "suite_id: s", "suite_id: s\ncases:\n- id: a\n- id: a"):
        with pytest.raises(suites.BadSuite):
            suites.suite(spark, written(bad))
    ok = suites.recall_suite(spark, written("queries:\n- {id: q1, text: t, expected_source: a}\n- {id: q2, text: t, expected_source: b}"))
    with pytest.raises(suites.BadSuite):
        suites.recall_suite(spark, written("queries:\n- {id: q1, text: t}"))
    printed = f"log\n{suites.BEGIN}\n" + json.dumps({"queries": [{"query_id": "q1", "hits": [{"sentence_id": "s", "source": "a", "score": 0.5}]}, {"query_id": "q2", "hits": []}]}) + f"\n{suites.END}\n"
    hits = suites.remote_hits(spark, printed)
    assert suites.complete(hits, ok).count() == 2
    with pytest.raises(suites.BadSuite):
        suites.complete(hits.where("qid = 'q1'"), ok)
    for bad in ("nothing", f"{suites.BEGIN} x {suites.END}"):
        with pytest.raises(suites.BadSuite):
            suites.remote_hits(spark, bad)
    suites.write_recall_inputs(spark.createDataFrame([("1", "t", "a", "x")], "id string, text string, source string, more string"), ok, str(tmp_path / "in"))
    assert spark.read.json(str(tmp_path / "in/sentences")).columns == ["id", "source", "text"]


def test_files_and_diffs(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r/NOTES.md").write_text("be brief")
    got = suites.instruction_files(spark, [str(tmp_path / "r"), str(tmp_path / "none")], "NOTES.md").collect()
    assert [(r["repo"], r["source"], r["text"]) for r in got] == [("r", "r/NOTES.md", "be brief")]
    assert suites.instruction_files(spark, [], "x").count() == 0
    assert suites.diff_of(str(tmp_path / "r/NOTES.md"), ".") == "be brief"
    with pytest.raises(suites.BadSuite):
        suites.diff_of("no-such-ref", str(tmp_path))
    suites.save_state(str(tmp_path / "c/cursor.json"), {"r": "sha"})
    assert suites.load_state(str(tmp_path / "c/cursor.json")) == {"r": "sha"} and suites.load_state(str(tmp_path / "no")) == {}


def test_answer_schema(spark):
    listed = spark.createDataFrame([("D1", "dictionary", "webapp"), ("AP2", "dictionary", "business"), ("word", "glossary", "backend"), ("a/b", "concept", "backend"), ("other", "concept", "webapp")], "term string, layer string, scope string")
    s = terms.answer_schema(listed, ["backend"])["properties"]["challenge"]["properties"]
    assert s["confirms"]["items"]["properties"]["cites"]["items"]["anyOf"][1]["enum"] == ["AP2", "D1", "word"]
    rules = s["applicable_rules"]["properties"]
    assert rules["decisions_to_honor"]["items"]["enum"] == ["D1"] and rules["standards"] == {"type": "array", "maxItems": 0}
    import re

    assert re.match(terms.path_pattern(), "decisions/log.md#D17") and not re.match(terms.path_pattern(), "etc/log.md")
    assert terms.path_pattern(()) == "" and terms.cites_schema([], ()) == {"type": "array", "items": {"type": "string"}}


def test_yaml_text(spark):
    df = spark.createDataFrame([('{"b": [1, "x"], "a": null}',), ("no",), (None,)], "raw string").select(reports.yaml_text("raw").alias("y"))
    assert [r["y"] for r in df.collect()] == ["b:\n- 1\n- x\na: null\n", "", ""]


def test_training_split_agrees_with_itself(spark):
    rows = spark.range(3000)
    a, b = (sorted(map(tuple, reports.split_rows(r, "id").collect())) for r in (rows, rows.repartition(7)))
    assert a == b and sum(p == "eval" for _, p in a) == 300
    assert {r["part"] for r in reports.split_rows(spark.range(20), "id").collect()} == {"eval"}


def test_plans_from_json():
    assert [s.id for s in steps.from_json('{"steps": [{"id": "a"}, {"id": "b", "depends_on": ["a"]}]}')] == ["a", "b"]
    for bad in ("{", "[1]", '[{"id": "a", "depends_on": ["z"]}]', "[]"):
        with pytest.raises(ValueError):
            steps.from_json(bad)
    assert steps.expected_schema({"a": [1.5], "b": {"c": "x"}, "d": True}) == {
        "type": "object", "required": ["a", "b", "d"],
        "properties": {"a": {"type": "array", "items": {"type": "number"}}, "b": {"type": "object", "required": ["c"], "properties": {"c": {"type": "string"}}}, "d": {"type": "boolean"}},
    }


def test_long_plans_are_refused(spark):
    s = spark.createDataFrame([("p", str(i), []) for i in range(26)], "plan_id string, step_id string, depends_on array<string>")
    with pytest.raises(Exception, match="more steps"):
        steps.levels(s).collect()


def test_nightly():
    ran = []

    def job(name, fails=False):
        def run():
            ran.append(name)
            if fails:
                raise RuntimeError("no")

        return run

    got = nightly.nightly({"gate": job("gate"), "corpus": job("corpus"), "more": job("more"), "code": job("code", True), "history": job("history")}, {"history": ("a", "a"), "gate": ("a", "a")})
    assert ran == ["code", "corpus", "more", "gate"]
    assert [(r["job"], r["status"]) for r in got] == [("code", "failed"), ("history", "skipped"), ("corpus", "done"), ("more", "done"), ("gate", "done")]


def test_lines_of_large_logs_are_numbered(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text("".join(("\n" if i % 50 == 49 else json.dumps({"n": i, "pad": "x" * 40}) + "\n") for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        got = tables.json_log(spark, str(tmp_path), "n long")
        assert got.count() == 2 * 2940 and got.where("line_no != n + 1 OR bad").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_prune_with_equal_times(spark):
    o = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("path"), F.lit(10).cast("long").alias("size"), F.lit("2026-01-01").cast("timestamp").alias("mtime"))
    got = sorted(r["path"] for r in ledger.prune(o.repartition(5), max_bytes=2_500, per_bucket=100).collect())
    assert got == [f"{i:04d}" for i in range(750)]


def test_made_rows_are_dealt_out(spark, tmp_path):
    """A table of one row group is one task to read, but not to make long rows of."""
    from quern import queries_more
    from tests.conftest import DATA

    for name in ("digest_acceptance", "yaml_chunks", "layer_counts", "listed_terms"):
        plan = getattr(queries_more, name)(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [p_partkey" in plan, name
    rows = queries_more._made(spark, DATA, k="p_partkey")
    assert rows.rdd.glom().filter(len).count() > 4
