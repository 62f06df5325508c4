import json

from quern import cli


def run(spark, *argv):
    a = cli.parser().parse_args(argv)
    return a.run(spark, a)


def test_corpus_commands(spark, tmp_path, capsys):
    kb = tmp_path / "kb"
    (kb / "decisions").mkdir(parents=True)
    (kb / "decisions/log.yaml").write_text("- id: D1\n  name: x\n")
    (kb / "n.md").write_text("# T\n## A\nsee D1, a longer body of words\n")
    out, vec = str(tmp_path / "out"), str(tmp_path / "vec")
    assert run(spark, "corpus", "sync", str(kb), out) == 1
    assert run(spark, "corpus", "build", str(kb), out) == 0 and "universal\t2" in capsys.readouterr().out
    (kb / "n.md").write_text("# T\n## A\nsee D1 and D99, a longer body of words\n")
    assert run(spark, "corpus", "status", str(kb), out) == 0 and "changed\t1" in capsys.readouterr().out
    assert run(spark, "corpus", "sync", str(kb), out) == 0 and "changed 1" in capsys.readouterr().out
    assert run(spark, "corpus", "index", out, vec) == 0
    assert run(spark, "retrieve", "ask", "longer body", vec, "--n", "2") == 0 and "n.md" in capsys.readouterr().out
    assert run(spark, "prompt", "check", str(kb / "n.md"), str(kb), out) == 1 and "D99" in capsys.readouterr().out


def test_gate_and_cache(spark, tmp_path, capsys):
    r = tmp_path / "r.json"
    r.write_text(json.dumps({"case_id": "a", "blockers": 1, "warnings": 0, "infos": 0, "attempts": 1, "error": ""}) + "\n")
    assert run(spark, "eval", "gate", str(r)) == 1 and "blockers above" in capsys.readouterr().out
    assert run(spark, "eval", "gate", str(r), "--max-blockers", "1") == 0
    log = tmp_path / "log.json"
    log.write_text('{"event":"hit"}\n{"event":"miss"}\ntorn\n')
    assert run(spark, "cache", "status", str(log)) == 0 and "hit_rate_pct\t50.0" in capsys.readouterr().out
