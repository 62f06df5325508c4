import json
import os
import subprocess

import pytest

from quern.sources import gitlog, tables, tree
from quern.streaming import ledgers


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "kb"
    for name, body in {"decisions/log.yaml": "- id: D1\n  name: x\n", "patterns/web.md": "## A\nsee D1\n", ".hidden/a.md": "# h\n", "v1/old.md": "no\n", "x.yml": "a: 1\n", "code/a.py": "print(1)\n"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    (root / "code/b.bin").write_bytes(b"ab\0cd")
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "first")
    (root / "patterns/web.md").write_text("## A\nsee D1 and more\n")
    git("mv", "code/a.py", "code/c.py")
    git("add", "-A")
    git("commit", "-qm", "second D1\n\nwhy")
    return root


def test_tree_equals_ref(spark, repo):
    names = lambda **o: {(r["path"], r["sha"]) for r in tree.read_tree(spark, str(repo), exts=".md,.yaml", **o).collect()}
    assert {n for n, _ in names()} == {"decisions/log.yaml", "patterns/web.md", ".hidden/a.md"}
    assert names() == names(ref="HEAD")
    with pytest.raises(ValueError):
        tree.checked_ref("--upload-pack=x")
    link = repo.parent / "link"
    os.symlink(repo, link)
    assert tree.real_root(str(link)) == str(repo)


def test_knowledge_and_repo_files(spark, repo):
    kb = {r["source"]: (r["scope"], r["doc_type"]) for r in tree.knowledge_files(spark, str(repo)).collect()}
    assert kb["decisions/log.yaml"] == ("universal", "decision") and kb["patterns/web.md"] == ("universal", "pattern")
    code = {r["path"]: r["language"] for r in tree.repo_files(spark, str(repo), "r").collect()}
    assert code["code/c.py"] == "python" and "code/b.bin" not in code


def test_git_log(spark, repo):
    got = gitlog.read_log(spark, {"r": str(repo)}).collect()
    assert len(got) == 1  # the root commit is left out
    c = got[0]
    assert c["message"].startswith("second D1") and {(f["path"], f["status"], f["old_path"]) for f in c["files"]} == {("patterns/web.md", "modified", None), ("code/c.py", "renamed", "code/a.py")}
    assert any("+see D1 and more" in s["diff_unified"] for s in c["snapshots"])
    assert gitlog.read_log(spark, {"r": str(repo)}, stop_at=f"r={c['sha']}").count() == 0
    assert gitlog.read_log(spark, {"r": str(repo)}, stop_at="r=" + "0" * 40).count() == 1


def test_json_and_yaml(spark, tmp_path, repo):
    p = tmp_path / "log.jsonl"
    p.write_text('{"a": 1}\nnot json\n\n{"a": 3}\n')
    got = [(r["line_no"], r["a"], r["bad"]) for r in tables.json_log(spark, str(p), "a long").orderBy("line_no").collect()]
    assert got == [(1, 1, False), (2, None, True), (4, 3, False)]
    assert tables.read_json(spark, str(p), "a long", strict=False).where("a IS NOT NULL").count() == 2
    entries = tables.read_yaml(spark, str(repo), exts=".yaml").collect()
    assert [json.loads(r["entry"]) for r in entries] == [{"id": "D1", "name": "x"}]
    assert tables.latest_version(["v9.yaml", "v10.yaml"]) == "v10.yaml"


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    lines = [("t1", "live", "", "accept", 1), ("t1", "retro", "wrong", "", 2), ("t1", "live", "", "accept", 3), ("t2", "live", "retracted", "", 4), ("none", "live", "", "accept", 5)]
    for i, (t, ph, lab, re_, n) in enumerate(lines):
        (src / f"{i}.json").write_text(json.dumps({"turn_id": t, "phase": ph, "label": lab, "reaction": re_, "line_no": n}) + "\n")
    out = ledgers.effective_updates(ledgers.read_log(spark, str(src), ledgers.REACTIONS, per_trigger=2))
    q = out.writeStream.format("memory").queryName("eff").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = {r["turn_id"]: (r["line_no"], r["removed"]) for r in sorted(spark.table("eff").collect(), key=lambda r: r["line_no"])}
    assert rows == {"t1": (2, False), "t2": (4, True)}

    path, mark = str(tmp_path / "table"), str(tmp_path / "cp")
    for _ in range(2):  # a replay with a fresh checkpoint adds nothing
        s = ledgers.append_new(ledgers.read_log(spark, str(src), ledgers.REACTIONS), path, "line_no", mark).start()
        s.awaitTermination()
        mark += "x"
    assert spark.read.parquet(path).count() == 5
