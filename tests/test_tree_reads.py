"""Which files a read of a tree opens, and histories read in slices by few git processes."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from quern.sources import gitlog, tree


def git(root, *args):
    return subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@x", *args], check=True, capture_output=True).stdout.decode()


@pytest.fixture
def files(tmp_path):
    root = tmp_path / "tree"
    for folder in ("a/b", "a/c", "d"):
        (root / folder).mkdir(parents=True)
        for i in range(4):
            (root / folder / f"f{i}.md").write_text("x" * (10 * i + 1))
            (root / folder / f"f{i}.txt").write_text("y")
    return root


def opened(reader, monkeypatch):
    """The paths that reading all slices opens."""
    seen = []
    real = open

    def watch(path, *args, **kw):
        seen.append(os.path.relpath(path, reader.root))
        return real(path, *args, **kw)

    monkeypatch.setattr("builtins.open", watch)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    monkeypatch.undo()
    return sorted(seen), rows


@pytest.mark.parametrize(
    ("filters", "want"),
    [
        ([tree.ds.StringStartsWith(("path",), "a/b/"), tree.ds.StringEndsWith(("path",), ".md")], {f"a/b/f{i}.md" for i in range(4)}),
        ([tree.ds.EqualTo(("path",), "d/f2.md")], {"d/f2.md"}),
        ([tree.ds.In(("path",), ("d/f2.md", "a/c/f0.txt", "no"))], {"d/f2.md", "a/c/f0.txt"}),
        ([tree.ds.GreaterThan(("length",), 20), tree.ds.LessThanOrEqual(("length",), 30)], {f"{d}/f2.md" for d in ("a/b", "a/c", "d")}),
        ([tree.ds.StringStartsWith(("path",), "zz")], set()),
    ],
)
def test_pushed_filters_decide_what_is_opened(files, monkeypatch, filters, want):
    reader = tree.PushingReader({"root": str(files)})
    other = tree.ds.EqualTo(("sha",), "x")
    assert list(reader.pushFilters([*filters, other])) == [other]
    seen, rows = opened(reader, monkeypatch)
    assert set(seen) == want == {r[0] for r in rows} and len(seen) == len(want)


def test_a_prefix_prunes_folders(files, monkeypatch):
    walked = []
    real = os.walk
    monkeypatch.setattr(os, "walk", lambda top: (walked.append(os.path.relpath(x[0], top)) or x for x in real(top)))
    assert tree.walk(str(files), (), "a/b/f1") == ["a/b/f1.md", "a/b/f1.txt"]
    assert walked == [".", "a", "a/b"]


def test_filters_reach_the_source(spark, files):
    """The same rows with filters pushed and without; a plan with pushed ones has no filter left."""
    ask = lambda: tree.read_tree(spark, str(files)).where(F.col("path").startswith("a/") & F.col("path").endswith(".md") & (F.col("length") > 1))
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key, "false")
    got = {}
    try:
        for on in ("true", "false"):
            spark.conf.set(key, on)
            got[on] = sorted((r.path, r.length) for r in ask().collect())
    finally:
        spark.conf.set(key, before)
    assert got["true"] == got["false"] == sorted((f"a/{d}/f{i}.md", 10 * i + 1) for d in "bc" for i in range(1, 4))


def test_without_content_tracked_files_stay_closed(spark, files, monkeypatch):
    git(files, "init", "-q")
    git(files, "add", "-A")
    git(files, "commit", "-qm", "first")
    (files / "new.md").write_text("untracked")
    seen, rows = opened(tree.TreeReader({"root": str(files), "content": "false"}), monkeypatch)
    assert seen == ["new.md"] and len(rows) == 25 and {len(r) for r in rows} == {3}
    whole = {r.path: (r.sha, r.length) for r in tree.read_tree(spark, str(files)).collect()}
    assert {r.path: (r.sha, r.length) for r in tree.read_tree(spark, str(files), content="false").collect()} == whole
    at_ref = {r.path: (r.sha, r.length, bytes(r.content)) for r in tree.read_tree(spark, str(files), ref="HEAD").collect()}
    assert {k: v[:2] for k, v in at_ref.items()} == {k: v for k, v in whole.items() if k != "new.md"}
    assert at_ref["d/f3.md"][2] == b"x" * 31


def test_history_in_slices(spark, files, monkeypatch):
    """Renames, deletions, merges, binaries, long diffs and odd names, over several slices; as git tells them one by one."""
    git(files, "init", "-q")
    git(files, "add", "-A")
    git(files, "commit", "-qm", "root")
    for i in range(7):
        (files / "d" / "f0.md").write_text("".join(f"line {i} {k}\n" for k in range(i * 400)))
        (files / f"näme {i}\tx.md").write_text(f"{i}\ndiff --git a/x b/x\n{'0' * 40}\n")
        git(files, "add", "-A")
        git(files, "commit", "-qm", f"change {i}\n\nSee D{i}")
    git(files, "mv", "a/b/f3.md", "a/b/g3.md")
    (files / "bin").write_bytes(b"a\0b")
    git(files, "rm", "-q", "a/c/f1.md")
    git(files, "add", "-A")
    git(files, "commit", "-qm", "moves")
    git(files, "commit", "-q", "--allow-empty", "-m", "empty")
    git(files, "checkout", "-q", "-b", "side", "HEAD~3")
    (files / "side.md").write_text("s\n")
    git(files, "add", "-A")
    git(files, "commit", "-qm", "side")
    git(files, "checkout", "-q", "-")
    git(files, "merge", "-q", "--no-ff", "-m", "merge", "side")
    monkeypatch.setattr(gitlog, "SLICE", 3)
    reader = gitlog.GitLogReader({"repos": f"r={files}", "diff_cap": "600"})
    parts = reader.partitions()
    assert len(parts) == 4 and sum(len(p.shas) for p in parts) == 11
    calls = []
    run, popen = subprocess.run, subprocess.Popen
    monkeypatch.setattr(tree.subprocess, "run", lambda a, **k: (calls.append(a), run(a, **k))[1])
    monkeypatch.setattr(tree.subprocess, "Popen", type("P", (popen,), {"__init__": lambda self, a, *x, **k: (calls.append(a), popen.__init__(self, a, *x, **k))[1]}))
    rows = [r for p in parts for r in reader.read(p)]
    assert len({tuple(c) for c in calls}) <= 4
    monkeypatch.undo()
    assert [r[1] for r in rows] == git(files, "rev-list", "--date-order", "--min-parents=1", "HEAD").split()
    for _, sha, short, parent, _, _, message, changed, snaps in rows:
        assert short == sha[:7] and parent == git(files, "rev-parse", f"{sha}^").strip() and message.strip() == git(files, "log", "-1", "--format=%B", sha).strip()
        names = git(files, "diff", "--name-only", "-M", "-z", parent, sha).split("\0")[:-1]
        assert [c[0] for c in changed] == names
        for name, old, _, content, size, cut, diff, diff_size, diff_cut in snaps:
            raw = git(files, "show", f"{sha}:{name}")
            whole = git(files, "diff", "-M", parent, sha, "--", *([old] if old else []), name)
            assert size == len(raw.encode()) and (content == raw or cut)
            assert diff_size == len(whole.encode()) and (diff == whole if not diff_cut else whole.startswith(diff.rsplit("\n... [truncated", 1)[0]) and str(diff_size) in diff)
    by = {r[6].strip().split("\n")[0]: r for r in rows}
    assert ("a/b/g3.md", "renamed", "a/b/f3.md") in {c[:3] for c in by["moves"][7]} and ("a/c/f1.md", "deleted", None) in {c[:3] for c in by["moves"][7]}
    assert by["empty"][7] == [] and [c[0] for c in by["merge"][7]] == ["side.md"] and "bin" not in {s[0] for s in by["moves"][8]}
    assert any(s[8] for s in by["change 5"][8]) and [c[3:] for c in by["change 1"][7] if c[0] == "d/f0.md"] == [(400, 0)]
    # The newest commit is gone after a forced push: all is read again; a known one leaves out itself and what is before.
    count = lambda **o: gitlog.read_log(spark, {"r": str(files)}, **o).count()
    assert (count(), count(stop_at="r=" + "0" * 40), count(stop_at=f"r={rows[-1][1]}"), count(stop_at=f"r={rows[0][1]}")) == (11, 11, 10, 0)
