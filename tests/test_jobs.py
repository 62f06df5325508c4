"""The jobs: growing input, interrupted runs, reruns, odd rows, command lines, and their SQL."""

import hashlib
import json
import os
import subprocess
import sys

import duckdb
import pytest

from jobs import chunk_sync, settings, training_pairs
from jobs import queries as job_queries
from quern.operators import segments
from tests.conftest import DATA, ROOT

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def save(spark, path, rows):
    spark.createDataFrame([(i, t, lang, "s", None) for i, t, lang in rows], DOCS).repartition(3).write.mode("overwrite").parquet(path)
    return path


def plain_chunks(rows, lines=80, overlap=20):
    """Every document's windows, made in Python."""
    best = {}
    for i, t, lang in rows:
        if i is not None:
            sha = hashlib.sha1((t or "").encode()).hexdigest()
            best[i] = max(best.get(i, ("", "", "")), (sha, lang or "universal", t or ""))
    out = set()
    for i, (_, scope, t) in best.items():
        ls = t.split("\n")
        ls = ls[:-1] if ls and ls[-1] == "" else ls
        k = 0
        while ls:
            start, end = k * (lines - overlap) + 1, min(k * (lines - overlap) + lines, len(ls))
            anchor = f"docs/{i}.txt#L{start}-L{end}"
            out.add((f"docs/{i}.txt", scope, anchor, hashlib.sha1((anchor + "|" + "\n".join(ls[start - 1 : end])).encode()).hexdigest()))
            if end == len(ls):
                break
            k += 1
    return out


def stored_chunks(spark, out):
    rows = chunk_sync.chunks(spark, out).collect()
    assert len({r.chunk_id for r in rows}) == len(rows)
    return {(r.source, r.scope, r.anchor, hashlib.sha1((r.anchor + "|" + r.body.split("\n", 1)[1][:-1]).encode()).hexdigest()) for r in rows}


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows_of(n, words="line"):
    return [(i, "\n".join(f"{words} {i} {k}" for k in range(1 + i * 7 % 200)), ("en", "fr", None)[i % 3]) for i in range(n)]


def test_growing_input_touches_only_its_partitions(spark, tmp_path):
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    first = rows_of(40)
    save(spark, docs, first)
    done = chunk_sync.run(spark, docs, out, buckets=16)
    assert (done.added, done.changed, done.removed, done.repaired) == (40, 0, 0, 0)
    assert stored_chunks(spark, out) == plain_chunks(first)

    before = files(out)
    assert chunk_sync.run(spark, docs, out, buckets=16).no_op and files(out) == before

    second = [r for r in first if r[0] != 3] + [(100, "a new one", "de")]
    second = [(i, t + "\nmore" if i == 5 else t, lang) for i, t, lang in second]
    save(spark, docs, second)
    done = chunk_sync.run(spark, docs, out, buckets=16)
    assert (done.added, done.changed, done.removed) == (1, 1, 1) and len(done.buckets) <= 3
    assert stored_chunks(spark, out) == plain_chunks(second)
    for table in ("chunks", "sources"):
        changed = {int(f.split("bucket=")[1].split("/")[0]) for f in files(f"{out}/{table}") ^ {x for x in before if f"/{table}/" in x}}
        assert changed == set(done.buckets)


def test_tallies_follow_the_changes(spark, tmp_path):
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    for rows in (rows_of(30), rows_of(35)[3:], [(1, "", "en"), (2, "words", "fr")], rows_of(30)):
        save(spark, docs, rows)
        chunk_sync.run(spark, docs, out, buckets=8)
        want = {}
        for i, t, lang in rows:
            n = sum(c[0] == f"docs/{i}.txt" for c in plain_chunks(rows))
            s, c = want.get(lang or "universal", (0, 0))
            want[lang or "universal"] = s + 1, c + n
        assert {r.scope: (r.sources, r.chunks) for r in segments.tallies(spark, out).collect()} == want
    assert segments.tallies(spark, str(tmp_path / "nothing")).count() == 0


def test_partition_that_loses_all_its_rows(spark, tmp_path):
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    save(spark, docs, rows_of(6))
    chunk_sync.run(spark, docs, out, buckets=1000)
    save(spark, docs, [(0, "", "en"), *rows_of(6)[1:3]])
    done = chunk_sync.run(spark, docs, out, buckets=1000)
    assert (done.changed, done.removed) == (1, 3)
    assert stored_chunks(spark, out) == plain_chunks(rows_of(6)[1:3])
    assert chunk_sync.run(spark, docs, out, buckets=1000).no_op


@pytest.mark.parametrize("first_run", [True, False])
@pytest.mark.parametrize("fails_at", [0, 1, 2])
def test_interrupted_run(spark, tmp_path, monkeypatch, first_run, fails_at):
    """The run breaks off before the chunks, the tallies or the mark are written; the next one gives what a whole run gives."""
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    if not first_run:
        save(spark, docs, rows_of(20))
        chunk_sync.run(spark, docs, out, buckets=8)
    rows = [(i, t + " changed" if i % 2 else t, lang) for i, t, lang in rows_of(25) if i != 4]
    save(spark, docs, rows)
    calls, whole = [], segments._overwrite

    def breaks(*args):
        calls.append(args)
        if len(calls) - 1 == fails_at:
            raise OSError("the driver is lost")
        whole(*args)

    with monkeypatch.context() as m:
        m.setattr(segments, "_overwrite", breaks)
        with pytest.raises(OSError):
            chunk_sync.run(spark, docs, out, buckets=8)
    rows = [r for r in rows if r[0] != 7]
    save(spark, docs, rows)
    done = chunk_sync.run(spark, docs, out, buckets=8)
    assert (done.repaired > 0) == (fails_at > 0)
    assert stored_chunks(spark, out) == plain_chunks(rows)
    assert chunk_sync.run(spark, docs, out, buckets=8).no_op


def test_lost_partition_is_made_anew(spark, tmp_path):
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    save(spark, docs, rows_of(20))
    chunk_sync.run(spark, docs, out, buckets=4)
    for f in files(f"{out}/chunks/bucket=2"):
        os.remove(f)
    done = chunk_sync.run(spark, docs, out, buckets=4)
    assert done.buckets == [2] and done.repaired == 1
    assert stored_chunks(spark, out) == plain_chunks(rows_of(20))


def test_odd_documents(spark, tmp_path):
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    rows = [(None, "nobody's", "en"), (1, None, None), (2, "", ""), (3, "x" * 200_000, "en"), (4, "one", "en"), (4, "two", "fr"), (5, "same", "en"), (5, "same", "en"), (6, "\n" * 300, "en")]
    save(spark, docs, rows)
    chunk_sync.run(spark, docs, out, buckets=4)
    assert stored_chunks(spark, out) == plain_chunks(rows)
    assert chunk_sync.run(spark, docs, out, buckets=4).no_op
    save(spark, docs, [])
    assert chunk_sync.run(spark, docs, out, buckets=4).removed == 6
    assert stored_chunks(spark, out) == set()


def read_pairs(spark, out):
    return sorted(tuple(r) for r in training_pairs.written(spark, out).select("doc_id", "anchor", "positive", "split", "lang").collect())


def test_pairs(spark, tmp_path):
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    a, b, c, d = (f"This is sentence number {x} of them." for x in ("one", "two", "three", "four"))
    rows = [(1, f"{a} {b} {c}", "en"), (2, f"{b} {d}", "fr"), (3, f"{d}\n\nLicensed under the moon, says the last line here.\n\n{a}", None), (None, f"{a} {b}", "en"), (5, None, "en"), (6, f"{a} {a}", "en"), (7, "short.", "en"), (8, f"{c} {d}", "en"), (8, f"{c} {d}", "en")]
    save(spark, docs, rows)
    settings_ = settings.read_config("training_pairs")
    for _ in range(2):
        training_pairs.run(spark, docs, out, settings_["eval_percent"], settings_["banned"])
        split = lambda i: "eval" if int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % 100 < 10 else "train"
        # "b" is taken from document 1 only; the license line of document 3 is gone; "a a" has no pair.
        assert read_pairs(spark, out) == sorted([(1, a, b, split(1), "en"), (1, b, c, split(1), "en"), (3, d, a, split(3), "und"), (8, c, d, split(8), "en")])
    report = spark.read.parquet(f"{out}/report")
    assert report.agg({"pairs": "sum"}).first()[0] == 4


def test_pairs_read_documents_once(spark):
    """Sentences are made once a run: no join of the pairs with themselves."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plan = training_pairs.pairs_of(docs, 10, ())._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation [") == 1


def test_pairs_shuffle_texts_once(spark):
    """Texts pass one shuffle, and in it a pair's sentences stand once: no digests of them or of the whole text."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plan = training_pairs.pairs_of(docs, 10, ())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "md5(text" not in plan and "md5(anchor" not in plan and "xxhash64(anchor" not in plan


def test_few_row_groups_are_dealt_out(spark):
    """A table of one task is dealt out before it is cut; one of many tasks is read as it lies."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plans = [training_pairs.spread(x)._jdf.queryExecution().logical().toString() for x in (docs.coalesce(1), docs.repartition(8))]
    assert "'RepartitionByExpression ['doc_id]" in plans[0] or "RepartitionByExpression [doc_id" in plans[0]
    assert "RepartitionByExpression" not in plans[1]


def test_texts_of_one_id(spark):
    """Of texts that share an id, a sentence's pair is taken whole from one of them, the same one each time."""
    a, b, c = (f"This is sentence number {x} of them." for x in ("one", "two", "three"))
    rows = [(1, f"{a} {b}", "fr"), (1, f"{a} {c}", "en"), (1, f"{a} {b}", "fr"), (2, f"{a} {b}", "de")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, lang string").repartition(3)
        got = [(r["doc_id"], r["anchor"], r["positive"], r["lang"]) for r in training_pairs.pairs_of(df, 10, ()).collect()]
        assert got == [(1, a, c, "en")]


def test_pairs_of_given_documents(spark, tmp_path):
    """No anchor twice, none in both splits, about the share that is asked for."""
    out = str(tmp_path / "out")
    training_pairs.run(spark, f"{DATA}/documents.parquet", out, 30, "")
    pairs = training_pairs.written(spark, out)
    assert pairs.count() == pairs.select("anchor").distinct().count() > 1000
    share = pairs.where("split = 'eval'").select("doc_id").distinct().count() / pairs.select("doc_id").distinct().count()
    assert 0.15 < share < 0.45


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(job_queries.queries()))
def test_query(spark, db, tmp_path, name):
    df = job_queries.queries()[name](spark, DATA)
    df.write.parquet(str(tmp_path / "out"))
    cols = ", ".join(f'"{c}"' for c in sorted(df.columns))
    rows, sql = f"'{tmp_path}/out/*.parquet'", f"SELECT {cols} FROM ({job_queries.oracle_sql()[name]})"
    both = db.execute(f"SELECT (SELECT count(*) FROM ({sql} EXCEPT ALL SELECT {cols} FROM {rows})), (SELECT count(*) FROM (SELECT {cols} FROM {rows} EXCEPT ALL {sql})), (SELECT count(*) FROM {rows}) > 0").fetchall()[0]
    assert both == (0, 0, True)


def test_command_line(spark, tmp_path):
    docs, out, config = save(spark, str(tmp_path / "docs"), rows_of(5)), str(tmp_path / "out"), str(tmp_path / "c.json")
    with open(config, "w") as f:
        json.dump({"documents": docs, "buckets": 4}, f)
    done = subprocess.run([sys.executable, "-m", "jobs.chunk_sync", "--config", config, "--output", out, "--master", "local[1]"], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "5 added, 0 changed, 0 removed" in done.stderr
    assert stored_chunks(spark, out) == plain_chunks(rows_of(5))


def test_settings(tmp_path):
    config = str(tmp_path / "c.json")
    with open(config, "w") as f:
        json.dump({"bukets": 4}, f)
    with pytest.raises(ValueError, match="bukets"):
        settings.read_config("chunk_sync", config)
    with pytest.raises(SystemExit):
        settings.command_line("chunk_sync", chunk_sync.run, ["--documents", "x"])
