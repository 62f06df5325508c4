"""Bodies of any length are embedded whole; a sync that would lose a folder is refused."""

import pytest
from pyspark.sql import functions as F

from quern.operators import sync
from quern.plans import index


def test_pieces_hold_the_whole_body(spark):
    bodies = ["", "short", "x" * 3500, "x" * 3501, "é" * 1751, "\U0001f600" * 5000, "a\n" * 10_000, None]
    chunks = spark.createDataFrame([(str(i), "s", b, i) for i, b in enumerate(bodies)], "chunk_id string, source string, body string, extra int")
    got = index.pieces(chunks).collect()
    assert got[0].asDict().keys() == {"chunk_id", "source", "body", "extra"}
    for i, b in enumerate(bodies):
        own = sorted((r for r in got if r.extra == i), key=lambda r: int(r.chunk_id.partition("#")[2] or 0))
        assert (own[0].body is None) == (b is None)
        assert "".join(r.body or "" for r in own) == (b or "") and all(len((r.body or "").encode()) <= 3500 for r in own)
        assert [r.chunk_id for r in own] == ([str(i)] if len(own) == 1 else [f"{i}#{k + 1}" for k in range(len(own))])


def test_vectors_of_long_bodies(spark):
    """A word that stands only at the end of a long body is in one of its vectors."""
    body = "word " * 2000 + "needle"
    v = index.vectors(spark.createDataFrame([("c", "universal", "s", body)], "chunk_id string, scope string, source string, body string"), "corpus").collect()
    needle = index.HashEmbedder()(["needle"])[0]
    at = max(range(64), key=lambda i: abs(needle[i]))
    assert len(v) > 1 and v[-1]["doc"].endswith("needle") and any(abs(r["embedding"][at]) > 0 for r in v)


def test_remembered_words_are_bounded():
    e = index.HashEmbedder(remembered=3)
    assert e(["a b c d e"]) == index.HashEmbedder()(["a b c d e"]) and len(e.known) == 3


def test_null_body_is_embedded_as_empty(spark):
    v = index.vectors(spark.createDataFrame([("c", "u", "s", None)], "chunk_id string, scope string, source string, body string"), "corpus").select(F.size("embedding")).collect()
    assert [r[0] for r in v] == [64]


def test_a_folder_that_vanishes_is_refused(spark, tmp_path):
    c = "source string, source_sha string, scope string, doc_type string, chunk_id string, family string"
    rows = [("core/a.py", "1", "backend", "code", "c1", "code"), ("core/b.py", "1", "backend", "code", "c2", "code"), ("web/a.ts", "1", "webapp", "code", "c3", "code")]
    from quern.sources import tables

    root, chunks = str(tmp_path / "root"), spark.createDataFrame(rows, c)
    tables.write_generation(spark, root, chunks, sync.source_rows(chunks), sync.BUILDER_VERSION)
    now = spark.createDataFrame(rows[:2], c)
    with pytest.raises(sync.SyncRefused, match="web"):
        sync.sync(spark, root, now, folders=("core", "web", "never"))
    assert sync.sync(spark, root, spark.createDataFrame(rows[1:], c), folders=("core", "web"), dry_run=True).removed == 1
    assert spark.read.parquet(f"{tables.current(spark, root)}/chunks").count() == 3
    assert sync.sync(spark, root, now).removed == 1
    assert spark.read.parquet(f"{tables.current(spark, root)}/chunks").count() == 2
