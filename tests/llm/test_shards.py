"""Shards against a plain prefix sum, and what must hold of any result."""

import hashlib
import random

import pytest

from quern.llm import shards

SCHEMA = "doc_id long, text string"


def brute(rows, n):
    """(doc_id, size, shard, slot) by one running sum over the sorted documents."""
    d = sorted((int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16), i is not None, i or 0, len((t or "").encode()) + 1) for i, t in rows)
    total, largest = sum(x[3] for x in d), max((x[3] for x in d), default=0)
    ends, e = [], 0
    for x in d:
        e += x[3]
        ends.append(e)
    cuts = []
    for k in range(1, n):
        c = next((i for i in range(len(d)) if (2 * ends[i] - d[i][3]) * n >= 2 * total * k), len(d))
        if c < len(d):
            run = [i for i in range(len(d)) if d[i][0] == d[c][0]]
            left, right = sum(d[i][3] for i in run if i < c), sum(d[i][3] for i in run if i >= c)
            if left <= right and left <= largest:
                c = run[0]
            elif left and right <= largest:
                c = run[-1] + 1
        cuts.append(c)
    out, slots = [], [0] * n
    for i, x in enumerate(d):
        s = sum(c <= i for c in cuts)
        out.append((x[2] if x[1] else None, x[3], s, slots[s]))
        slots[s] += 1
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "size", "shard", "slot").collect()), key=str)


@pytest.mark.parametrize(("n", "partitions"), [(1, None), (2, 7), (8, 1), (40, 7)])
def test_against_plain(spark, n, partitions):
    r = random.Random(n)
    rows = [(i, "é" * r.randrange(30)) for i in range(80)] + [(i, "copy of one text") for i in range(100, 130)] + [(7, "x" * 900), (None, "y" * 50), (3, None), (4, ""), (5, "again"), (5, "again")]
    r.shuffle(rows)
    assert found(shards.sharded(spark.createDataFrame(rows, SCHEMA), n, partitions)) == brute(rows, n)


def test_hot_rows_fill_several_partitions(spark):
    """A third of the rows are the same row: they don't meet in one partition, and the sizes stay equal."""
    rows = [(1, "the same text")] * 3000 + [(i, f"text {i}") for i in range(6000)]
    placed = shards.in_order(spark.createDataFrame(rows, SCHEMA).repartition(4), 9)
    per_part = [r["count"] for r in placed.groupBy(shards._part()).count().collect()]
    assert max(per_part) < 2500
    got = found(shards.sharded(spark.createDataFrame(rows, SCHEMA), 8, 9))
    assert got == brute(rows, 8)
    sizes = [sum(x[1] for x in got if x[2] == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 3 * 14


def test_messy(spark, messy, nothing):
    df = messy.withColumn("shard", messy["source"]).withColumn("slot", messy["source"]).withColumn("key", messy["n_chars"])
    out = shards.sharded(df)
    assert sorted(out.columns) == sorted(df.columns)
    rows = [(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()]
    assert found(out) == brute(rows, 8)
    assert {(r.doc_id, r.text, r.lang) for r in out.collect()} == {(r.doc_id, r.text, r.lang) for r in messy.collect()}
    assert shards.sharded(nothing).count() == 0


def test_written_shards(spark, tmp_path):
    rows = [(i, "word " * (i % 17)) for i in range(500)]
    for _ in range(2):
        shards.write_shards(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "out"), 5)
        got = spark.read.parquet(str(tmp_path / "out"))
        assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted(rows)
        for r in got.groupBy("shard").agg({"slot": "max", "*": "count"}).collect():
            assert r["max(slot)"] + 1 == r["count(1)"]
