"""The trie against a plain one, built node by node in Python."""

import hashlib
import math
import random
import zlib

import pytest

from quern.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def sequences(rows, rebuild):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            m = hashlib.md5(f"{role or ''}\0{text or ''}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", m, text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    if not rebuild:
        return own
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    return out


def brute(rows, rebuild):
    seqs = sequences(rows, rebuild)
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    out = []
    for node, cs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y[: len(x)] == x and len(y) == len(x) + 1 for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(str(c) for c in sorted(cs) if len(seqs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(cs), len(node), parent, len(cs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def both(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(trie.conversation_trie(df)) == brute(rows, False)
    assert found(trie.trie_nodes(trie.rebuilt_paths(trie.turns(df)))) == brute(rows, True)


@pytest.mark.parametrize("seed", range(2))
def test_random_against_plain(spark, seed):
    r = random.Random(seed)
    rows = [(c, t, r.choice("ua"), r.choice(["", "x", "yé", "zzz"])) for c in r.sample(range(-150, 450), 60) for t in range(r.randrange(0, 8))]
    both(spark, rows)


def test_messy_rows(spark):
    rows = [
        (None, 0, "user", "nobody's"), (0, None, None, None), (0, 1, "user", "hi"), (0, 1, "user", "hi"), (0, 2, "assistant", ""), (1, 5, "user", "hi"),
        (2, 0, "", ""), (2, 1, "user", "hi"), (3, 0, None, "\U0001f600" * 5), (101, 1, "user", "no base"), (102, 1, "user", "x" * 200_000), (7, 1, "a", "bc"), (8, 1, "ab", "c"), (100_000_000_000, 1, "user", "hi"),
    ]
    both(spark, rows)


def test_one_hot_beginning_and_one_hot_end(spark):
    rows = [(c, t, "user", f"{t}") for c in range(400) for t in range(1 + c % 3)] + [(1000, t, "user", str(t % 7)) for t in range(500)]
    both(spark, rows)


def test_digests_over_many_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        test_one_hot_beginning_and_one_hot_end(spark)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert trie.conversation_trie(df).count() == 0 and trie.trie_nodes(trie.rebuilt_paths(trie.turns(df))).count() == 0
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("pos", "h1", "h2", "n", "m", "r", "depth", "first", "head", "base", "h", "is_end"):
        df = df.withColumn(c, df["text"])
    assert found(trie.conversation_trie(df)) == brute(rows, False)


def test_owned_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "user", "a"), (2, 1, "user", "c"), (3, 0, "user", "a"), (3, 1, "user", "b")]
    got = {(r.conv_id, r.depth): (r.text, r.owned) for r in trie.owned_turns(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 1): ("a", True), (1, 2): ("b", True), (2, 1): ("a", False), (2, 2): ("c", True), (3, 1): ("a", False), (3, 2): ("b", False)}
