import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quern.llm import mixing


def targets(sizes, weights=(5, 2, 1)):
    """The contract, word by word: share by weight, cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, t, full = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set()
    while True:
        open_ = [s for s in names if s not in full]
        left = budget - sum(2 * sizes[s] for s in full)
        for s in open_:
            t[s] = left * w[s] / sum(w[x] for x in open_)
        over = [s for s in open_ if t[s] > 2 * sizes[s]]
        for s in over:
            t[s] = 2.0 * sizes[s]
        full |= set(over)
        if not over:
            return t


def test_targets_and_taken(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(1, 60)), rng.choice(["a", "b", "B", "é", None, "c", "huge", "huge", "huge", "huge"])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, shard_words=2000).collect()
    sizes, size = {}, {}
    for i, t, s in rows:
        size[i] = len(re.findall(r"[^\x20\x09-\x0D]+", t))
        sizes[s] = sizes.get(s, 0) + size[i]
    want = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-12)
        taken[r["source"]] += r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= 8 * (1 + sizes[s] / 2000)
    again = mixing.mix(docs.repartition(5), shard_words=2000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def highest_quotients(votes, seats, caps):
    every = sorted(((-v / (2 * s + 1), i, s) for i, (v, c) in enumerate(zip(votes, caps, strict=True)) for s in range(min(c, seats)) if v), key=lambda x: (x[0], x[1], x[2]))
    won = [i for _, i, _ in every[:seats]]
    return [won.count(i) for i in range(len(votes))]


@pytest.mark.parametrize(
    "votes, seats, caps",
    [
        ([random.Random(9).randint(0, 5000) for _ in range(23)], 137, None),
        ([60] + [0.4] * 100, 100, None),  # one large, many small: the large one gets 75
        ([40] + [0.6] * 100, 100, None),  # and here 33
        ([1.0] * 10, 7, None),  # ties go to the smallest keys
        ([3.0, 1.0, 1.0, 1.0], 3, None),
        ([0.0, 0.0], 5, None),
        ([10.0, 0.0, 5.0], 0, None),
        ([100.0] * 3 + [1.0] * 50, 40, [5] * 53),  # caps bind: the small ones get the rest
        ([1000.0, 10.0, 10.0], 20, [4, 9, 9]),
        ([1000.0, 10.0], 50, [4, 9]),  # fewer seats can be given than there are
        ([7.0] * 400 + [9000.0], 600, [3] * 400 + [400]),
    ],
)
def test_sainte_lague_gives_seats_by_highest_quotients(spark, votes, seats, caps):
    caps = caps or [10**6] * len(votes)
    df = spark.createDataFrame([(i, float(v), "g", seats, c) for i, (v, c) in enumerate(zip(votes, caps, strict=True))], "i int, v double, g string, seats long, cap long")
    got = {r["i"]: r["quota"] for r in mixing.sainte_lague(df, ["i"], ["g"], "v", "seats", "cap").collect()}
    assert [got[i] for i in range(len(votes))] == highest_quotients(votes, seats, caps)


def test_sainte_lague_on_random_skewed_votes(spark):
    rng = random.Random(21)
    rows, want = [], {}
    for g in range(60):
        n = rng.randint(1, 40)
        votes = [float(int(rng.paretovariate(0.4) * 3) % 100_000) if rng.random() < 0.8 else 1.0 for _ in range(n)]
        seats, caps = rng.randint(0, 300), [rng.choice([1, 3, 20, 1000]) for _ in range(n)]
        rows += [(g, i, v, seats, c) for i, (v, c) in enumerate(zip(votes, caps, strict=True))]
        want |= {(g, i): x for i, x in enumerate(highest_quotients(votes, seats, caps))}
    df = spark.createDataFrame(rows, "g int, i int, v double, seats long, cap long")
    assert {(r["g"], r["i"]): r["quota"] for r in mixing.sainte_lague(df, ["i"], ["g"], "v", "seats", "cap").collect()} == want


def test_small_sources_come_near_their_targets(spark):
    rows = [(i, "w " * 500, "big") for i in range(200)] + [(1000 + i, "w " * (13 if i % 2 else 5), f"s{i:03d}") for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert all(abs(r["taken"] - r["target"]) <= max(4, 0.01 * r["target"]) for r in got)
    assert abs(sum(r["taken"] - r["target"] for r in got)) <= 0.02 * sum(r["target"] for r in got)


def test_messy(messy, nothing):
    got = mixing.mix(messy).collect()
    assert len(got) == messy.count()
    assert all(r["taken"] <= 2 * r["size"] for r in got) and all(r["taken"] == 0 for r in got if r["doc_id"] in (2, 3, 4, 10))
    assert mixing.mix(nothing).count() == 0
    assert mixing.mix(messy.where(F.col("text").isNull())).first()["target"] == 0
