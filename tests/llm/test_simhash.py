import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from quern.llm import simhash
from quern.llm.components import components, contract


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints():
    for t in [None, "", "One", "One two", "One TWO three", "À la ÀB c d e f", "a\x0bb\tc\nd  e", "x " * 3000]:
        assert simhash.fingerprint(t) & (2**64 - 1) == slow_fingerprint(t)


@pytest.mark.parametrize("levels", [8, 16, 32])
def test_components_equal_brute_force(spark, levels):
    rng = random.Random(levels)
    fps = [0, 2**64 - 1]
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            fps.append(base)
            for _ in range(rng.randint(0, 4)):
                base ^= 1 << rng.randrange(64)
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    found = {r["node"]: r["root"] for r in components(simhash.near_fingerprints(df, levels=levels)).collect()}
    mine = defaultdict(set)
    for x in signed:
        mine[found.get(x, x)].add(x)
    want = defaultdict(set)
    for x, g in zip(signed, slow_groups(fps), strict=True):
        want[g].add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_dense_leaf_hands_on_a_forest(spark):
    fps = [(a << 40) | b for a in range(2) for b in [1 << i | 1 << j for i in range(12) for j in range(i)]]
    df = spark.createDataFrame([(x,) for x in fps], "fp long").coalesce(1)
    assert simhash.near_fingerprints(df).count() < 40 * len(fps)
    assert len({r["root"] for r in components(simhash.near_fingerprints(df)).collect()}) == len(set(slow_groups(fps)))


def test_contract():
    node, root = contract(np.array([5, 3, 9]), np.array([3, 1, 8]))
    assert dict(zip(node.tolist(), root.tolist(), strict=True)) == {3: 1, 5: 1, 9: 8}


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long").repartition(7)
    got = components(edges).collect()
    assert {r["root"] for r in got} == {0} and len(got) == 300


def test_messy(messy, nothing):
    rows = simhash.near_duplicates(messy).collect()
    assert len(rows) == messy.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["fp"] == by[3]["fp"] == by[4]["fp"] == by[10]["fp"] == 0 and by[10]["component_id"] == 2
    assert by[5]["component_id"] == 1
    kept = simhash.one_per_group(messy)
    assert kept.columns == messy.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 6, 7, 8, 9, 11] and ids.count(None) == 1
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.one_per_group(nothing).count() == 0


def test_repeated_ids_leave_one_row(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "q r s t")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.one_per_group(docs).collect()) == [1, 2]
