import random

import numpy as np
from pyspark.sql import functions as F

from quern.llm import linededup as ld


def shingles(x):
    x = x.strip(" ").lower()
    return {x[i : i + ld.SHINGLE] for i in range(len(x) - ld.SHINGLE + 1)}


def brute(docs):
    """Lines to remove, by comparing all pairs."""
    lines = [(d, i, x) for d, t in docs if t for i, x in enumerate(t.split("\n")) if len(x.strip(" ")) >= ld.MIN_CHARS]
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [shingles(x) for _, _, x in lines]
    for i in range(len(lines)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= ld.SIMILARITY * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    first = {}
    for i, (d, k, _) in enumerate(lines):
        first[find(i)] = min(first.get(find(i), (d, k)), (d, k))
    return {(d, k) for i, (d, k, _) in enumerate(lines) if first[find(i)] != (d, k)}


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    pool = [" ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(60)]
    out = []
    for d in range(n):
        lines = []
        for _ in range(rng.randint(1, 8)):
            x = rng.choice(pool) if rng.random() < 0.6 else " ".join(word() for _ in range(rng.randint(1, 40)))
            w = x.split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = word()
            lines.append(rng.choice(["", " "]) + " ".join(w).capitalize())
        out.append((d, "\n".join(lines)))
    return out


def test_recall_and_precision_against_brute_force(spark):
    docs = corpus(1, 250)
    got = {tuple(r) for r in ld.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    want = brute(docs)
    assert len(want) > 300
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_banding_recall_at_the_threshold():
    rng = random.Random(2)
    found = total = 0
    while total < 150:
        a = [rng.choice("abcdefghijklmnop ") for _ in range(300)]
        b = list(a)
        for k in rng.sample(range(300), 5):
            b[k] = "z"
        a, b = "".join(a).strip(), "".join(b).strip()
        j = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        if 0.8 <= j <= 0.86:
            total += 1
            keys = ld.band_keys([a, b])
            found += bool((keys[0] == keys[1]).any())
    assert found >= 0.96 * total


def test_a_large_group_of_near_copies(spark):
    base = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(i, base + f" end{i}") for i in range(1500)], "doc_id long, text string")
    assert ld.repeated_lines(docs).count() == 1499


def test_large_groups_are_split_without_losing_links(spark, monkeypatch):
    """Templates with small and large changes, chains of small steps, in groups far beyond the size of a task."""
    monkeypatch.setattr(ld, "CENTRES", 3)
    plain, called = ld.split_group_links, []
    monkeypatch.setattr(ld, "split_group_links", lambda *a: called.append(a) or plain(*a))
    rng = random.Random(14)
    base = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40)) for _ in range(2)]
    docs = []
    for i in range(400):
        w = rng.choice(base).split()
        for k in rng.sample(range(len(w)), rng.choice((1, 2, 4, 9))):
            w[k] = "".join(rng.choice("xyz") for _ in range(6))
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    split, whole = ({tuple(r) for r in ld.repeated_lines(df, most=m).collect()} for m in (10, 5000))
    assert len(whole) > 100 and split == whole and len(called) == 1
    assert len(brute(docs) ^ split) <= 0.03 * len(docs)


def test_links_need_no_common_centre():
    x = "".join(chr(97 + i % 26) + str(i) for i in range(200))
    lines = [x[: len(x) - k * 40] for k in range(4)]
    near = ld.jaccard_links([0, 1, 2, 3], ld.line_sets(lines), 0.8)
    ids = {0, 1, 2, 3}
    assert len(near) <= 3 and {i for p in near for i in p} <= ids


def test_messy(messy, nothing):
    out = ld.without_repeated_lines(messy)
    rows = out.collect()
    assert len(rows) == messy.count() and set(out.columns) == set(messy.columns)
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["text"] is None and by[3]["text"] == "" and by[8]["lines_removed"] == 0
    assert by[9]["text"] == "other words here"
    assert ld.without_repeated_lines(nothing).count() == 0


def test_unicode_counts_code_points():
    assert len(ld.shingle_hashes(np.frombuffer("é\U0001f600日本語ab".encode("utf-32-le"), np.uint32))) == 2


def test_plain_query_counts(spark):
    docs = spark.createDataFrame([(1, "x" * 40 + "\nshort"), (2, "x" * 40)], "doc_id long, text string")
    got = {r["doc_id"]: r["lines_removed"] for r in ld.without_repeated_lines(docs).select("doc_id", F.col("lines_removed")).collect()}
    assert got == {1: 0, 2: 1}


def test_exact_repeats_of_short_lines_go(spark):
    docs = spark.createDataFrame([(1, "Read more\n\n \t\n短い文です。\n}"), (2, " read more \n\n \t\n短い文です。\nread mode\n}\n}"), (None, "read more")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in ld.without_repeated_lines(docs).collect()}
    assert got == {1: ("Read more\n\n \t\n短い文です。\n}", 0), 2: ("\n \t\nread mode", 4), None: ("read more", 0)}
