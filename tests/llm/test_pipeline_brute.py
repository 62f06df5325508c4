"""run() against a plain version of all its stages on a made-up corpus."""

import math
import random
import re

import duckdb

import corpus_pipeline as cp
from quern.llm import linededup as ld
from quern.llm import mixing, simhash
from tests.llm.test_decontam import any_window
from tests.llm.test_linededup import brute as removed_lines
from tests.llm.test_rules import brute as base_measures

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    items = [line(n) for n in (12, 18, 30)]
    shared, texts = [line(15) for _ in range(4)], []
    for i in range(90):
        lines = [line(rng.randint(12, 25)) for _ in range(rng.randint(4, 7))]
        if i % 6 == 0:
            lines.insert(rng.randrange(len(lines)), rng.choice(shared))
        if i % 9 == 1:
            item = rng.choice(items).split()
            item[rng.randrange(len(item))] = word()
            lines.insert(1, "as said " + " ".join(item) + " before")
        if i % 10 == 2:
            lines = [line(20)]  # too short
        if i % 10 == 3:
            lines = [line(3)] * 40  # repeats itself
        if i % 10 == 4:
            lines = ["$$ %% ## " * 9 + x for x in lines]
        texts.append("\n".join(lines))
    for i in range(0, 40, 4):  # near copies on one line, so that no line is equal
        w = texts[i].replace("\n", " ").split()
        for k in range(5, len(w), 40):
            w[k] = word()
        texts.append(" ".join(w))
    texts += [texts[7], "", "short"]
    return [(i, t, "en", rng.choice(["a", "a", "a", "b", "c"]), len(t)) for i, t in enumerate(texts)], [(i, t) for i, t in enumerate(items)]


def kept_by_rules(text):
    n, chars, symbols, dups, _, failed = base_measures(text)
    lines = [x for x in text.split("\n") if x.strip()]
    upper, bangs = len(re.findall("[A-Z]", text)), len(re.findall("[!?]{2}", text))
    return not (failed or 10 * symbols > 3 * n or 2 * upper > chars or 5 * bangs > n or (2 * dups > len(lines) and dups > 1) or chars < 2 * n or chars > 25 * n)


def one_per_group(docs):
    shingles = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    sets, prints = [shingles(t) for _, t, *_ in docs], [simhash.fingerprint(t) for _, t, *_ in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) or ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [d for i, d in enumerate(docs) if find(i) == i]


def test_run_equals_a_plain_version(spark, tmp_path):
    rows, items = corpus(random.Random(12))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {tuple(r) for r in cp.run(spark, str(tmp_path)).collect()}

    docs = [r for r in rows if kept_by_rules(r[1])]
    gone = removed_lines([(r[0], r[1]) for r in docs])
    assert len(docs) < len(rows) and gone and all(len(x.strip()) >= ld.MIN_CHARS for r in docs for x in r[1].split("\n"))
    cut = [(r[0], "\n".join(x for i, x in enumerate(r[1].split("\n")) if (r[0], i) not in gone), *r[2:]) for r in docs]
    docs = [r for r in cut if r[1].split()]
    few = one_per_group(docs)
    clean = [r for r in few if not any(any_window(r[1], t) for _, t in items)]
    assert len(clean) < len(few) < len(docs)

    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", clean)
    want = {tuple(r) for r in db.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.OP4_SQL})").fetchall()}
    assert {r[:3] for r in got} == {r[:3] for r in want}
    assert all(math.isclose(a[3], b[3]) and a[4] == b[4] for a, b in zip(sorted(got), sorted(want), strict=True))
