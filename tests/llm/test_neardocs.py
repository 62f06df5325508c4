import random

import corpus_pipeline as cp
from quern.llm import neardocs


def jaccard(a, b):
    a, b = ({tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies_at_the_threshold_go(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    docs, want, near = [], set(), 0
    for i in range(120):
        a = [word() for _ in range(rng.randint(80, 300))]
        b = list(a)
        for k in rng.sample(range(len(b)), max(1, round(len(b) * rng.choice((0.01, 0.02, 0.08))))):
            b[k] = word()
        docs += [(2 * i, " ".join(a), "en", "s", 1), (2 * i + 1, " ".join(b), "en", "s", 1)]
        want |= {2 * i}
        if jaccard(docs[-1][1], docs[-2][1]) < 0.8:
            want |= {2 * i + 1}
        else:
            near += 1
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in cp.near_dedup(spark, df, "").collect()}
    assert 40 < near < 120 and len(got - want) <= 0.03 * near
    assert len(want - got) <= 2  # SimHash may link a few pairs below the threshold


def test_shingles_of_short_texts():
    assert [len(neardocs.shingle_set(t)) for t in (None, " ", "a", "a b c d", "a b c d e f")] == [0, 0, 1, 1, 2]


def test_groups_of_long_texts_are_split_by_bytes(spark, monkeypatch):
    """One group of near copies of long texts: tasks hold a bounded number of bytes, and the group stays whole."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(9000)}" for _ in range(1500)]
    rows = []
    for i in range(300):
        words = list(base)
        for k in rng.sample(range(len(words)), 5):
            words[k] = f"v{i}x{k}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"u{rng.randrange(9000)}" for _ in range(200))) for i in range(30)]
    texts = spark.createDataFrame(rows, "h long, text string")
    split, seen = neardocs.linededup.split_group_links, []

    def watched(members, verified, most, label):
        seen.append(members.agg({"weight": "max", "n": "max"}).first())
        return split(members, verified, most, label)

    monkeypatch.setattr(neardocs.linededup, "split_group_links", watched)
    size = len(rows[0][1])
    links = neardocs.similar_texts(texts, most_bytes=20 * size)
    roots = {r["node"]: r["root"] for r in neardocs.components(links).collect()}
    assert seen and seen[0]["max(weight)"] > 20 and seen[0]["max(n)"] > 2 * neardocs.MOST
    assert {roots.get(i, i) for i in range(300)} == {0} and not any(i >= 1000 for i in roots)
