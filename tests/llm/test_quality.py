import numpy as np

from quern.llm import quality


def test_slots_are_the_distinct_ngrams():
    a, b, c = quality.ngram_slots(["abcab", "", "ab"])
    assert len(a) == 3 + 3 + 3 and len(b) == 0 and len(c) == 3 and set(c) <= set(a)
    assert len(set(a)) == len(a)


def test_hinge_solution_is_optimal():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 40, 12)) for _ in range(80)]
    y = np.array([1.0 if 3 in r or 5 in r else -1.0 for r in rows])
    m = quality.fit(rows, y, c=1.0, rounds=2000, tolerance=1e-8)

    def loss(w, bias):
        f = 0.5 * (w @ w + bias * bias)
        for ids, t in zip(rows, y, strict=True):
            x = m.ratio[ids]
            f += max(0.0, 1 - t * (w[ids] @ x / np.sqrt(x @ x) + bias))
        return f

    best = loss(m.weight, m.bias)
    for _ in range(30):
        step = np.zeros_like(m.weight)
        step[:40] = 0
        ids = rows[rng.integers(80)]
        step[ids] = rng.normal(size=len(ids)) * 0.05
        assert loss(m.weight + step, m.bias + rng.normal() * 0.02) >= best - 1e-6


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 3 != 0"))
    got = quality.scored(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_scores_equal_those_of_a_plain_version(spark):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcdé \n")) for _ in range(rng.integers(0, 200))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("a" in t)) for i, t in enumerate(texts)], "doc_id long, quality int")
    model = quality.train(docs, labels)

    def slot(gram):
        h = 0
        for n, c in enumerate(gram, 1):
            h = (h * 0x9E3779B97F4A7C15 + ord(c) + n) % 2**64
        return ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9 % 2**64) >> (64 - quality.SLOTS_BITS)

    got = {r["doc_id"]: r["score"] for r in quality.scored(docs, model).collect()}
    for i, t in enumerate(texts):
        slots = {slot(t[k : k + n]) for n in (1, 2, 3) for k in range(len(t) - n + 1)}
        norm = sum(model.ratio[x] ** 2 for x in slots) ** 0.5
        margin = model.bias + (sum(model.ratio[x] * model.weight[x] for x in slots) / norm if norm else 0)
        assert abs(got[i] - 1 / (1 + np.exp(-(model.curve[0] * margin + model.curve[1])))) < 1e-9


def test_scores_are_calibrated(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 3 != 0"))
    got = quality.scored(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").select("score", "quality").toPandas()
    assert abs(got["score"].mean() - got["quality"].mean()) < 0.03
    sure = got["quality"].where(got["score"] > 0.5, 1 - got["quality"])
    assert abs(np.maximum(got["score"], 1 - got["score"]).mean() - sure.mean()) < 0.03


def test_messy(spark, messy, nothing):
    labels = spark.createDataFrame([(1, 1), (6, 0), (6, 0), (2, 1), (None, 1), (8, None), (77, 0)], "doc_id long, quality int")
    model = quality.train(messy, labels)
    rows = quality.scored(messy, model).collect()
    assert len(rows) == messy.count()
    assert len({r["score"] for r in rows if r["doc_id"] in (2, 3)}) == 1
    none = quality.train(nothing, labels)
    assert {r["score"] for r in quality.scored(messy, none).collect()} == {0.5}
    one = quality.train(messy, labels.where("quality = 1"))
    assert {r["predicted"] for r in quality.scored(messy, one).collect()} == {1}
    assert quality.scored(nothing, model).count() == 0
