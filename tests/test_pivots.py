"""The pruned search against all pairs, and what it skips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import pivots

V = "id long, cell long, embedding array<float>"
Q = "qid long, cell long, embedding array<float>"


def rows_of(ids, cells, vectors):
    return [(int(i), int(c), None if v is None else [float(np.float32(x)) for x in v]) for i, c, v in zip(ids, cells, vectors, strict=True)]


def brute(queries, vectors, n, digits, mode):
    out = []
    for qid, qc, q in queries:
        hits = {}
        for i, c, v in vectors:
            if mode == "unlike" and c == qc:
                continue
            a, b = np.array(q or [], np.float64), np.array(v or [], np.float64)
            same = len(a) == len(b) and np.sqrt((a * a).sum()) > 0 and np.sqrt((b * b).sum()) > 0
            dist = 1 - (a @ b / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())) if same else 0.0)
            hits.setdefault(c if mode == "each" else 0, []).append((round(dist, digits), i))
        out += [(qid, g, i, d) for g, h in hits.items() for d, i in sorted(h)[:n]]
    return sorted(out)


def search(spark, queries, vectors, n, mode, digits=5):
    got = pivots.nearest(spark.createDataFrame(queries, Q), spark.createDataFrame(vectors, V), n, digits, mode).collect()
    return sorted((r.qid, r.g, r.id, round(r.distance, digits)) for r in got)


def close(got, want):
    """The same hits; ranks may change between two whose rounded distances differ by one unit of the last digit."""
    assert [(q, g) for q, g, _, _ in got] == [(q, g) for q, g, _, _ in want]
    per = lambda rows: {k: sorted(d for q, g, _, d in rows if (q, g) == k) for k in {(q, g) for q, g, _, _ in rows}}
    a, b = per(got), per(want)
    assert all(np.allclose(a[k], b[k], atol=2e-5) for k in b)
    assert len(set(got) - set(want)) <= len(want) // 100


def clustered(rng, n, centres, dims=16, spread=0.05):
    c = rng.normal(size=(centres, dims))
    return c[rng.integers(0, centres, n)] + rng.normal(size=(n, dims)) * spread


@pytest.mark.parametrize("mode", ["all", "each", "unlike"])
def test_as_all_pairs(spark, monkeypatch, mode):
    """Clusters, copies, vectors without a direction, without values, of other lengths; blocks split by a hash."""
    monkeypatch.setattr(pivots, "BLOCK", 20)
    rng = np.random.default_rng(3)
    v = [*clustered(rng, 400, 12), *[[1.0] * 16] * 60, [0.0] * 16, None, [], [1.0, 2.0], [2.0, 4.0], [-1.0] * 16]
    vectors = rows_of(range(len(v)), rng.integers(0, 3, len(v)), v)
    q = [vectors[i][2] for i in (0, 5, 77, 200, 410)] + [[0.0] * 16, None, [1.0, 2.0], [3.0] * 16]
    queries = rows_of(range(1000, 1000 + len(q)), rng.integers(0, 3, len(q)), q)
    close(search(spark, queries, vectors, 7, mode), brute(queries, vectors, 7, 5, mode))


def test_fewer_vectors_than_asked_for_and_none(spark):
    vectors = rows_of(range(4), [0] * 4, [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [-1.0, 0.0]])
    queries = rows_of([9], [0], [[1.0, 0.1]])
    assert [r[2] for r in sorted(search(spark, queries, vectors, 10, "all"), key=lambda r: r[3])] == [0, 2, 1, 3]
    assert search(spark, queries, [], 3, "all") == [] and search(spark, [], vectors, 3, "all") == []
    only_zero = rows_of(range(3), [0] * 3, [[0.0, 0.0]] * 3)
    assert [r[2] for r in search(spark, queries, only_zero, 2, "all")] == [0, 1]


def share(spark, v, n_queries, k=10):
    vectors = spark.createDataFrame(rows_of(range(len(v)), [0] * len(v), v), V)
    queries = vectors.where(F.col("id") < n_queries).select(F.col("id").alias("qid"), "cell", "embedding")
    ix = pivots.index(vectors)
    pairs = pivots.visits(ix, queries, k, 6).join(ix.filed.groupBy(*pivots.AT).count(), pivots.AT).agg(F.sum("count")).first()[0]
    return pairs / (n_queries * len(v))


def test_blocks_that_cannot_matter_are_skipped(spark):
    rng = np.random.default_rng(4)
    assert share(spark, clustered(rng, 20_000, 200, spread=0.02), 50) < 0.1


def test_split_blocks_stay_bounded(spark):
    """A third of all vectors are the same one: no block holds more than a few times ``BLOCK``."""
    rng = np.random.default_rng(5)
    v = np.concatenate([np.ones((9000, 8)), rng.normal(size=(3000, 8))])
    ix = pivots.index(spark.createDataFrame(rows_of(range(len(v)), [0] * len(v), v), V))
    most = ix.filed.groupBy(*pivots.AT).count().agg(F.max("count")).first()[0]
    assert most < 1.5 * pivots.BLOCK and ix.filed.count() == len(v)


def test_a_batch_of_queries_is_looked_at_in_slices():
    """Queries times blocks are bounded in memory: 4000 queries to 8000 blocks would take a gigabyte in one piece."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    blocks, asked, dims = 8000, 4000, 4
    r = np.random.default_rng(1)
    unit = r.normal(size=(125, dims))
    known = {"pivots": pivots.Pivots(unit / np.linalg.norm(unit, axis=1)[:, None]), "g": np.zeros(blocks, np.int64), "at": np.arange(blocks), "n": np.full(blocks, 10), "parts": np.ones(blocks, np.int64)}
    rows = pa.array(r.normal(size=(asked, dims)).astype(np.float32).tolist(), pa.list_(pa.float32()))
    bounds = pa.array([[{"g": 0, "distance": 0.0}]] * asked, pa.list_(pa.struct([("g", pa.int64()), ("distance", pa.float64())])))
    batch = pa.RecordBatch.from_arrays([pa.array(range(asked)), pa.array([0] * asked), rows, bounds], names=["qid", "cell", "embedding", "bounds"])
    tracemalloc.start()
    n = sum(b.num_rows for b in pivots._visits(known, None, 6)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n >= asked and peak < 100_000_000


def test_hits_beyond_the_bound_stay_behind(spark):
    """In the second round a query takes about ``SHARE`` times its ``n`` hits, not ``n`` of every block."""
    import numpy as np

    r = np.random.default_rng(2)
    v = r.normal(size=(20_000, 8))
    vectors = spark.createDataFrame(rows_of(range(len(v)), [0] * len(v), v), V)
    queries = vectors.where("id < 40").withColumnRenamed("id", "qid")
    ix = pivots.index(vectors)
    hits = pivots.met(ix, pivots.visits(ix, queries, 50, 6), 50, 6, "all", 40).count()
    assert 40 * 50 <= hits < 40 * 50 * 2 * pivots.SHARE
    of_blocks = pivots.met(ix, pivots.visits(ix, queries, 50, 6).withColumn("most", F.lit(float("inf"))), 50, 6, "all", 40).count()
    assert hits < of_blocks
