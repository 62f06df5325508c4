"""Exact nearest vectors with pruning by pivots and the triangle bound on angles.

A bounded sample gives the pivots, each the sample vector farthest from those
before.  Every vector is filed under its nearest pivot by its angle to it, in a
ring of ``pi / RINGS``; pivot and ring, split by a hash where they hold many
vectors, are a block.  The angle between a query and any vector of a block is at
least the gap between the query's angle to the pivot and the ring.

A search has two rounds.  First a query visits its nearest blocks that hold enough
vectors, which bounds the distance of its k-th nearest.  Then it visits all blocks
that the bound doesn't rule out, and takes from them what isn't beyond it.  Vectors and visiting queries meet in one shuffle
by block, sorted: a task holds one block's vectors, of bounded number, while its
queries stream by.  Vectors or queries without a direction, or of another length
than the pivots, are never ruled out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors that the pivots are chosen from; the most pivots; rings of one; vectors of one block.
SAMPLE, MOST_PIVOTS, RINGS, BLOCK = 8192, 1024, 64, 4096
#: Vectors that a query's first visits hold at least, for each one asked for; and of all vectors one in so many.  The bound
#: then lets about ``n * SHARE`` hits of a query through, however many blocks it visits.
FIRST, SHARE = 4, 16
#: Queries of a block that are compared at once.
QUERIES = 256
#: Pairs of a query and a block that are looked at at once.
PAIRS = 1 << 18
#: Bytes of vectors and visits that a task is given, about.
TASK = 64 << 20
FILED = "id long, cell long, g long, at int, embedding array<float>"
VISIT = "g long, at int, salt int, id long, cell long, embedding array<float>, most double"
HIT = "qid long, g long, id long, distance double"
AT = ["g", "at", "salt"]


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column as a matrix padded with zeros, and the lengths of its rows; null is empty."""
    rows = column.to_pylist() if column.null_count or column.flatten().null_count else None
    sizes = np.array([len(r or ()) for r in rows], np.int64) if rows is not None else np.diff(column.offsets.to_numpy())
    width = max(1, int(sizes.max(initial=0)))
    out = np.zeros((len(sizes), width), np.float32)
    if rows is None:
        out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    else:
        for i, r in enumerate(rows):
            out[i, : sizes[i]] = [0 if x is None else x for x in r or ()]
    return out, sizes


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half up by the shortest decimal, as Spark's round."""
    scaled = x * 10.0**digits
    out = np.floor(scaled + 0.5) / 10.0**digits
    for i in zip(*np.nonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6), strict=True):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def distances(q: np.ndarray, v: np.ndarray, q_dims: np.ndarray, v_dims: np.ndarray) -> np.ndarray:
    """1 - cosine of all pairs, summed in the order of the SQL fold; 1 where a vector has no length or the dimensions differ."""
    sums, nq, nv = np.zeros((len(q), len(v))), np.zeros(len(q)), np.zeros(len(v))
    q, v = q.astype(np.float64).T.copy(), v.astype(np.float64).T.copy()
    for x in q:
        nq += x * x
    for y in v:
        nv += y * y
    for x, y in zip(q, v, strict=False):
        sums += x[:, None] * y
    long = np.sqrt(nq)[:, None] * np.sqrt(nv)
    some = (q_dims[:, None] == v_dims) & (nq > 0)[:, None] & (nv > 0)
    return 1 - np.where(some, sums / np.where(some, long, 1), 0.0)


@dataclass
class Pivots:
    """Unit vectors of one length."""

    unit: np.ndarray

    def angles(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which rows have a direction and the pivots' length, their angles to all pivots)."""
        dims = self.unit.shape[1]
        full = np.zeros((len(rows), dims))
        full[:, : min(dims, rows.shape[1])] = rows[:, :dims]
        long = np.sqrt((full * full).sum(axis=1))
        able = (sizes == dims) & (long > 0) & np.isfinite(long)
        return able, np.arccos(np.clip(full[able] @ self.unit.T / long[able, None], -1, 1))


def fit(vectors: DataFrame, n: int) -> Pivots:
    """About sqrt(n) / 8 pivots for ``n`` vectors (id, embedding), from the ``SAMPLE`` of least hashed ids."""
    rows = [r[0] for r in vectors.where("size(embedding) > 0").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").collect()]
    lengths = [len(r) for r in rows]
    dims = max(set(lengths), key=lambda x: (lengths.count(x), x)) if lengths else 1
    u = np.array([[x or 0 for x in r] for r in rows if len(r) == dims], np.float64).reshape(-1, dims)
    long = np.sqrt((u * u).sum(axis=1))
    u = u[(long > 0) & np.isfinite(long)] / long[(long > 0) & np.isfinite(long), None]
    if not len(u):
        return Pivots(np.eye(1, dims))
    chosen, nearest = [0], u @ u[0]
    for _ in range(min(MOST_PIVOTS, len(u), max(1, int(np.sqrt(n) / 8))) - 1):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, u @ u[chosen[-1]])
    return Pivots(u[chosen])


def _file(pivots: Pivots) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            able, angles = pivots.angles(*matrix(batch.column(3)))
            at = np.full(batch.num_rows, -1, np.int32)
            if able.any():
                near = angles.argmin(axis=1)
                ring = np.minimum(RINGS - 1, angles[np.arange(len(near)), near] * (RINGS / np.pi))
                at[able] = near * RINGS + ring.astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(at), batch.column(3)], names=["id", "cell", "g", "at", "embedding"])

    return run


@dataclass
class Index:
    """Filed vectors (id, cell, g, at, salt, embedding), and what is known of their blocks: group, pivot and ring, vectors, parts."""

    filed: DataFrame
    pivots: Pivots
    g: np.ndarray
    at: np.ndarray
    n: np.ndarray
    parts: np.ndarray

    def gaps(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, blocks): the least angle that a block's vectors can have to a query, and the query's angle to its pivot."""
        able, angles = self.pivots.angles(rows, sizes)
        gap, to_pivot = np.zeros((len(rows), len(self.at))), np.zeros((len(rows), len(self.at)))
        known = self.at >= 0
        a = angles[:, self.at[known] // RINGS]
        low = (self.at[known] % RINGS) * (np.pi / RINGS)
        part = np.maximum(0, np.maximum(a - low - np.pi / RINGS, low - a) - 1e-9)
        gap[np.ix_(able, known)], to_pivot[np.ix_(able, known)] = part, a
        return gap, to_pivot


def index(vectors: DataFrame, grouped: bool = False) -> Index:
    """File ``vectors`` (id, cell, embedding); ``grouped``: blocks hold vectors of one cell, of which there may be few (dozens).

    To the driver come the sample and one row a block: at most pivots times rings, times cells if grouped.
    """
    pivots = fit(vectors, vectors.count())
    v = vectors.select(F.col("id").cast("long").alias("id"), F.col("cell").cast("long").alias("cell"), (F.col("cell") if grouped else F.lit(0)).cast("long").alias("g"), F.col("embedding").cast("array<float>").alias("embedding"))
    filed = v.mapInArrow(_file(pivots), FILED)
    blocks = sorted(tuple(r) for r in filed.groupBy("g", "at").agg(F.count("*").alias("n")).collect())
    g, at, n = (np.array([b[i] for b in blocks], np.int64) for i in range(3))
    parts = -(-n // BLOCK)
    many = vectors.sparkSession.createDataFrame([(int(x), int(y), int(p)) for x, y, p in zip(g, at, parts, strict=True) if p > 1], "g long, at int, parts long")
    filed = filed.join(F.broadcast(many), ["g", "at"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    return Index(filed, pivots, g, at, n, parts)


def _visits(known: dict, need: int | None, digits: int | None) -> Callable:
    """Queries (qid, cell, embedding, bounds) to the blocks that they visit; ``bounds``: (g, distance), none in the first round."""
    ix = Index(filed=None, **known)
    groups = [np.flatnonzero(ix.g == x) for x in np.unique(ix.g)]
    slack = 1e-6 if digits is None else 10.0**-digits

    of_group = [max(need or 0, -(-int(ix.n[of].sum()) // SHARE)) for of in groups]
    step = max(1, PAIRS // max(1, len(ix.at)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                gap, to_pivot = ix.gaps(*matrix(batch.column(2)))
                bounds = batch.column(3).to_pylist()
                rows, to, most = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
                for i in range(batch.num_rows):
                    bound = {x["g"]: x["distance"] for x in bounds[i] or ()}
                    for of, enough in zip(groups, of_group, strict=True):
                        tau = None if need is not None else bound.get(int(ix.g[of[0]]))
                        if need is not None:
                            order = of[np.lexsort((to_pivot[i, of], gap[i, of]))]
                            go = order[: int(np.searchsorted(np.cumsum(ix.n[order]), enough)) + 1]
                        else:
                            go = of if tau is None else of[gap[i, of] <= np.arccos(np.clip(1 - tau - slack, -1, 1)) + 1e-6]
                        rows.append(np.full(len(go), i))
                        to.append(go)
                        most.append(np.full(len(go), np.inf if tau is None else tau))
                rows, to, most = np.concatenate(rows), np.concatenate(to), np.concatenate(most)
                times = ix.parts[to]
                salt = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                rows, to, most = np.repeat(rows, times), np.repeat(to, times), np.repeat(most, times)
                for a in range(0, len(rows), 10_000):
                    part = slice(a, a + 10_000)
                    r, t = pa.array(rows[part]), to[part]
                    cols = [pa.array(ix.g[t]), pa.array(ix.at[t].astype(np.int32)), pa.array(salt[part].astype(np.int32)), *(batch.column(c).take(r) for c in range(3)), pa.array(most[part])]
                    yield pa.RecordBatch.from_arrays(cols, names=["g", "at", "salt", "id", "cell", "embedding", "most"])

    return run


def _meet(n: int, digits: int | None, unlike: bool) -> Callable:
    """(g, at, salt, asks, id, cell, embedding, most) sorted by block, vectors before queries, to each query's ``n`` nearest of the block that aren't beyond ``most``."""

    def hits(g, block, ids, cells, q, most):
        v_ids, v_cells, v_rows, v_sizes = block
        d = distances(q[0], v_rows, q[1], v_sizes)
        d = d if digits is None else rounded(d, digits)
        if unlike:
            d[cells[:, None] == v_cells] = np.inf
        best = np.argsort(d, axis=1, kind="stable")[:, :n]  # ids rise inside a block
        d, near, who = np.take_along_axis(d, best, 1).ravel(), v_ids[best].ravel(), np.repeat(ids, best.shape[1])
        some = np.isfinite(d) & (d <= np.repeat(most, best.shape[1]))
        return pa.RecordBatch.from_arrays([pa.array(who[some]), pa.array(np.full(some.sum(), g)), pa.array(near[some]), pa.array(d[some])], names=["qid", "g", "id", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, pieces, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            cut = np.flatnonzero((np.diff(key, axis=1) != 0).any(axis=0)) + 1
            for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                at, asks = tuple(key[:3, a]), key[3, a]
                if at != here:
                    here, pieces, block = at, [], None
                ids, cells = (batch.column(i).slice(a, b - a).to_numpy(zero_copy_only=False) for i in (4, 5))
                rows, sizes = matrix(batch.column(6).slice(a, b - a))
                if not asks:
                    pieces.append((ids, cells, rows, sizes))
                    continue
                if block is None and pieces:
                    width = max(p[2].shape[1] for p in pieces)
                    wide = [np.pad(p[2], ((0, 0), (0, width - p[2].shape[1]))) for p in pieces]
                    joined = [np.concatenate([p[i] for p in pieces]) for i in (0, 1)] + [np.concatenate(wide), np.concatenate([p[3] for p in pieces])]
                    order = np.argsort(joined[0], kind="stable")
                    block = tuple(x[order] for x in joined)
                if block is not None:
                    most = batch.column(7).slice(a, b - a).to_numpy(zero_copy_only=False)
                    for c in range(0, b - a, QUERIES):
                        part = slice(c, c + QUERIES)
                        yield hits(here[0], block, ids[part], cells[part], (rows[part], sizes[part]), most[part])

    return run


def _ranked(hits: DataFrame, keys: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("distance", "id")
    return hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)


def visits(ix: Index, queries: DataFrame, n: int, digits: int | None = None, mode: str = "all") -> DataFrame:
    """Which blocks the queries (qid, cell, embedding) visit in the second round, and how far: (g, at, salt, id, cell, embedding, most)."""
    known = {"pivots": ix.pivots, "g": ix.g, "at": ix.at, "n": ix.n, "parts": ix.parts}
    none = F.lit(None).cast("array<struct<g:long,distance:double>>").alias("bounds")
    q = queries.select(F.col("qid").cast("long").alias("qid"), F.col("cell").cast("long").alias("cell"), F.col("embedding").cast("array<float>").alias("embedding"))
    first = met(ix, q.select("*", none).mapInArrow(_visits(known, n * FIRST, digits), VISIT), n, digits, mode)
    far = _ranked(first, ["qid", "g"], n).where(F.col("_r") == n).select(F.col("qid").alias("_q"), F.struct("g", "distance").alias("b"))
    q = q.join(far.groupBy("_q").agg(F.collect_list("b").alias("bounds")), F.col("qid") == F.col("_q"), "left").select("qid", "cell", "embedding", "bounds")  # one bound a group
    return q.mapInArrow(_visits(known, None, digits), VISIT)


def met(ix: Index, visiting: DataFrame, n: int, digits: int | None, mode: str, queries: int = 0) -> DataFrame:
    """The hits of the ``visiting`` queries, of which there are at most ``queries``."""
    side = lambda df, asks, most: df.select(*AT, F.lit(asks).alias("asks"), "id", "cell", "embedding", most.alias("most"))
    rows = side(ix.filed, 0, F.lit(None).cast("double")).unionByName(side(visiting, 1, F.col("most")))
    # What a task sorts is bounded where the visits outgrow the input; one block's visits stay together.
    tasks = -(-(int(ix.n.sum()) + queries * int(ix.parts.sum())) * (4 * ix.pivots.unit.shape[1] + 64) // TASK)
    many = min(tasks, int(ix.parts.sum())) > ix.filed.sparkSession.sparkContext.defaultParallelism
    rows = (rows.repartition(min(tasks, int(ix.parts.sum())), *AT) if many else rows.repartition(*AT)).sortWithinPartitions(*AT, "asks")
    return rows.mapInArrow(_meet(n, digits, mode == "unlike"), HIT)


def nearest(queries: DataFrame, vectors: DataFrame, n: int, digits: int | None = None, mode: str = "all") -> DataFrame:
    """(qid, g, id, distance): every query's ``n`` nearest by distance (1 - cosine, rounded to ``digits``), then id.

    ``queries``: qid, cell, embedding; ``vectors``: id, cell, embedding, both with
    whole-number ids and cells.  ``mode``: "all" vectors; "each", the nearest of
    every cell ``g``; "unlike", the nearest of another cell than the query's.  Null
    and empty embeddings have distance 1 to all.
    """
    ix = index(vectors, mode == "each")
    if not len(ix.at):
        return vectors.sparkSession.createDataFrame([], HIT)
    return _ranked(met(ix, visits(ix, queries, n, digits, mode), n, digits, mode, queries.count()), ["qid", "g"] if mode == "each" else ["qid"], n).drop("_r")
