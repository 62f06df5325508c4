"""Connected components of an edge table: distributed union-find.

Each partition first contracts its own edges to a forest of stars (a union-find
over numpy arrays, batch by batch).  What is left is joined across partitions by
alternating large-star and small-star steps: every node hands its neighbours to
the least node it knows.  A step uses min aggregates (combined before the
shuffle) and joins, so a hub's neighbours are never gathered in one task.  Each
round is written to the shared folder; nothing but a count and a checksum
reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.store import dropped, stored

EDGE = "u long, v long"


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the components of the edges (u, v); the root is the least node, and roots are left out."""
    if not len(u):
        return u, v
    ids, inv = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inv[: len(u)], inv[len(u) :]
    root = np.arange(len(ids))
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    child = root != np.arange(len(ids))
    return ids[child], ids[root[child]]


def _contract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u = v = np.empty(0, np.int64)
    for batch in batches:
        u = np.concatenate([u, batch.column(0).to_numpy(zero_copy_only=False)])
        v = np.concatenate([v, batch.column(1).to_numpy(zero_copy_only=False)])
        u, v = contract(u, v)
        if len(u) > 2_000_000:  # bounds the state: what is known so far goes out as stars
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
            u = v = np.empty(0, np.int64)
    if len(u):
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (two long columns) that isn't the least of its component.

    Loops, repeated edges and nulls (dropped) are fine; without edges the result is empty.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").mapInArrow(_contract_batches, EDGE)
    e = stored(e.distinct(), "edges")
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(least, F.col("u") == F.col("k")).select("u", "v", "m")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u != v").distinct()
        nxt = stored(small, "edges")
        new = _state(nxt)
        dropped(e)
        e = nxt
        if new == state:
            break
        state = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
