"""SimHash near-duplicates found with vantage-point trees.

A fingerprint's 64 bits are two halves.  Two fingerprints that differ in at most
three bits differ in at most one bit of some half, so each half has a tree that
is searched with radius 1.  A level of a tree looks at one slice of the half:
its vantage point is a fixed bit pattern, and a fingerprint goes to the branch
numbered by its Hamming distance to that pattern inside the slice.  The slices
are disjoint, so their distances add up; by the triangle inequality two
fingerprints at half-distance 1 have the same branch numbers but for one level,
where they differ by one.  All other branches are pruned.

The branch numbers of all levels name a leaf; leaves are the shards.  Every
fingerprint lives in its home leaf and visits, as a query, those leaves that its
ball overlaps (one branch further on one level; the branch before is covered
from the other side).  In a leaf, homes meet the rows after them, exactly.  The
trees get more levels as the table grows, so that leaves stay small.

Only distinct fingerprints enter the trees, and a leaf hands on a forest of the
links that it found, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quern.llm.components import components, contract
from quern.llm.store import packed, stored, unpacked

#: One vantage point per half.
VANTAGE = (0x9E3779B9, 0x7F4A7C15)
RADIUS = 3
#: Levels of a tree, by how many fingerprints its fullest leaf may hold at home.
LEVELS, LEAF = (8, 16, 32), 4096
PAIRS = 2_000_000


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the text's word shingles as a signed 64-bit integer; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and ASCII white space
    n = len(words)
    if not n:
        return 0
    if n < shingle:
        grams, m = [b" ".join(words)], 1
    else:
        m = n - shingle + 1
        grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    ones, done = np.zeros(64, np.int64), 0
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, m)
    while done < m:  # in blocks, so that a very long text doesn't take 64 bytes a shingle at once
        part = hashes[done : done + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
        done += len(part)
    bits = (2 * ones > m).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


@F.pandas_udf(LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def _rings(fp: Column, tree: int, levels: int) -> list[Column]:
    """Per level, the Hamming distance to the vantage point inside the level's slice."""
    width = 32 // levels
    half = F.shiftrightunsigned(fp, 32) if tree else fp.bitwiseAND(F.lit(0xFFFFFFFF))
    return [F.bit_count(half.bitwiseXOR(F.lit(VANTAGE[tree])).bitwiseAND(F.lit(((1 << width) - 1) << (width * i)))) for i in range(levels)]


def _home(fp: Column, tree: int, levels: int) -> Column:
    """The leaf: branch numbers as digits to the base width + 1."""
    base, cell = 32 // levels + 1, F.lit(0).cast("long")
    for i, ring in enumerate(_rings(fp, tree, levels)):
        cell = cell + ring.cast("long") * F.lit(base**i)
    return cell


def _placed(fps: DataFrame, levels: int) -> DataFrame:
    """(tree, cell, query, fp): each fingerprint at home and in the leaves that its ball overlaps."""
    base, width, places = 32 // levels + 1, 32 // levels, []
    for tree in (0, 1):
        rings, home = _rings(F.col("fp"), tree, levels), _home(F.col("fp"), tree, levels)
        up = [F.when(r < width, F.lit(base**i)) for i, r in enumerate(rings)]
        steps = F.array_compact(F.array(F.lit(0).cast("long"), *[u.cast("long") for u in up]))
        places.append(fps.select(F.lit(tree).cast("byte").alias("tree"), "fp", home.alias("home"), F.explode(steps).alias("step")))
    both = places[0].unionByName(places[1])
    return both.select("tree", (F.col("home") + F.col("step")).alias("cell"), (F.col("step") > 0).alias("query"), "fp")


def _links(tree: np.ndarray, cell: np.ndarray, query: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links inside the leaves of rows sorted by tree, cell, query."""
    n = len(fp)
    new = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (tree[1:] != tree[:-1])])
    end = np.repeat(np.r_[new[1:], n], np.diff(np.r_[new, n]))
    homes = np.flatnonzero(~query)
    count = end[homes] - homes - 1
    homes, count = homes[count > 0], count[count > 0]
    total, at = np.cumsum(count), 0
    us, vs = [], []
    while at < len(homes):
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + PAIRS, side="right")))
        c = count[at:to]
        i = np.repeat(homes[at:to], c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        near = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        u, v = contract(fp[i[near]].view(np.int64), fp[j[near]].view(np.int64))
        us.append(u)
        vs.append(v)
        at = to
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.empty(0, np.int64), np.empty(0, np.int64))


def _search(radius: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # pieces of the leaf that may go on in the next batch

        def links(pieces):
            tree, cell, query, fp = (np.concatenate(c) if len(c) > 1 else c[0] for c in zip(*pieces, strict=True))
            u, v = _links(tree, cell, query.astype(bool), fp.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            cols = [np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in range(4)]
            tree, cell = cols[:2]
            if not len(cell):
                continue
            if held and (held[-1][0][-1] != tree[0] or held[-1][1][-1] != cell[0]):
                yield links(held)
                held = []
            other = np.flatnonzero((cell != cell[-1]) | (tree != tree[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield links([*held, [c[:cut] for c in cols]])
                held = []
            held.append([c[cut:] for c in cols])
        if held:
            yield links(held)

    return search


def levels_for(fps: DataFrame) -> int:
    """The least number of levels whose fullest leaf holds at most ``LEAF`` homes; the most if none does."""
    for levels in LEVELS[:-1]:
        most = fps.select(F.explode(F.array(*[F.struct(F.lit(t).alias("t"), _home(F.col("fp"), t, levels).alias("c")) for t in (0, 1)])).alias("x")).groupBy("x").count().agg(F.max("count")).first()[0]
        if (most or 0) <= LEAF:
            return levels
    return LEVELS[-1]


def near_fingerprints(fps: DataFrame, radius: int = RADIUS, levels: int | None = None) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column ``fp``, long) at distance ``radius`` (at most 3) or less.

    Not every linked pair is listed, but every two linked fingerprints are joined by a chain of listed ones.
    """
    if not 0 <= radius <= 3:
        raise ValueError("two halves searched with radius 1 find distances up to 3")
    levels = levels_for(fps) if levels is None else levels
    rows = _placed(fps, levels).repartition("tree", "cell").sortWithinPartitions("tree", "cell", "query")
    return rows.mapInArrow(_search(radius), "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``: fingerprints link at ``radius`` bits or fewer, and
    ``component_id`` is the least doc_id that links reach.

    Null, empty and wordless texts have fingerprint 0, linked like any other.
    Equal texts share a fingerprint, so a group of copies is one node.  A row
    with a null doc_id is grouped, but its id never names a component that has
    another.  Rows that repeat a doc_id each keep their row.
    """
    prints = stored(docs.select("doc_id", fingerprint_udf("text").alias("fp")), "prints")
    fps = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fps")
    linked = components(near_fingerprints(fps.select("fp"), radius))
    rooted = fps.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def one_per_group(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with only the document of least doc_id of each group of :func:`near_duplicates`."""
    return first_of_groups(docs, near_duplicates(docs, radius))


def first_of_groups(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` with only the document of least doc_id of each group (doc_id, component_id).

    Of rows that repeat that doc_id, one stays.  Rows with a null doc_id can't be
    named by a group and all stay.
    """
    groups = stored(groups, "groups")
    keep = groups.where("doc_id = component_id").groupBy(F.col("doc_id").alias("_keep")).agg(F.count("*").alias("_n"))
    rows = packed(docs, "doc_id").join(keep, F.col("doc_id") == F.col("_keep"))
    kept = rows.where("_n = 1").select("row")
    if keep.where("_n > 1").limit(1).count():  # texts are shuffled only for ids that do repeat
        kept = kept.unionByName(rows.where("_n > 1").dropDuplicates(["doc_id"]).select("row"))
    return unpacked(kept.unionByName(packed(docs, "doc_id").where("doc_id IS NULL").select("row")), docs)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
