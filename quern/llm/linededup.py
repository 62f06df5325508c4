"""Fuzzy line dedup by MinHash.

Lines (``\\n``-split, trimmed, lower-cased) of ``MIN_CHARS``
characters or more are compared by their sets of 6-character shingles.  Equal
lines share a 64-bit hash and count as one.  A line's signature comes from
one-permutation hashing with optimal densification: one hash per shingle, the
least per bin, empty bins filled from others.  ``BANDS`` bands of ``ROWS`` bins
make keys; at Jaccard 0.8 a pair shares a key with probability 0.996.  Lines that
share a key are verified by exact Jaccard similarity, and the links go to a
distributed union-find.  Of each component the first line by (doc_id, line
number) stays.

The groups of lines that share a key are sent to workers by their least member, so
that a line is shingled once for nearly all its groups, and lines that one group
has linked aren't compared again in the next.  A group beyond a size is split into
tasks of bounded size that together still meet every pair that could join two of
its components.

Shorter lines are too short for shingles to tell near copies from chance: of
them only exact repeats (of the trimmed, lower-cased line) go, by the same hash.
Lines of white space alone stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.llm.store import packed, stored

MIN_CHARS = 30
SHINGLE = 6
BANDS, ROWS = 14, 5
BINS = BANDS * ROWS
SIMILARITY = 0.8
#: Distinct lines that share a key (8 bytes each) up to which they are broadcast to the scan for their texts.
BROADCAST_LINES = 2_000_000
#: Texts, and lines, that a Python worker takes at once; hashes that it remembers (a repeated line needs its keys once a task).
TEXTS, LINES, SEEN = 200, 1000, 500_000
#: Members of a group that one task takes at once (twice that, all in all); members that all others of a larger group meet first.
MOST, CENTRES = 5000, 100
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= MIX[0]
    x ^= x >> np.uint64(27)
    x *= MIX[1]
    x ^= x >> np.uint64(31)
    return x


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def shingle_hashes(codes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` code points."""
    n = max(0, len(codes) - size + 1)
    wide = codes.astype(np.uint64)
    h = wide[:n].copy()
    for k in range(1, size):
        h *= np.uint64(0x100000001B3)
        h += wide[k : k + n]
    return _mix(h)


def signatures(lines: list[str]) -> np.ndarray:
    """One row of ``BINS`` values per line; every line needs ``SHINGLE`` characters at least."""
    lens = np.fromiter(map(len, lines), np.int64, len(lines))
    h = shingle_hashes(_codes("".join(lines)))
    ends = np.cumsum(lens)
    row = np.repeat(np.arange(len(lines)), lens)[: len(h)]
    inside = np.arange(len(h)) <= ends[row] - SHINGLE
    h, row = h[inside], row[inside]
    return binned(h, row, len(lines))


def binned(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Signatures of ``n`` rows from the shingle hashes ``h`` of rows ``row``; every row needs one at least."""
    sig = np.full(n * BINS, EMPTY)
    np.minimum.at(sig, row * BINS + (((h >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64), h)
    sig = sig.reshape(-1, BINS)
    empty = sig == EMPTY
    r, b = np.nonzero(empty)
    attempt = 0
    while len(r):  # an empty bin takes the value of the first filled one in an order that only the bin sets
        attempt += 1
        src = (_mix(b.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(attempt)) % np.uint64(BINS)).astype(np.int64)
        ok = ~empty[r, src]
        sig[r[ok], b[ok]] = sig[r[ok], src[ok]]
        r, b = r[~ok], b[~ok]
    return sig


def band_keys(lines: list[str]) -> np.ndarray:
    """One row of ``BANDS`` 64-bit keys per line."""
    return keys_of(signatures(lines))


def keys_of(sig: np.ndarray) -> np.ndarray:
    sig = sig.reshape(-1, BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * MIX[0]
    key = np.repeat(key, len(sig), axis=0)
    for k in range(ROWS):
        key = _mix(key ^ sig[:, :, k]) + np.uint64(k)
    return key


def split_lines(texts: list[str | None]) -> tuple[list[int], list[int], list[str]]:
    """(text number, line number, line) of all lines; lines are lower-cased and without outer spaces."""
    at, number, lines = [], [], []
    for i, t in enumerate(texts):
        if t is not None:
            part = [x.strip(" ") for x in t.lower().split("\n")]
            at += [i] * len(part)
            number += range(len(part))
            lines += part
    return at, number, lines


def line_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)


def _hashed(lines: list[str]) -> np.ndarray:
    return np.fromiter(map(line_hash, lines), np.uint64, len(lines)).view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _long_lines(min_chars: int, column: int = 0):
    """Batches with texts in ``column`` to (hashes, lines) of the lines of ``min_chars`` characters or more, each once per task as far as ``SEEN`` hashes tell."""
    least = max(min_chars, SHINGLE)

    def lines_of(batches):
        seen: set[int] = set()
        for batch in _slices(batches, TEXTS):
            lines = [x for x in split_lines(batch.column(column).to_pylist())[2] if len(x) >= least]
            hashes = _hashed(lines)
            new = []
            for i, h in enumerate(hashes.tolist()):
                if h not in seen:
                    seen.add(h)
                    new.append(i)
            if len(seen) > SEEN:
                seen.clear()
            if new:
                yield hashes[new], [lines[i] for i in new]

    return lines_of


def _banded(min_chars: int):
    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(text) to (key, h) of its long lines."""
        for hashes, lines in _long_lines(min_chars)(batches):
            for at in range(0, len(lines), LINES):
                keys = band_keys(lines[at : at + LINES]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(hashes[at : at + LINES], BANDS))], names=["key", "h"])

    return banded


def _texts_of(min_chars: int):
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(text) to (h, norm) of its long lines."""
        for hashes, lines in _long_lines(min_chars)(batches):
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(lines, pa.string())], names=["h", "norm"])

    return texts


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, h) sorted by key to (lead, grp, h) of the keys that two or more lines share; equal member sets get equal ``grp``, and ``lead`` is their least member."""
    held_k = held_h = np.empty(0, np.int64)

    def runs(k):
        new = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        return new, np.diff(np.r_[new, len(k)])

    def groups(k, h):
        new, size = runs(k)
        at = np.repeat(size > 1, size)  # most keys belong to one line and end here
        k, h = k[at], h[at]
        order = np.lexsort((h, k))
        k, h = k[order], h[order]
        fresh = np.r_[True, (k[1:] != k[:-1]) | (h[1:] != h[:-1])] if len(k) else np.empty(0, bool)
        k, h = k[fresh], h[fresh]
        if not len(k):
            return None
        new, size = runs(k)
        many = size > 1
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(_mix(h.view(np.uint64)), new)
        grp = np.repeat(_mix(sums[many] + size[many].astype(np.uint64)).view(np.int64), size[many])
        lead = np.repeat(h[new[many]], size[many])
        return pa.RecordBatch.from_arrays([pa.array(lead), pa.array(grp), pa.array(h[np.repeat(many, size)])], names=["lead", "grp", "h"])

    for batch in batches:
        k = np.concatenate([held_k, batch.column(0).to_numpy(zero_copy_only=False)])
        h = np.concatenate([held_h, batch.column(1).to_numpy(zero_copy_only=False)])
        if not len(k):
            continue
        cut = int(np.searchsorted(k, k[-1]))  # the last key may go on in the next batch
        held_h = np.unique(h[cut:])
        held_k = np.full(len(held_h), k[-1])
        if cut and (out := groups(k[:cut], h[:cut])) is not None:
            yield out
    if len(held_k) and (out := groups(held_k, held_h)) is not None:
        yield out


def line_sets(lines: list[str]) -> list[np.ndarray]:
    """Each line's distinct shingle hashes, sorted; the hashes of all lines are computed together."""
    h = shingle_hashes(_codes("".join(lines)))
    out, at = [], 0
    for x in lines:
        s = np.sort(h[at : at + max(0, len(x) - SHINGLE + 1)])
        out.append(s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s)
        at += len(x)
    return out


class Near:
    """Which of some shingle sets are at ``similarity`` or more with one of them."""

    def __init__(self, sets: list[np.ndarray], similarity: float):
        self.sets, self.similarity = sets, similarity
        self.size = np.array([len(s) for s in sets])
        self.ids = None
        if len(sets) > 4:  # numbers for the hashes, so that one pass compares a set with all others
            names, ids = np.unique(np.concatenate(sets), return_inverse=True)
            self.ids, self.mark = ids.astype(np.int32), np.zeros(len(names), bool)
            self.end = np.cumsum(self.size)

    def of(self, i: int, others: list[int]) -> list[bool]:
        a, b = self.size[i], self.size[others]
        able = np.minimum(a, b) >= self.similarity * np.maximum(a, b)
        if not able.any():
            return able.tolist()
        some = [j for j, ok in zip(others, able, strict=True) if ok]
        if self.ids is None or len(some) < 3:
            common = np.empty(len(some), np.int64)
            for k, j in enumerate(some):
                both = np.concatenate([self.sets[i], self.sets[j]])
                both.sort()
                common[k] = np.count_nonzero(both[1:] == both[:-1])
        else:
            own = self.ids[self.end[i] - a : self.end[i]]
            self.mark[own] = True
            common = np.array([np.count_nonzero(self.mark[self.ids[self.end[j] - self.size[j] : self.end[j]]]) for j in some])
            self.mark[own] = False
        able[able] = common >= self.similarity * (a + self.size[some] - common)
        return able.tolist()


def jaccard_links(h: list[int], sets: list[np.ndarray], similarity: float, groups: list[list[int]] | None = None) -> list[tuple[int, int]]:
    """A forest of the pairs of shingle sets at ``similarity`` or more within one of ``groups`` (member numbers; all in one by default).

    A line taken from the queue meets only lines of the group that nothing has
    reached yet, in this group or one before, so a large group of near copies costs
    about its size, not its square.
    """
    near, root, out = Near(sets, similarity), list(range(len(h))), []

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for group in [list(range(len(h)))] if groups is None else groups:
        left = sorted(group, key=near.size.__getitem__)
        while len(left) > 1:
            queue = [left.pop()]
            while queue and left:
                i = queue.pop()
                known = [find(j) == find(i) for j in left]
                queue += [j for j, ok in zip(left, known, strict=True) if ok]
                left = [j for j, ok in zip(left, known, strict=True) if not ok]
                if left:
                    hit = near.of(i, left)
                    for j, ok in zip(left, hit, strict=True):
                        if ok:
                            out.append((h[i], h[j]))
                            root[find(j)] = find(i)
                            queue.append(j)
                    left = [j for j, ok in zip(left, hit, strict=True) if not ok]
    return out


def _verified(similarity: float, sets_of=line_sets, rows: int = 2000):
    """``rows``: how many rows are taken at once."""

    def links(hs, grps, sets):
        groups: dict[int, list[int]] = {}
        for i, gs in enumerate(grps):
            for g in gs:
                groups.setdefault(g, []).append(i)
        return jaccard_links(hs, sets, similarity, list(groups.values()))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lead, h, grps, norm) sorted by lead to links (u, v)."""
        lead, hs, grps, sets = None, [], [], []

        def batch_of(pairs):
            u, v = zip(*pairs, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in _slices(batches, rows):
            out: list[tuple[int, int]] = []
            known = sets_of(batch.column(3).to_pylist())
            for x, h, gs, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), known, strict=True):
                if x != lead:
                    if len(hs) > 1:
                        out += links(hs, grps, sets)
                    lead, hs, grps, sets = x, [], [], []
                hs.append(h)
                grps.append(gs)
                sets.append(s)
            if out:
                yield batch_of(out)
        if len(hs) > 1 and (out := links(hs, grps, sets)):
            yield batch_of(out)

    return verify


def similar(banded: DataFrame, texts: DataFrame, similarity: float, label: str, sets_of=line_sets, rows: int = 2000, most: int = MOST, most_bytes: int | None = None) -> DataFrame:
    """Links (u, v) between the hashes ``h`` of ``banded`` (key, h) that share a key and whose ``texts`` (h, norm) are at ``similarity`` or more.

    Not every linked pair is listed, but every two linked texts are joined by a chain of listed ones.
    A group of more than ``2 * most`` members, or of more than twice ``most_bytes`` of text, is split, see
    :func:`split_group_links`.
    """
    shared = banded.repartition("key").sortWithinPartitions("key").mapInArrow(_buckets, "lead long, grp long, h long")
    shared = stored(shared.groupBy("lead", "h").agg(F.collect_set("grp").alias("grps")), label)  # a line has at most BANDS groups
    wanted = shared.select(F.col("h").alias("_h")).distinct()
    few = wanted.count() <= BROADCAST_LINES
    found = texts.join(F.broadcast(wanted) if few else wanted, F.col("h") == F.col("_h"), "left_semi").dropDuplicates(["h"])
    run = _verified(similarity, sets_of, rows)

    def verified(groups: DataFrame) -> DataFrame:
        return groups.join(found, "h").select("lead", "h", "grps", "norm").repartition("lead").sortWithinPartitions("lead", "h").mapInArrow(run, "u long, v long")

    members = shared.select("lead", "h", F.explode("grps").alias("grp"))
    if most_bytes is None:
        large = members.groupBy("grp").agg(F.count("*").alias("n"), F.lit(1.0).alias("weight"))
    else:  # members of long texts count as several
        found = stored(found, f"{label}_texts")
        weight = F.greatest(F.lit(1.0), F.avg("bytes") * most / most_bytes)
        large = members.join(found.select("h", F.octet_length("norm").alias("bytes")), "h").groupBy("grp").agg(F.ceil(F.count("*") * weight).alias("n"), weight.alias("weight"))
    large = stored(large.where(F.col("n") > 2 * most), f"{label}_large")
    if not large.limit(1).count():
        return verified(shared)
    if most_bytes is None:
        found = stored(found, f"{label}_texts")  # read several times from here on
    small = members.join(large, "grp", "left_anti").groupBy("lead", "h").agg(F.collect_set("grp").alias("grps"))
    return verified(small).unionByName(split_group_links(members.join(large, "grp").select("grp", "h", "n", "weight"), verified, most, label))


def split_group_links(members: DataFrame, verified, most: int, label: str) -> DataFrame:
    """Links of large groups (grp, h, n, weight), in tasks of at most about ``2 * most`` members.

    Each member counts ``weight`` times, ``n`` in all: so groups of long texts get more slices.

    First every slice of a group meets the same ``CENTRES`` members; near copies
    mostly fall into one component by that.  Then all members outside a group's
    largest component meet every slice of the group.  What is left out are pairs
    inside the largest component, which need no more links.
    """
    slices = F.ceil(F.col("n") / most)
    m = members.withColumn("slice", F.pmod(F.xxhash64("h", F.lit(7)), slices)).withColumn("slices", slices)
    m = stored(m, f"{label}_members")
    task = lambda *cols: F.xxhash64("grp", *cols).alias("lead")
    rows = lambda df: df.select("lead", "h").distinct().withColumn("grps", F.array("lead"))

    order = Window.partitionBy("grp").orderBy(F.xxhash64("h", F.lit(9)), "h")
    centres = m.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= CENTRES)
    centres = centres.select("grp", "h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    first = stored(verified(rows(m.select(task("slice"), "h").unionByName(centres.select(task("slice"), "h")))), f"{label}_first")

    roots = components(first)
    m = stored(m.join(roots, F.col("h") == F.col("node"), "left").withColumn("root", F.coalesce("root", "h")).drop("node"), f"{label}_rooted")
    largest = m.groupBy("grp", "root").agg(F.count("*").alias("c")).groupBy("grp").agg(F.max_by("root", F.struct("c", "root")).alias("main"))
    rest = m.join(largest, "grp").where("root != main")
    width = rest.groupBy("grp").agg(F.ceil(F.count("*") * F.max("weight") / most).alias("others"))
    rest = rest.join(width, "grp").withColumn("other", F.pmod(F.xxhash64("h", F.lit(8)), F.col("others")))
    against = m.join(width, "grp").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
    every = rest.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    both = against.select(task("slice", "other"), "h").unionByName(every.select(task("slice", "other"), "h"))
    return first.unionByName(verified(rows(both)))


def counted_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, line, h) of the lines that are compared: those of ``min_chars`` characters, and shorter ones that hold more than white space.

    ``line`` counts from 0.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, TEXTS):
            at, number, lines = split_lines(batch.column(1).to_pylist())
            some = [k for k, x in enumerate(lines) if len(x) >= max(min_chars, SHINGLE) or x.strip(" \t\n\v\f\r")]
            rows = pa.array([at[k] for k in some], pa.int64())
            number = pa.array([number[k] for k in some], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), number, pa.array(_hashed([lines[k] for k in some]))], names=["doc_id", "line", "h"])

    return docs.select("doc_id", "text").mapInArrow(places, f"doc_id {kind}, line int, h long")


def repeated_lines(docs: DataFrame, similarity: float = SIMILARITY, min_chars: int = MIN_CHARS, most: int = MOST) -> DataFrame:
    """(doc_id, line) of the lines to remove: all of a component but its first by (doc_id, line); null doc_ids have none."""
    texts = docs.select("text")
    banded = texts.mapInArrow(_banded(min_chars), "key long, h long")
    links = similar(banded, texts.mapInArrow(_texts_of(min_chars), "h long, norm string"), similarity, "buckets", most=most)
    roots = stored(components(links), "lines")

    places = stored(counted_lines(docs.where("doc_id IS NOT NULL"), min_chars), "places")
    counts = places.groupBy("h").agg(F.min("doc_id").alias("d"), F.count("*").alias("n"))
    counts = counts.join(roots.withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    best = counts.groupBy("root").agg(F.min("d").alias("d"), F.sum("n").alias("all")).where(F.col("all") > 1)
    many = stored(counts.join(best.select("root", F.col("d").alias("kept_doc")), "root").select(F.col("h").alias("_h"), "root", "kept_doc"), "many")
    many = places.join(many, F.col("h") == F.col("_h"))
    own = many.where("doc_id = kept_doc")
    kept = own.groupBy("root").agg(F.min("line").alias("kept_line"))
    return many.where("doc_id != kept_doc").select("doc_id", "line").unionByName(own.join(kept, "root").where("line > kept_line").select("doc_id", "line"))


def without_repeated_lines(docs: DataFrame, similarity: float = SIMILARITY, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with repeated lines cut from ``text``, and a column ``lines_removed``.

    Null and blank texts pass as they are.  Rows that repeat a
    doc_id count as one document and lose the same lines.  Rows with a null
    doc_id lose none.  Columns and row count stay (a column ``lines_removed`` is
    replaced); a text may end up empty.
    """
    gone = repeated_lines(docs, similarity, min_chars).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("line").alias("_lines"))
    # The removed lines are the build side of a hash join, so the texts need no sort.
    rows = packed(docs, "doc_id")
    both = rows.where("doc_id IS NOT NULL").join(gone.hint("shuffle_hash"), F.col("doc_id") == F.col("_id"), "left").select("row", "_lines")
    both = both.unionByName(rows.where("doc_id IS NULL").select("row", F.lit(None).cast("array<int>").alias("_lines")))  # these would meet in one task
    text = F.when(F.col("_lines").isNull(), F.col("row.text")).otherwise(F.array_join(F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains(F.col("_lines"), i)), "\n"))
    removed = F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines"))
    return both.select(*[text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c != "lines_removed"], removed.alias("lines_removed"))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, text_sha256 of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long"))
    out = without_repeated_lines(docs)
    return out.select("doc_id", "n_lines", F.col("lines_removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
