"""Near copies among documents: equal or similar by 5-word shingles, or near by SimHash.

The SimHash of :mod:`quern.llm.simhash` (3-word shingles, 3 bits) alone misses most
pairs at Jaccard 0.8 to 0.95.  So documents also meet by the banded MinHash of
:mod:`quern.llm.linededup`, here over shingles of five words, and are verified by
exact Jaccard similarity.  Both kinds of links go to one union-find.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import linededup, simhash
from quern.llm.components import components
from quern.llm.store import stored

SHINGLE = 5
SIMILARITY = 0.8
#: Texts that a Python worker takes at once; they are much longer than lines.
ROWS = 250
#: Members of a group of texts, and bytes of their texts, that one task takes at once; their sets of hashes take a few times the bytes.
MOST, MOST_BYTES = 1000, 12 << 20


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of the text's runs of five words, sorted; of a shorter text, the one of all its words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(7)), np.uint64, len(words))
    return np.unique(linededup.shingle_hashes(h, min(SHINGLE, len(h)))) if len(h) else h


def _sets(texts: list[str]) -> list[np.ndarray]:
    return [shingle_set(t) for t in texts]


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, text) to (key, h); texts without words have no key."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            sets = _sets(part.column(1).to_pylist())
            some = np.array([len(s) > 0 for s in sets])
            sets = [s for s in sets if len(s)]
            if sets:
                keys = linededup.keys_of(linededup.binned(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets))).view(np.int64)
                h = part.column(0).to_numpy(zero_copy_only=False)[some]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(h, linededup.BANDS))], names=["key", "h"])


def similar_texts(texts: DataFrame, similarity: float = SIMILARITY, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Links (u, v) between the hashes ``h`` of texts (h, text) at ``similarity`` or more."""
    return linededup.similar(texts.mapInArrow(_banded, "key long, h long"), texts.select("h", F.col("text").alias("norm")), similarity, "doc_buckets", _sets, ROWS, MOST, most_bytes)


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, radius: int = simhash.RADIUS) -> DataFrame:
    """(doc_id, component_id) per row of ``docs``: the least doc_id that links of either kind reach.

    Null, empty and wordless texts are linked with each other, as in :func:`simhash.near_duplicates`.
    """
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    prints = stored(texts.select("doc_id", "h", simhash.fingerprint_udf("text").alias("fp")), "doc_prints")
    nodes = stored(prints.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.min("fp").alias("fp")), "doc_nodes")
    reps = stored(nodes.groupBy("fp").agg(F.min("h").alias("rep")), "doc_reps")
    same = nodes.join(reps, "fp").where("h != rep").select(F.col("h").alias("u"), F.col("rep").alias("v"))
    bits = simhash.near_fingerprints(reps.select("fp"), radius)
    bits = bits.join(reps.select(F.col("fp").alias("u"), F.col("rep").alias("ru")), "u").join(reps.select(F.col("fp").alias("v"), F.col("rep").alias("rv")), "v").select(F.col("ru").alias("u"), F.col("rv").alias("v"))
    links = similar_texts(texts.select("h", "text"), similarity).unionByName(same).unionByName(bits)
    rooted = nodes.join(components(links).withColumnRenamed("node", "h"), "h", "left").select("h", "first_id", F.coalesce("root", "h").alias("root"))
    rooted = stored(rooted, "doc_rooted")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("h", "component_id"), "h").select("doc_id", "component_id")


def one_per_group(docs: DataFrame) -> DataFrame:
    """``docs`` with only the document of least doc_id of each group of near copies."""
    return simhash.first_of_groups(docs, near_copies(docs))
