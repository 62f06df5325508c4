"""Indexing: chunks to vectors through an injectable embedder, and the builder of the whole corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quern.operators import chunkers, graph

#: Bytes that an embedder takes at once, and texts of a call.
EMBED_CAP, BATCH = 3500, 32


class Embedder(Protocol):
    """One call per batch of texts; it may raise."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """A deterministic offline stand-in: hashed words as a unit vector."""

    def __init__(self, dim: int = 64, remembered: int = 200_000):
        self.dim, self.remembered = dim, remembered
        self.known: dict[str, tuple[int, float]] = {}

    def place(self, word: str) -> tuple[int, float]:
        """A word's dimension and sign; those of frequent words are remembered."""
        at = self.known.get(word)
        if at is None:
            h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            at = h % self.dim, 1.0 if h >> 63 else -1.0
            if len(self.known) < self.remembered:
                self.known[word] = at
        return at

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dim)
            for w in t.lower().split():
                at, sign = self.place(w)
                v[at] += sign
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32).tolist())
        return out


def embed_udf(embedder: Embedder, batch: int = BATCH):
    """A pandas UDF from text to vector: batches, then one by one where a batch fails; a rejected text gives null."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            out: list = []
            for at in range(0, len(s), batch):
                part = s.iloc[at : at + batch].fillna("").tolist()
                try:
                    out += embedder(part)
                except Exception:  # isolate the text that the service rejects
                    for t in part:
                        try:
                            out += embedder([t])
                        except Exception:
                            out.append(None)
            yield pd.Series(out)

    return embed


def pieces(chunks: DataFrame, cap: int = EMBED_CAP) -> DataFrame:
    """``chunks`` whose body fits ``cap`` bytes as they are; longer ones as pieces of whole code points that do, with ``#1``, ``#2`` ... behind their ids.

    Nothing of a body is left out.
    """
    parts = F.when(F.octet_length("body") > cap, F.regexp_extract_all("body", F.lit(f"(?s).{{1,{cap // 4}}}"), F.lit(0))).otherwise(F.array("body"))
    p = chunks.withColumn("_parts", parts).select(*[c for c in chunks.columns if c not in ("chunk_id", "body")], "chunk_id", F.size("_parts").alias("_n"), F.posexplode("_parts").alias("_k", "body"))
    return p.withColumn("chunk_id", F.when(F.col("_n") > 1, F.concat("chunk_id", F.lit("#"), (F.col("_k") + 1).cast("string"))).otherwise(F.col("chunk_id"))).select(*chunks.columns)


def vectors(chunks: DataFrame, family: str, embedder: Embedder | None = None, cap: int = EMBED_CAP) -> DataFrame:
    """(id, family, scope, source, doc, embedding): the pieces of chunks whose text the embedder takes."""
    run = embed_udf(embedder or HashEmbedder())
    v = pieces(chunks, cap).select(F.col("chunk_id").alias("id"), F.lit(family).alias("family"), "scope", "source", F.col("body").alias("doc"), run("body").alias("embedding"))
    return v.where("embedding IS NOT NULL")


def build(files: DataFrame, *more: DataFrame) -> DataFrame:
    """Chunks of document files (and further chunk frames) with inbound cites."""
    chunks = chunkers.chunk_files(files)
    for m in more:
        chunks = chunks.unionByName(m, allowMissingColumns=True)
    return graph.with_inbound(chunks)


def cached(requests: DataFrame, cache: DataFrame, call) -> tuple[DataFrame, DataFrame]:
    """(all answers, fresh entries to append) of ``requests`` (key, prompt) against ``cache`` (key, answer); ``call`` is a UDF."""
    hits = requests.join(cache.select("key", "answer"), "key")
    fresh = requests.join(cache.select("key"), "key", "left_anti").withColumn("answer", call("prompt")).where("answer IS NOT NULL")
    return hits.unionByName(fresh), fresh.select("key", "answer")
