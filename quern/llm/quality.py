"""Quality classifier: a support vector machine over naive Bayes features.

A text's features are the distinct character n-grams (n = 1, 2, 3, hashed) of
the whole text.  Each indicator is scaled by its class log-count ratio, the
vector is scaled to unit length, and a linear hinge-loss model is fitted by dual
coordinate descent on a bounded, hash-chosen sample of labelled rows.  Margins
become probabilities by a logistic curve that is fitted to the margins of rows left
out in turn.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.langid import fold, hash_cut, parts

SLOTS_BITS = 18
SLOTS = 1 << SLOTS_BITS
SAMPLE = 3000


def ngram_slots(texts: list[str]):
    """Per text, the distinct hashed 1-, 2- and 3-grams of its characters."""
    last = np.zeros(SLOTS, np.int64)
    for part in parts(texts):
        codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        grams, h = [], np.zeros(len(codes), np.uint64)
        for n in (1, 2, 3):
            h = h[: max(0, len(codes) - n + 1)] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
            x = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            grams.append((x >> np.uint64(64 - SLOTS_BITS)).astype(np.int64))
        at = 0
        for t in part:
            ids = np.concatenate([g[at : max(at, at + len(t) - n)] for n, g in enumerate(grams)])
            # Each slot remembers the last position that named it; that position alone keeps it.
            order = np.arange(len(ids))
            last[ids] = order
            yield ids[last[ids] == order]
            at += len(t)


@dataclass
class Model:
    """``ratio``: log-count ratios; ``weight``: the hinge model over scaled indicators; ``bias``; ``curve``: slope and offset of the logistic curve."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    curve: tuple[float, float] = (2.0, 0.0)

    def margins(self, texts: list[str]) -> np.ndarray:
        return np.fromiter(self.margins_of(ngram_slots(texts)), float, len(texts))

    def margins_of(self, rows):
        both = self.ratio * self.weight
        for ids in rows:
            r = self.ratio[ids]
            norm = np.sqrt(r @ r)
            yield self.bias + (both[ids].sum() / norm if norm else 0.0)

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.curve[0] * margins + self.curve[1], -60, 60)))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p, q = np.full(SLOTS, alpha), np.full(SLOTS, alpha)
    for ids, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[ids] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def fit(rows: list[np.ndarray], y: np.ndarray, c: float = 10.0, rounds: int = 40, seed: int = 7, tolerance: float = 1e-3) -> Model:
    """Dual coordinate descent for min |w|^2 / 2 + c * sum hinge(y w x); the bias is one more feature of value 1.

    One class only: the weights stay 0 and the bias names the class.  No rows: bias 0.
    """
    ratio = log_count_ratios(rows, y)
    w, bias = np.zeros(SLOTS), 0.0
    if not len(y) or (y == y[0]).all():
        return Model(ratio, w, float(y[0]) if len(y) else 0.0)
    xs = []
    for ids in rows:
        x = ratio[ids]
        norm = np.sqrt(x @ x)
        xs.append(x / norm if norm else x)
    square = np.array([x @ x + 1.0 for x in xs])
    a = np.zeros(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(y)):
            ids, x = rows[i], xs[i]
            g = y[i] * (w[ids] @ x + bias) - 1.0
            pg = min(g, 0.0) if a[i] == 0 else max(g, 0.0) if a[i] == c else g
            worst = max(worst, abs(pg))
            if pg:
                new = min(max(a[i] - g / square[i], 0.0), c)
                step = (new - a[i]) * y[i]
                w[ids] += step * x
                bias += step
                a[i] = new
        if worst < tolerance:
            break
    return Model(ratio, w, bias)


def logistic_curve(margins: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope (never negative) and offset of the logistic curve of most likelihood, by Newton steps; targets are softened as by one more row a class."""
    n, m = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n + 1) / (n + 2), 1 / (m + 2))
    x, w = np.c_[margins, np.ones(len(margins))], np.zeros(2)
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -60, 60)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (t - p))
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 and np.isfinite(w).all() else (2.0, 0.0)


def calibrated(rows: list[np.ndarray], y: np.ndarray, folds: int = 3) -> Model:
    """The model of all rows, with the curve of the margins that each row gets from a model without its fold."""
    model = fit(rows, y)
    fold_of, margins = np.arange(len(y)) % folds, np.zeros(len(y))
    for k in range(folds):
        out = fold_of == k
        if len(set(y[~out])) < 2:
            return model
        part = fit([r for r, o in zip(rows, out, strict=True) if not o], y[~out])
        margins[out] = list(part.margins_of(r for r, o in zip(rows, out, strict=True) if o))
    model.curve = logistic_curve(margins, y)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``labels`` (doc_id, quality) and the texts of ``docs``.

    About ``sample`` labelled rows are used (all, if there are fewer), those of
    least hash of doc_id; they are broadcast to the texts, and the driver gets their feature numbers
    (4 bytes for each distinct n-gram of a text, of which there are at most ``SLOTS``).
    Null labels, labels without a document and null texts are passed over.
    """
    some = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality"))
    some = some.where(F.xxhash64("doc_id") <= F.lit(hash_cut(sample, some.count())))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(some), "doc_id")

    def slots(frames):
        for pdf in frames:
            ids = [x.astype(np.int32) for x in ngram_slots(pdf["text"].tolist())]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "y": pdf["quality"].to_numpy(), "ids": ids})

    got = rows.mapInPandas(slots, f"doc_id {kind}, y int, ids array<int>").toPandas().sort_values(["doc_id", "y"], kind="stable")
    return calibrated([np.asarray(x, np.int64) for x in got["ids"]], np.where(got["y"].to_numpy() > 0, 1.0, -1.0))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, ``score`` (0 to 1) and ``predicted`` of every row; a null text counts as empty and gets the bias's score."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(frames):
        for pdf in frames:
            m = model.margins([t or "" for t in pdf["text"].tolist()])
            s = model.probability(m)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    return docs.select("doc_id", "text").mapInPandas(score, f"doc_id {kind}, score double, predicted int")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    model = train(docs, labels.where(~held_out))
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
