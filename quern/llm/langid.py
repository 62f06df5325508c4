"""Language identification of mixed-language text.

A word is a run of letters.  Its script (by code point ranges) narrows the
candidate languages to those whose training text uses that script; the
candidates are scored by the word's character trigrams.  A Viterbi pass over the
words of a text, with a penalty for each change of language, labels spans.  The
text's language is the one that holds the most letters.

Scores come from counts over a bounded, hash-chosen sample of labelled rows per
language.  Prediction is numpy over whole Arrow batches: cost per word does not
depend on the vocabulary.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code point ranges of scripts; letters outside them are of script "other".
SCRIPTS = (
    ("latin", ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F),)),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF))),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF))),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F))),
)
OTHER = len(SCRIPTS) + 1
TABLE_BITS = 17
PER_LANG = 3000
PENALTY = 12.0
FLOOR = 1e-6
BARRED = -40.0
PART = 2_000_000
WORDS = 3_000_000


@lru_cache(maxsize=1)
def script_table() -> np.ndarray:
    """Script number of every code point, 0 for what is neither letter nor mark."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LM":
            table[c] = OTHER
    for i, (_, ranges) in enumerate(SCRIPTS, 1):
        for lo, hi in ranges:
            part = table[lo : hi + 1]
            part[part > 0] = i
    return table


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Which code points are letters; marks alone make no word."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


@dataclass
class Words:
    """The words of some texts, runs of letters and marks with a letter in them: text number, start, end (code points in the text), script."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    grams: np.ndarray  # table indexes of all trigrams
    first: np.ndarray  # where each word's trigrams begin in grams


def lowered(text: str) -> str:
    """Lower case with as many code points as before."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def words_of(texts: list[str]) -> Words:
    codes = np.frombuffer((" ".join(map(lowered, texts)) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begin = np.cumsum(lens) - lens
    script = script_table()[codes]
    letter = script > 0
    true = np.flatnonzero(letter_table()[codes])
    edge = np.diff(letter.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    nearest = np.searchsorted(true, start)  # each run's first letter
    bare = np.r_[true, len(codes)][nearest] >= end
    if bare.any():
        inside = np.zeros(len(codes) + 1, np.int8)
        inside[start[bare]], inside[end[bare]] = 1, -1
        letter &= np.cumsum(inside[:-1]) == 0
        edge = np.diff(letter.astype(np.int8), prepend=0)
        start, end, nearest = start[~bare], end[~bare], nearest[~bare]
    c = np.where(letter, codes, 0).astype(np.uint64)
    b = np.r_[np.zeros(1, np.uint64), c[:-1]]
    a = np.r_[np.zeros(2, np.uint64), c[:-2]]
    a[b == 0] = 0
    used = np.flatnonzero(letter | (edge == -1))
    h = (a[used] * np.uint64(0x9E3779B97F4A7C15) + b[used]) * np.uint64(0xC2B2AE3D27D4EB4F) + c[used]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    grams = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    size = end - start + 1
    first = np.cumsum(size) - size
    text = np.searchsorted(begin, start, side="right") - 1
    return Words(text, start - begin[text], end - begin[text], script[true[nearest]], grams, first)


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # (table, languages): log relative frequencies
    allowed: np.ndarray  # (scripts, languages)

    def word_scores(self, w: Words) -> np.ndarray:
        """(words, languages); a word in a script that no language uses scores 0 for all and doesn't count in :func:`label_texts`."""
        if not len(w.start):
            return np.zeros((0, len(self.langs)), np.float32)
        s = np.add.reduceat(self.scores[w.grams], w.first, axis=0)
        ok = self.allowed[w.script]
        s = np.where(ok, s, s.min(axis=1, keepdims=True) + BARRED)
        s[~ok.any(axis=1)] = 0
        return s


def viterbi(scores: np.ndarray, first: np.ndarray, count: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best language of every word; text i has the rows first[i] .. first[i] + count[i] - 1 of ``scores``.

    All texts take a step together, the longest first, so a step costs only the texts that still go on.
    """
    n, k = scores.shape
    out, back = np.zeros(n, np.int16), np.zeros((n, k), np.int16)
    order = np.argsort(-count, kind="stable")
    order = order[count[order] > 0]
    first, count = first[order], count[order]
    if not len(order):
        return out
    live = np.searchsorted(-count, -np.arange(count[0]), side="left")  # texts with more than t words
    own = np.arange(k, dtype=np.int16)[None, :]
    v = scores[first].astype(np.float64)
    for t in range(1, int(count[0])):
        m = live[t]
        at, cur = first[:m] + t, v[:m]
        top = cur.argmax(axis=1)
        most = cur[np.arange(m), top][:, None] - penalty
        stay = cur >= most
        back[at] = np.where(stay, own, top[:, None])
        v[:m] = np.where(stay, cur, most) + scores[at]
    # v[i] is final once text i has ended: rows beyond ``live`` are no longer touched.
    state = v.argmax(axis=1)
    for t in range(int(count[0]) - 1, -1, -1):
        m = live[t]
        at = first[:m] + t
        out[at] = state[:m]
        state[:m] = back[at, state[:m]] if t else state[:m]
    return out


def count_rows(docs: DataFrame) -> DataFrame:
    """(lang, slot, n) of the training texts: trigram counts, and letters by script in the slots below 0."""

    def count(frames):
        for pdf in frames:
            for lang, part in pdf.groupby("lang"):
                total = np.zeros(1 << TABLE_BITS, np.int64)
                scripts = np.zeros(OTHER + 1, np.int64)
                for texts in parts(part["text"].tolist()):
                    w = words_of(texts)
                    total += np.bincount(w.grams, minlength=1 << TABLE_BITS)
                    scripts += np.bincount(w.script, weights=w.end - w.start, minlength=OTHER + 1).astype(np.int64)
                slot, s = np.flatnonzero(total), np.flatnonzero(scripts)
                yield pd.DataFrame({"lang": lang, "slot": np.r_[slot, -1 - s], "n": np.r_[total[slot], scripts[s]]})

    return docs.select("lang", "text").mapInPandas(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def parts(texts: list[str]):
    """Lists of texts of about ``PART`` characters together."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= PART:
            yield part
            part, size = [], 0
    if part:
        yield part


def hash_cut(wanted: int, rows: int) -> int:
    """The hash that about ``wanted`` of ``rows`` rows don't exceed, if 64-bit hashes are uniform; no rows need to be ranked."""
    return -(1 << 63) + ((1 << 64) * min(wanted, rows)) // max(rows, 1) - 1


def train(labelled: DataFrame, per_lang: int = PER_LANG, min_share: float = 0.01) -> Model:
    """A model from rows (doc_id, text, lang): about ``per_lang`` rows per language (all, if there are fewer), those of least hash of doc_id.

    The driver gets one row per language and trigram slot: at most 2**17 a language.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").withColumn("_k", F.xxhash64("doc_id"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((1 << TABLE_BITS, 0), np.float32), np.zeros((OTHER + 1, 0), bool))
    bound = F.create_map(*[x for g in langs for x in (F.lit(g), F.lit(hash_cut(per_lang, counts[g])))])
    sample = rows.where(F.col("_k") <= F.element_at(bound, F.col("lang")))
    counts = count_rows(sample).toPandas()
    number = {x: i for i, x in enumerate(langs)}
    table, scripts = np.zeros((1 << TABLE_BITS, len(langs))), np.zeros((OTHER + 1, len(langs)))
    col, slot, n = counts["lang"].map(number).to_numpy(np.int64), counts["slot"].to_numpy(np.int64), counts["n"].to_numpy(float)
    gram = slot >= 0
    table[slot[gram], col[gram]] = n[gram]
    scripts[-1 - slot[~gram], col[~gram]] = n[~gram]
    table /= np.maximum(table.sum(axis=0), 1)
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    return Model(langs, np.log(table + FLOOR).astype(np.float32), share >= min_share)


def label_texts(texts: list[str | None], model: Model, penalty: float = PENALTY) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """Per text: language, its share of the letters, and spans (start, end, language) from first to last word.

    Words in a script that no language uses stand in ``und`` spans: their letters
    lower the share and speak for no language.  A text of such words only gets the
    first language with share 0.  Words are cut and scored in parts of ``PART``
    characters, at about 60 bytes a character, and labelled about ``WORDS`` at a
    time, at about 100 bytes a word; a longer text is labelled alone.
    """
    out, held, words = [], [], 0
    if not model.langs:
        return [("und", 0.0, [])] * len(texts)
    for part in parts([t or "" for t in texts]):
        w = words_of(part)
        held.append((len(part), w.text, w.start, w.end, model.word_scores(w), model.allowed[w.script].any(axis=1)))
        words += len(w.text)
        if words >= WORDS:
            out += _labelled(held, model, penalty)
            held, words = [], 0
    return out + _labelled(held, model, penalty)


def _labelled(held: list[tuple], model: Model, penalty: float) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """The labels of the texts of some parts: their number, then each word's text, start, end, scores and whether it counts."""
    n, nothing, k = sum(h[0] for h in held), ("und", 0.0, []), len(model.langs)
    before = np.cumsum([0, *(h[0] for h in held)])
    if not sum(len(h[1]) for h in held):
        return [nothing] * n
    text = np.concatenate([h[1] + at for h, at in zip(held, before, strict=False)])
    start, end, scores, counts = (np.concatenate([h[i] for h in held]) for i in (2, 3, 4, 5))
    count = np.bincount(text, minlength=n)
    first = np.cumsum(count) - count
    lang = viterbi(scores, first, count, penalty)
    lang[~counts] = k
    letters = np.bincount(text * (k + 1) + lang, weights=end - start, minlength=n * (k + 1)).reshape(-1, k + 1)
    best, total = letters[:, :k].argmax(axis=1), letters.sum(axis=1)
    new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (lang[1:] != lang[:-1])])
    last = np.r_[new[1:], len(text)] - 1
    names = [*model.langs, "und"]
    spans: list[list[tuple[int, int, str]]] = [[] for _ in range(n)]
    for i, j in zip(new.tolist(), last.tolist(), strict=True):
        spans[text[i]].append((int(start[i]), int(end[j]), names[lang[i]]))
    return [(names[best[i]], float(letters[i, best[i]] / total[i]), spans[i]) if total[i] else nothing for i in range(n)]


def languages(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """doc_id, ``lang_pred``, ``score`` (its share of the letters) and ``spans`` of every row.

    ``und``, score 0 and no spans for a null text, one without letters, or a
    model without languages.  Repeated rows are labelled one by one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def predict(frames):
        for pdf in frames:
            found = label_texts(pdf["text"].tolist(), model, penalty)
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].to_numpy(), "lang_pred": [x[0] for x in found], "score": [x[1] for x in found],
                "spans": [[{"start": s, "end": e, "lang": g} for s, e, g in x[2]] for x in found],
            })

    return docs.select("doc_id", "text").mapInPandas(predict, f"doc_id {kind}, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>")


def fold(doc_id, n: int):
    """crc32(doc_id as text) mod n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = train(docs.where(~held_out))
    out = languages(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
