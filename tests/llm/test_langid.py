import re
import unicodedata

import numpy as np
import pytest

from quern.llm import langid

EN = "the quick brown fox jumps over the lazy dog and then it runs through the wood with all of its friends "
FR = "le renard brun rapide saute par dessus le chien paresseux et puis il court dans les bois avec ses amis "
RU = "быстрая коричневая лиса прыгает через ленивую собаку и потом бежит через лес "


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t * 3, g) for i, (t, g) in enumerate([(EN, "en"), (FR, "fr"), (RU, "ru")] * 4)] + [(99, None, "en"), (98, EN, None)]
    return langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def slow_viterbi(s, penalty, stay=0.0):
    k = s.shape[1]
    v, back = s[0].copy(), []
    for row in s[1:]:
        step = v[:, None] - penalty * (1 - np.eye(k)) + stay * np.eye(k)
        back.append(step.argmax(axis=0))
        v = step.max(axis=0) + row
    path = [int(v.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return v.max(), path[::-1]


def test_viterbi_scores_as_the_full_recursion():
    rng = np.random.default_rng(0)
    count = np.array([5, 0, 1, 17, 9])
    s = rng.normal(size=(count.sum(), 4)) * 3
    first = np.cumsum(count) - count
    out = langid.viterbi(s, first, count, 2.0)
    for f, n in zip(first, count, strict=True):
        if n:
            best, _ = slow_viterbi(s[f : f + n], 2.0)
            path = out[f : f + n]
            mine = s[np.arange(f, f + n), path].sum() - 2.0 * (path[1:] != path[:-1]).sum()
            assert abs(mine - best) < 1e-9


def test_languages_and_spans(model):
    (lang, score, spans), *rest = langid.label_texts([EN + FR * 2, RU, "12 + 3", "", None, EN.upper(), "日本"], model)
    assert lang == "fr" and 0.5 < score < 1 and [s[2] for s in spans] == ["en", "fr"]
    assert abs(spans[1][0] - len(EN)) < 12
    assert rest[0][0] == "ru" and rest[0][1] == 1.0
    assert [r[0] for r in rest[1:4]] == ["und"] * 3 and rest[1][2] == []
    assert rest[4][0] == "en" and rest[5][0] in model.langs
    assert rest[5][1] == 0.0 and rest[5][2] == [(0, 2, "und")]
    half = langid.label_texts(["日本語 " + RU], model)[0]
    assert half[0] == "ru" and 0.9 < half[1] < 1 and [x[2] for x in half[2]] == ["und", "ru"]


def slow_label(text, model):
    """As ``label_texts`` for one text, word by word and trigram by trigram."""
    low, k, words = langid.lowered(text), len(model.langs), []
    for m in re.finditer(r"\S+", "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in low)):
        word, score, a, b = m[0], np.zeros(k), 0, 0
        letters = [c for c in word if unicodedata.category(c)[0] == "L"]
        if not letters:
            continue
        for c in [*map(ord, word), 0]:
            h = ((a * 0x9E3779B97F4A7C15 + b) * 0xC2B2AE3D27D4EB4F + c) % 2**64
            h = (h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % 2**64
            score += model.scores[h >> (64 - langid.TABLE_BITS)]
            a, b = (b, c) if b else (0, c)
        allowed = model.allowed[langid.script_table()[ord(letters[0])]]
        words.append((m.start(), m.end(), np.where(allowed, score, score.min() + langid.BARRED) if allowed.any() else np.zeros(k), allowed.any()))
    if not words:
        return "und", 0.0
    _, path = slow_viterbi(np.array([w[2] for w in words]), langid.PENALTY, 1e-9)  # of equal paths, the one that stays
    votes, total = np.zeros(k), 0
    for (start, end, _, counts), g in zip(words, path, strict=True):
        total += end - start
        votes[g] += (end - start) * counts
    return model.langs[votes.argmax()], votes.max() / total


def test_labels_equal_those_of_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs)
    texts = [r["text"] for r in docs.select("text").limit(40).collect()]
    texts = [t[:600] for t in texts if t] + [EN[:40] + RU[:50] + FR[:60] + " 日本 ümlaut", "a", "é 1 ж"]
    for t, (lang, score, _) in zip(texts, langid.label_texts(texts, model), strict=True):
        want = slow_label(t, model)
        assert lang == want[0] and abs(score - want[1]) < 0.02  # a word that both sides of a change score alike may go to either


@pytest.mark.parametrize("text", ["☺️", "\U0001f600 ️", "\u0301\u0300", "12 \u20e3 + 3", "\u0e31", "... — 7", "\u200d"])
def test_without_a_letter_there_is_no_language(model, text):
    assert langid.label_texts([text], model)[0] == ("und", 0.0, []) and slow_label(text, model) == ("und", 0.0)
    with_words = langid.label_texts([f"{text} {EN} {text} {EN}"], model)[0]
    assert with_words[0] == "en" and with_words[1] == 1.0


def test_a_word_that_opens_with_a_mark_has_its_letters_script(model):
    got = langid.label_texts(["\u0301" + RU], model)[0]
    assert got[0] == "ru" and got[1] == 1.0 and got[2][0][0] == 0


def test_scripts_bar_languages(model):
    ok = model.allowed
    cyr = [i for i, (n, _) in enumerate(langid.SCRIPTS, 1) if n == "cyrillic"][0]
    assert ok[cyr].tolist() == [False, False, True] and ok[1].tolist() == [True, True, False]


def test_lower_case_keeps_positions():
    assert len(langid.lowered("İSTANBUL")) == 8


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs.where(langid.fold("doc_id", 4) != 2))
    got = langid.languages(docs.where(langid.fold("doc_id", 4) == 2), model).join(docs, "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.9


def test_held_out_recall_of_every_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where(langid.fold("doc_id", 4) != 2))
    got = langid.languages(docs.where((langid.fold("doc_id", 4) == 2) & docs["lang"].isNotNull()), model).join(docs, "doc_id").collect()
    for lang in {r["lang"] for r in got}:
        assert np.mean([r["lang_pred"] == lang for r in got if r["lang"] == lang]) > 0.9, lang


def test_messy(spark, messy, nothing, model):
    rows = langid.languages(messy, model).collect()
    assert len(rows) == messy.count()
    assert {r["doc_id"]: r["lang_pred"] for r in rows if r["doc_id"] in (2, 3, 4, 10)} == dict.fromkeys((2, 3, 4, 10), "und")
    assert langid.languages(nothing, model).count() == 0
    empty = langid.train(nothing)
    assert {r["lang_pred"] for r in langid.languages(messy, empty).collect()} == {"und"}
