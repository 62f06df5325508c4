import random
import re

import pytest
from pyspark.sql import functions as F

from quern.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    seen, hit = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {i + k for i in at for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = len(w)
    failed = n < 50 or 100 * len(hit) > 50 * n
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed


def test_measures_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", "a b c a b c", "x"] + ["".join(rng.choice(["a ", "b ", "c\n", "d\t", "é ", "#", "| ", "\x0b", "zz "]) for _ in range(rng.randint(0, 400))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s"))
    got = {r["row"]["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rules.quality_measures(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_upper_hash_bits_that_collide_don_t_hide_repeats(spark, monkeypatch):
    # With nearly all bits given to positions, unequal windows share the rest all the time.
    monkeypatch.setattr(rules, "POS_BITS", 61)
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(40)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").withColumn("w", F.split("t", " ")).select("i", F.expr(rules.repeat_words("w")).alias("n"))
    assert {r["i"]: r["n"] for r in df.collect()} == {i: brute(t)[4] for i, t in enumerate(texts)}


def test_cascade_keeps_the_same_rows_in_any_order(spark, messy):
    order = rules.ranked(messy)
    lazy = sorted(str(r["doc_id"]) for r in rules.keep_documents(messy, order).collect())
    back = sorted(str(r["doc_id"]) for r in rules.keep_documents(messy, order[::-1]).collect())
    eager = sorted(str(r["d"]) for r in rules.quality_measures(messy, order).where("kept").select(F.col("row.doc_id").alias("d")).collect())
    assert lazy == back == eager
    assert rules.keep_documents(messy, order).columns == messy.columns
    scores = [x.score for x in order]
    assert scores == sorted(scores, reverse=True)


def test_order_is_by_rejection_per_cost(spark):
    docs = spark.createDataFrame([(i, "$ " * 60 if i % 2 else " ".join(f"w{k}" for k in range(80)), "s") for i in range(40)], "doc_id long, text string, source string")
    assert rules.ranked(docs)[0].rule.name in ("symbols", "word_length")


def test_rejected_rows_never_reach_the_rules_behind(spark):
    # A rule that can't be computed for two of the texts: it must not run where a rule before rejects.
    docs = spark.createDataFrame([(0, "too short", "s"), (1, "$ " * 60, "s"), (2, " ".join(f"w{k}" for k in range(80)), "s")], "doc_id long, text string, source string")
    raising = rules.Rule("raising", "CASE WHEN n_upper >= 0 AND word_chars < 100 THEN raise_error('measured') ELSE false END", ("n_upper", "word_chars"))
    by_name = {r.name: r for r in rules.RULES}
    order = [rules.Ranked(r, 0.5, 1.0) for r in (by_name["too_short"], by_name["symbols"], raising)]
    assert [r["row"]["doc_id"] for r in rules.quality_measures(docs, order).where("kept").collect()] == [2]
    assert [r["doc_id"] for r in rules.keep_documents(docs, order).collect()] == [2]
    with pytest.raises(Exception, match="measured"):
        rules.keep_documents(docs, order[::-1]).collect()


def test_costs_are_measured(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 90}" for k in range(400)), "s") for i in range(60)], "doc_id long, text string, source string")
    cost = {x.rule.name: x.cost for x in rules.ranked(docs)}
    assert cost["repetitive"] > 2 * cost["too_short"]
    known = {x.rule.name: x.cost for x in rules.ranked(docs, rules.RULES, rules.BASE)}
    assert known["repetitive"] < cost["repetitive"]


def test_empty_table(nothing):
    assert rules.keep_documents(nothing).count() == 0
    assert rules.quality_measures(nothing).count() == 0
