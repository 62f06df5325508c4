"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

A rule is a SQL predicate over a text's measures.  On a bounded sample each
rule gets a selectivity (share of rows it rejects) and a cost (the seconds that
the sample takes with it, less those without).  Rules then stand in ``OR`` by
falling selectivity/cost; a rule's measures are computed inside its own branch,
so that a text rejected by a cheap rule is never measured by a dear one.  The
verdict does not depend on the order.

Everything is built-in SQL: no Python runs on the executors.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.store import dropped, packed, stored, unpacked

#: Java and RE2 read this class alike.
WORD = r"[^\\x20\\x09-\\x0D]+"
WORDS = f"regexp_extract_all(%s, '{WORD}', 0)"
POS_BITS = 24


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def repeat_words(words: str) -> str:
    """SQL: how many words lie in a 3-word window that the array ``words`` holds twice or more.

    Windows are hashed to 64 bits.  Where hashes repeat, (upper hash bits,
    position) pairs are sorted as plain longs, so that equal windows become
    neighbours.  Two different windows that share the upper bits could stand
    between equal ones; such a text, or one beyond 2**24 words, takes the slower
    sort of whole hashes.  Nothing is quadratic in the number of words.
    """
    mask = (1 << POS_BITS) - 1
    pos = f"CAST(v & {mask} AS INT)"
    nxt, prv = "get(s, j + 1)", "get(s, j - 1)"
    at = lambda v: f"get(h, CAST({v} & {mask} AS INT))"
    packed = f"sort_array(transform(h, (x, i) -> (x & {~mask}L) | CAST(i AS BIGINT)))"
    marked = f"sort_array(transform(filter(s, (v, j) -> coalesce({at('v')} = {at(nxt)}, false) OR coalesce({at('v')} = {at(prv)}, false)), v -> {pos}))"
    mixed = f"exists(transform(s, (v, j) -> coalesce(shiftright(v ^ {nxt}, {POS_BITS}) = 0L AND {at('v')} != {at(nxt)}, false)), b -> b)"
    full = "array_sort(transform(h, (x, i) -> struct(x AS x, i AS i)))"
    slow = "sort_array(transform(filter(z, (v, j) -> coalesce(v.x = get(z, j + 1).x, false) OR coalesce(v.x = get(z, j - 1).x, false)), v -> v.i))"
    slow = let(full, "z", slow)
    fast = let(packed, "s", f"CASE WHEN {mixed} THEN {slow} ELSE {marked} END")
    cover = "aggregate(transform(p, (q, j) -> coalesce(least(3, get(p, j + 1) - q), 3)), 0L, (a, b) -> a + b)"
    hashes = f"transform(sequence(0, size({words}) - 3), i -> xxhash64(get({words}, i), get({words}, i + 1), get({words}, i + 2)))"
    found = f"CASE WHEN size(array_distinct(h)) = size(h) THEN 0L WHEN size(h) > {mask} THEN {let(slow, 'p', cover)} ELSE {let(fast, 'p', cover)} END"
    return f"CASE WHEN size({words}) < 4 THEN 0L ELSE {let(hashes, 'h', found)} END"


def dup_lines(text: str) -> str:
    """SQL: lines with a word that equal an earlier line of the text."""
    lines = f"filter(split({text}, '\\n'), l -> l RLIKE '{WORD}')"
    return let(lines, "ls", "CAST(size(ls) - size(array_distinct(ls)) AS BIGINT)")


#: The measures of a text, as SQL over columns ``t`` (never null) and ``w`` (its words).
MEASURES = {
    "n_words": "CAST(size(w) AS BIGINT)",
    "word_chars": "CAST(length(array_join(w, '')) AS BIGINT)",
    "n_symbols": "CAST(regexp_count(t, '[#*$%&|<>]') AS BIGINT)",
    "n_dup_lines": dup_lines("t"),
    "n_repeat_words": repeat_words("w"),
    "n_lines": "CAST(regexp_count(t, '[^\\\\n]*[^\\\\x20\\\\x09-\\\\x0D][^\\\\n]*') AS BIGINT)",
    "n_upper": "CAST(regexp_count(t, '\\\\p{Lu}') AS BIGINT)",
    "n_bangs": "CAST(regexp_count(t, '[!?]{2}') AS BIGINT)",
}


#: Measures that a result holds for every row, rejected or not.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``reject`` is SQL over the measures ``needs``; ``base`` rules decide ``base_failed``."""

    name: str
    reject: str
    needs: tuple[str, ...]
    base: bool = False

    def branch(self, known: tuple[str, ...] = ()) -> str:
        """SQL: the rule over columns or lambda variables t, w and (with the measures ``known``) b; it computes what else it needs."""
        own = [n for n in self.needs if n not in known]
        reject = re.sub(r"\b[a-z]\w*\b", lambda x: f"b.{x[0]}" if x[0] in known else f"m.{x[0]}" if x[0] in own else x[0], self.reject)
        return f"({let(f'struct({_fields(own)})', 'm', reject) if own else reject})"


RULES = (
    Rule("too_short", "n_words < 50", ("n_words",), base=True),
    Rule("repetitive", "100 * n_repeat_words > 50 * n_words", ("n_repeat_words", "n_words"), base=True),
    Rule("symbols", "10 * n_symbols > 3 * n_words", ("n_symbols", "n_words")),
    Rule("shouting", "2 * n_upper > word_chars", ("n_upper", "word_chars")),
    Rule("emphasis", "5 * n_bangs > n_words", ("n_bangs", "n_words")),
    Rule("dup_lines", "2 * n_dup_lines > n_lines AND n_dup_lines > 1", ("n_dup_lines", "n_lines")),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 25 * n_words", ("word_chars", "n_words")),
)


@dataclass(frozen=True)
class Ranked:
    """``cost``: seconds per sampled row."""

    rule: Rule
    selectivity: float
    cost: float

    @property
    def score(self) -> float:
        return self.selectivity / self.cost


def _fields(names) -> str:
    return ", ".join(f"{MEASURES[n]} AS {n}" for n in names)


def _texts(docs: DataFrame) -> DataFrame:
    return packed(docs, F.expr("coalesce(text, '')").alias("t"))


def ranked(docs: DataFrame, rules: tuple[Rule, ...] = RULES, known: tuple[str, ...] = (), sample_rows: int = 2000, rounds: int = 2) -> list[Ranked]:
    """``rules`` by falling rejection per cost, from about ``sample_rows`` rows picked by a hash of their content.

    Each rule runs over the stored sample by itself, ``rounds`` times; the least
    time counts, less that of splitting words alone.  Measures ``known`` are there
    beforehand and cost nothing.  A small sample is repeated until it has
    ``sample_rows`` rows, so that times can be told apart.  One mean a rule reaches
    the driver.  An empty table leaves the given order.
    """
    total = docs.count()
    if not total or not rules:
        return [Ranked(r, 0.0, 1.0) for r in rules]
    buckets = max(1, total // sample_rows)
    picked = docs.select("text", F.xxhash64("doc_id", "source").alias("k")).where(F.pmod(F.col("k"), F.lit(buckets)) == 0)
    have = F.expr(let(WORDS % "t", "w", f"struct({_fields(known)})")) if known else F.lit(0)
    sample = stored(_texts(picked).select("t", have.alias("b")).repartition(8), "rule_sample")
    n = sample.count()
    if not n:
        return [Ranked(r, 0.0, 1.0) for r in rules]
    times = -(-sample_rows // n)
    many = sample.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))

    def run(test: str) -> tuple[float, float]:
        start = time.perf_counter()
        share = many.agg(F.avg(F.expr(f"CAST({let(WORDS % 't', 'w', test)} AS DOUBLE)"))).first()[0]
        return time.perf_counter() - start, share or 0.0

    tests = ["size(w) < 0", *[r.branch(known) for r in rules]]
    spent, shares = [float("inf")] * len(tests), [0.0] * len(tests)
    for _ in range(rounds):
        for i, test in enumerate(tests):
            seconds, shares[i] = run(test)
            spent[i] = min(spent[i], seconds)
    dropped(sample)
    floor = max(0.02 * spent[0], 1e-6)  # below that, differences are noise
    out = [Ranked(r, shares[i], max(floor, spent[i] - spent[0]) / (n * times)) for i, r in enumerate(rules, 1)]
    return sorted(out, key=lambda x: (-x.score, x.cost, x.rule.name))


def quality_measures(docs: DataFrame, order: list[Ranked] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every document's base measures and verdict: ``row`` (the input row), the measures, ``base_failed``, ``kept``.

    The base measures are wanted for each row.  The other rules stand behind
    ``base_failed`` and behind each other in the order of :func:`ranked`; what they
    measure beyond the base is computed only for rows that no rule before rejects.

    Nulls: a null text is empty.  Empty: no words, so ``base_failed``.  Repeated
    rows are judged one by one.  Other columns and their names don't matter.
    """
    order = ranked(docs, tuple(r for r in rules if not r.base), BASE) if order is None else order
    failed = " OR ".join(r.branch(BASE) for r in rules if r.base) or "false"
    rest = " OR ".join([f"({failed})", *[x.rule.branch(BASE) for x in order if not x.rule.base]])
    fields = ", ".join(f"b.{n} AS {n}" for n in BASE)
    # One expression over words bound by a lambda: a later filter on a measure may repeat it, but
    # can't put the split of the text into its loops.
    judged = let(f"struct({_fields(BASE)})", "b", f"struct({fields}, ({failed}) AS base_failed, NOT ({rest}) AS kept)")
    m = _texts(docs).select("row", F.expr(let(WORDS % "t", "w", judged)).alias("m"))
    return m.select("row", *[f"m.{n}" for n in (*BASE, "base_failed", "kept")])


def keep_documents(docs: DataFrame, order: list[Ranked] | None = None) -> DataFrame:
    """``docs`` without the documents that a rule rejects, by a lazy cascade.

    Each rule's measures are computed inside its own branch, so a row pays only
    for the rules up to the first that rejects it.
    """
    order = ranked(docs) if order is None else order
    # The words are bound by a lambda: as a column, the optimizer would push the filter below it and
    # so put the split of the text into every use, inside the loops over positions too.
    rejected = let(WORDS % "t", "w", " OR ".join(x.rule.branch() for x in order) or "false")
    return unpacked(_texts(docs).where(~F.expr(rejected)), docs)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = quality_measures(docs)
    return out.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


OP8_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
pos AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM pos) WHERE n > 1),
cov AS (SELECT rid, sum(least(3, coalesce(nx - i, 3)))::BIGINT AS n_repeat_words FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM rep) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        len(regexp_extract_all(t, '\\p{Lu}'))::BIGINT AS n_upper, len(regexp_extract_all(t, '[!?]{2}'))::BIGINT AS n_bangs
      FROM w LEFT JOIN cov USING (rid)),
v AS (SELECT doc_id, n_words, word_chars, n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_repeat_words, len(ls) AS n_lines, n_upper, n_bangs,
        (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 2 * n_upper > word_chars OR 5 * n_bangs > n_words
       OR (2 * n_dup_lines > n_lines AND n_dup_lines > 1) OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept
FROM v
"""
