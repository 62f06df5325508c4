"""Append-only ledgers: effective reactions, harvest, demotion, cache statistics, pruning, receipts, turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text


def joinable(turn_id="turn_id") -> Column:
    """Harvest's predicate: an id that isn't empty or ``none``."""
    return ~F.coalesce(text.col(turn_id), F.lit("")).isin("", "none")


def real_turn(turn_id="turn_id") -> Column:
    """Reconciliation's predicate: no placeholder by prefix either."""
    t = F.coalesce(text.col(turn_id), F.lit(""))
    return (t != "") & ~t.startswith("none") & ~t.startswith("unknown")


def standing() -> Column:
    """A retrospective line beats all live lines; among equals the later line wins."""
    return F.struct(F.coalesce(F.col("phase") == "retro", F.lit(False)).alias("retro"), F.col("line_no").alias("line_no"))


def effective(reactions: DataFrame) -> DataFrame:
    """One line per joinable turn, the one that stands; a standing ``retracted`` removes the turn."""
    cols = [c for c in reactions.columns if c != "turn_id"]
    best = reactions.where(joinable()).groupBy("turn_id").agg(F.max_by(F.struct(*cols), standing()).alias("r"))
    return best.select("turn_id", "r.*").where("NOT (label <=> 'retracted')")


def unjoinable(reactions: DataFrame) -> Column:
    return F.count_if(~joinable())


def signals(reactions: DataFrame, turns: DataFrame) -> DataFrame:
    """Effective reactions with their turn (null where it is missing) as struct ``turn``."""
    t = turns.select(F.col("turn_id").alias("_t"), F.struct(*[c for c in turns.columns if c != "turn_id"]).alias("turn"))
    return effective(reactions).join(t, F.col("turn_id") == F.col("_t"), "left").drop("_t")


LABELS = {"accept": "confirmed", "reject": "wrong", "partial": "partial"}


def human_label() -> Column:
    live = F.lit(None).cast("string")
    for k, v in LABELS.items():
        live = F.when(F.col("reaction") == k, v).otherwise(live)
    return F.when(F.coalesce("label", F.lit("")) != "", F.col("label")).otherwise(live)


RUNNABLE = ("challenge", "validate")
PLAIN_WORD = r"\A[A-Za-z][A-Za-z -]*\z"
TRUNCATED = r"(?:\.\.\.|…)\z"


def proposals(sig: DataFrame, harvested: DataFrame | None = None) -> DataFrame:
    """(id, kind, turn_id, subcommand, scope, request, claim, verdict, cites, label, evidence): up to three per signal.

    ``sig`` is :func:`signals`; ``turn`` has scope, request, verdict, claim, diff and cites.  Turns in ``harvested`` are passed over.
    """
    if harvested is not None:
        sig = sig.join(harvested.select("turn_id").distinct(), "turn_id", "left_anti")
    s = sig.withColumn("h", human_label()).withColumn("v", F.when(F.coalesce("verdict", F.lit("")) != "", F.col("verdict")).otherwise(F.col("turn.verdict")))
    whole = (F.coalesce("turn.claim", F.lit("")) != "") & (F.coalesce("turn.diff", F.lit("")) != "")
    runnable = F.col("subcommand").isin(*RUNNABLE) & F.col("turn").isNotNull() & ~F.coalesce("turn.request", F.lit("")).rlike(TRUNCATED)
    kind = F.when(F.col("h") == "confirmed", F.when(whole | runnable, "eval_case").otherwise("eval_pointer")).when(F.col("h").isin("wrong", "partial"), "investigate")

    def rows(df, kind, claim, cites):
        return df.select(F.concat_ws(":", kind, "turn_id").alias("id"), kind.alias("kind"), "turn_id", "subcommand", F.col("turn.scope").alias("scope"), F.col("turn.request").alias("request"), claim.alias("claim"), F.col("v").alias("verdict"), cites.alias("cites"), F.col("h").alias("label"), F.col("note").alias("evidence"))

    labelled = rows(s.where(kind.isNotNull()), kind, F.when((F.col("h") == "confirmed") & whole, F.col("turn.claim")), F.when((F.col("h") == "confirmed") & whole, F.col("turn.cites")))
    plain = lambda x: F.trim(x).rlike(PLAIN_WORD)
    cites = F.coalesce("unresolved_cites", F.array().cast("array<string>"))
    s = s.withColumn("gaps", F.array_sort(F.filter(cites, lambda x: ~plain(x)))).withColumn("terms", F.array_sort(F.transform(F.filter(cites, plain), F.trim)))
    no = F.lit(None).cast("string")
    gaps = rows(s.where(F.size("gaps") > 0), F.lit("corpus_gap"), no, F.col("gaps"))
    terms = rows(s.where(F.size("terms") > 0), F.lit("dictionary_term"), no, F.col("terms"))
    return labelled.unionByName(gaps).unionByName(terms)


# Surfaces that can be promoted, and what counts as their hard block.
HARD_PROCEED = {"challenge": "abort", "validate": "block"}
HARD_VERDICTS = {"challenge": ("INVALID", "OUT_OF_SCOPE"), "validate": ("failed",)}


def dispositions(reactions: DataFrame, state: DataFrame, turns: DataFrame) -> DataFrame:
    """Every reaction line with ``action`` (demoted, skipped) and ``reason``.

    ``state``: surface, blocking, promoted_at.  The first line per surface that
    passes every test demotes it.
    """
    best = reactions.where(real_turn()).groupBy("turn_id").agg(F.max_by("line_no", standing()).alias("best_line"), F.max_by("label", standing()).alias("best_label"))
    t = turns.select("turn_id", F.col("verdict").alias("t_verdict"), F.col("proceed").alias("t_proceed"))
    r = reactions.join(best, "turn_id", "left").join(t, "turn_id", "left").join(F.broadcast(state.withColumnRenamed("surface", "subcommand")), "subcommand", "left")
    label, real = human_label(), real_turn()
    verdict = F.when(F.coalesce("verdict", F.lit("")) != "", F.col("verdict")).otherwise(F.when(real, F.col("t_verdict")))
    proceed = F.when(real, F.col("t_proceed"))
    hard = F.lit(False)
    for s in HARD_PROCEED:
        is_hard = F.when(F.coalesce(proceed, F.lit("")) != "", proceed == HARD_PROCEED[s]).otherwise(verdict.isin(*HARD_VERDICTS[s]))
        hard = F.when(F.col("subcommand") == s, is_hard).otherwise(hard)
    since, at = text.parse_time("promoted_at"), text.parse_time("ts")
    known = F.col("subcommand").isin(*HARD_PROCEED)
    reason = (
        F.when(real & F.col("best_label").eqNullSafe("retracted"), "retracted")
        .when(real & (F.col("best_line") != F.col("line_no")), "superseded").when(~F.coalesce(known, F.lit(False)), "not a promotable surface")
        .when(label.isNull(), "no human label").when(label != "wrong", "not a confirmed false block")
        .when((F.coalesce(proceed, F.lit("")) == "") & (F.coalesce(verdict, F.lit("")) == ""), "no verdict evidence").when(~F.coalesce(hard, F.lit(False)), "not the hard block")
        .when(~F.coalesce("blocking", F.lit(False)), "surface is advisory").when(since.isNull(), "unparseable promoted_at").when(at.isNull(), "unparseable ts").when(at <= since, "predates promotion")
    )
    out = r.withColumn("_why", reason)
    first = out.where("_why IS NULL").groupBy("subcommand").agg(F.min("line_no").alias("_first"))
    out = out.join(F.broadcast(first), "subcommand", "left")
    why = F.when(F.col("_why").isNull() & (F.col("line_no") != F.col("_first")), "already demoted").otherwise(F.col("_why"))
    return out.select("line_no", "turn_id", "subcommand", F.when(why.isNull(), "demoted").otherwise("skipped").alias("action"), why.alias("reason"))


# ---------------------------------------------------------------- response cache


def hit_rate(hits, drifts, misses) -> Column:
    """The honestly served share: a drift is a hit that called live anyway; without traffic 0."""
    h, d, m = (text.col(x) for x in (hits, drifts, misses))
    served = F.greatest(h - d, F.lit(0))
    total = served + m + d
    return F.when(total == 0, 0.0).otherwise(served / total)


def cache_stats(log: DataFrame) -> DataFrame:
    """One row: events by kind, token sums of stores, hit rate in percent."""
    kinds = {"hit": "hits", "miss": "misses", "store": "stores", "invalidate": "invalidates", "drift": "drifts", "prune": "prunes"}
    tokens = lambda c: F.coalesce(F.sum(F.when(F.col("event") == "store", F.col(c))), F.lit(0)).cast("long")
    s = log.agg(*[F.count_if(F.col("event") == k).alias(v) for k, v in kinds.items()], tokens("cache_creation_tokens").alias("cache_creation_tokens"), tokens("cache_read_tokens").alias("cache_read_tokens"))
    return s.withColumn("hit_rate_pct", 100 * hit_rate("hits", "drifts", "misses"))


def prune(objects: DataFrame, cutoff=None, max_bytes: int | None = None, everything: bool = False, per_bucket: int = 100_000) -> DataFrame:
    """Objects (path, size, mtime) to delete: those older than ``cutoff``, then the oldest until ``max_bytes`` hold the rest.

    The running size comes from two levels: sums per bucket of about
    ``per_bucket`` objects, then a window inside each bucket, so no task sees all
    objects.  Buckets are ranges of (mtime, path), so equal times don't share one.
    """
    if cutoff is None and not max_bytes and not everything:
        raise ValueError("refusing a prune without bounds")
    if everything:
        return objects.select("path", "size", F.lit("all").alias("reason"))
    old = F.lit(False) if cutoff is None else F.coalesce(F.col("mtime") < F.lit(cutoff), F.lit(False))
    aged = objects.where(old).select("path", "size", F.lit("age").alias("reason"))
    if not max_bytes:
        return aged
    rest = objects.where(~old)
    edges = rest.agg(F.count("*").alias("n"), F.sum("size").alias("total")).first()
    if not edges["n"] or edges["total"] <= max_bytes:
        return aged
    # A range partition is a bucket: it is sorted once, and its number orders it.
    rest = rest.repartitionByRange(max(1, -(-edges["n"] // per_bucket)), "mtime", "path").withColumn("_b", F.spark_partition_id())
    sums = rest.groupBy("_b").agg(F.sum("size").alias("_s"))
    before = sums.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_b").orderBy("mtime", "path").rowsBetween(Window.unboundedPreceding, -1)
    rest = rest.join(F.broadcast(before), "_b").withColumn("_cum", F.col("_before") + F.coalesce(F.sum("size").over(w), F.lit(0)))
    return aged.unionByName(rest.where(edges["total"] - F.col("_cum") > max_bytes).select("path", "size", F.lit("size").alias("reason")))


# ---------------------------------------------------------------- receipts and turns


def latest_receipt(receipts: DataFrame, by: list[str] | None = None, **wanted) -> DataFrame:
    """The newest line that matches all non-empty filters (per group with ``by``)."""
    r = receipts
    for k, v in wanted.items():
        if v not in (None, ""):
            r = r.where(F.col(k) == v)
    best = F.max_by(F.struct(*receipts.columns), "line_no").alias("r")
    return (r.groupBy(*by).agg(best) if by else r.agg(best)).where("r IS NOT NULL").select("r.*")


def turn_stats(turns: DataFrame) -> DataFrame:
    return turns.agg(F.count("*").alias("total"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    return turns.orderBy(F.col("turn_id").desc()).limit(n).orderBy("turn_id")


def high_water(reactions: DataFrame) -> DataFrame:
    return reactions.agg(F.max("ts").alias("high_water"))


# ---------------------------------------------------------------- response cache, by key


def answered(requests: DataFrame, log: DataFrame) -> DataFrame:
    """``requests`` (key, ...) with ``answer`` and ``status`` (hit, miss) from a log of stores and invalidations (key, event, answer, line_no).

    The last of a key's stores and invalidations counts.
    """
    last = log.where("event IN ('store', 'invalidate')").groupBy("key").agg(F.max_by(F.struct("event", "answer"), "line_no").alias("x"))
    live = last.where("x.event = 'store'").select("key", F.col("x.answer").alias("answer"), F.lit(True).alias("_hit"))
    return requests.join(live, "key", "left").withColumn("status", F.when(F.col("_hit"), "hit").otherwise("miss")).drop("_hit")


def drifts(answers: DataFrame, live: DataFrame) -> DataFrame:
    """(key, event): a drift for every hit whose live answer (key, answer) is another than the kept one."""
    now = live.select("key", F.col("answer").alias("_now"))
    return answers.where("status = 'hit'").join(now, "key").where("NOT answer <=> _now").select("key", F.lit("drift").alias("event"))
