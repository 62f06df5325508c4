"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. A document's size is its number of words.  A source's target is its weighted
   share of ``share`` times all words, never above ``max_repeats`` times its own
   words; what is cut off is shared again by weight (water-filling).
2. A source's words are dealt into shards of about ``shard_words`` words by a
   seeded hash of the document, so a hot source has many shards.
3. Blocks of ``block_words`` words are apportioned by Sainte-Lague (highest
   quotients), first to sources by target, then inside a source to its shards by
   size.  This gives an integer quota of blocks per shard.
4. A shard's documents stand in a seeded order and form one stream of words cut
   into blocks.  A quota of q blocks, at most ``max_repeats`` times the stream, is
   that many words: the whole stream as often as it fits, then blocks chosen
   evenly from a seeded start, of which the last is cut where the words are
   reached.  How much of a document that takes has a closed form, so blocks are
   never listed as rows.

Everything is built-in SQL and DataFrame operations.  Only the table of sources
(one row each) and that of shards pass through a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.store import stored

WEIGHTS = (5, 2, 1)


def hex_long(col, digits: int = 12):
    """The first hex digits of a digest as a non-negative long."""
    return F.conv(F.substring(col, 1, digits), 16, 10).cast("long")


def doc_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and ``size``, the number of words; a null text has none."""
    return docs.select("doc_id", "source", F.expr(r"CAST(coalesce(regexp_count(text, '[^\\x20\\x09-\\x0D]+'), 0) AS LONG)").alias("size"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``weight``, ``target``.

    Water-filling in closed form: with caps ``max_repeats * size`` and sources by
    rising cap/weight, the level is the first (budget - caps before) / (weights
    from here on) that doesn't exceed its own cap/weight.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    s = s.withColumn("weight", F.element_at(cycle, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
    s = s.withColumn("cap", F.col("source_size") * max_repeats)
    before = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    s = s.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    s = s.withColumn("caps_before", F.coalesce(F.sum("cap").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("weights_left", F.sum("weight").over(before.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("at", (F.col("budget") - F.col("caps_before")) / F.col("weights_left"))
    s = s.withColumn("level", F.min(F.when(F.col("at") * F.col("weight") <= F.col("cap"), F.struct("caps_before", "at"))).over(everything)["at"])
    level = F.coalesce(F.col("level"), F.lit(float("inf")))
    return s.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("weight") * level).alias("target"))


def divisor(votes: DataFrame, key: list, group: list, vote: str, cap: str, wanted: str, name: str) -> DataFrame:
    """Add ``name``: the d at which the rows' least(cap, vote / d) sum to ``wanted``; 0 where all caps together don't reach it.

    In closed form: rows by rising cap / vote reach their caps in that order, so d
    is the first (votes from here on) / (wanted - caps before) that leaves the row
    below its cap.  Null where ``wanted`` isn't positive.
    """
    w = Window.partitionBy(*group).orderBy(F.try_divide(cap, vote).asc_nulls_last(), *[F.col(k).asc_nulls_last() for k in key])
    before = F.coalesce(F.sum(cap).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum(F.col(vote).cast("double")).over(w.rowsBetween(0, Window.unboundedFollowing))
    at = F.when(F.col(wanted) > before, left / (F.col(wanted) - before))
    fits = F.when((F.col(vote) > 0) & (F.col(vote) <= F.col(cap) * F.col("_at")), F.struct(F.col("_before"), F.col("_at")))
    v = votes.withColumn("_before", before).withColumn("_at", at).withColumn("_fits", fits)
    first = F.min("_fits").over(Window.partitionBy(*group))["_at"]
    return v.withColumn(name, F.when(F.col(wanted) > 0, F.coalesce(first, F.lit(0.0)))).drop("_before", "_at", "_fits")


def sainte_lague(votes: DataFrame, key: list, group: list, vote: str, seats: str, cap: str) -> DataFrame:
    """Add ``quota``: the group's ``seats`` given to its rows by highest quotients vote / (2 s + 1), at most ``cap`` each.

    Ties go to the smallest key, then to the lower s.  A row without votes gets none.

    A row's seats are round(vote / d) for some d, capped.  Rounding n rows shifts a
    sum by at most n / 2; so with the d at which the unrounded, capped shares sum to
    seats - n / 2, no row has more than it gets, and with that for seats + n / 2
    none has less.  Only the quotients between the two, fewer than 4 a row
    together, are ranked.
    """
    n = F.count_if(F.col(vote) > 0).over(Window.partitionBy(*group))
    v = votes.withColumn("_few", F.col(seats) - n / 2).withColumn("_many", F.col(seats) + n / 2)
    v = divisor(v, key, group, vote, cap, "_few", "_high")
    v = divisor(v, key, group, vote, cap, "_many", "_low")
    # One seat of margin on both sides for the rounding of doubles.
    rounded = lambda d, by: F.when(d > 0, F.floor(F.least(F.col(vote) / d, F.col(cap) + 1) + 0.5) + by)
    least = F.greatest(F.coalesce(rounded(F.col("_high"), -1), F.lit(0)), F.lit(0))
    v = v.withColumn("_s0", F.least(least, F.col(cap)).cast("long"))
    most = F.least(F.coalesce(rounded(F.col("_low"), 1), F.col(cap)), F.col(cap)).cast("long")
    v = v.withColumn("_left", F.col(seats) - F.sum("_s0").over(Window.partitionBy(*group))).withColumn("_most", most)
    some = F.when((F.col(vote) > 0) & (F.col("_most") > F.col("_s0")), F.sequence(F.col("_s0"), F.col("_most") - 1))
    v = v.withColumn("_s", F.explode_outer(some))
    order = Window.partitionBy(*group).orderBy((F.col(vote).cast("double") / (2 * F.col("_s") + 1)).desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in key], "_s")
    v = v.withColumn("_won", (F.row_number().over(order) <= F.col("_left")) & F.col("_s").isNotNull())
    keep = [c for c in votes.columns]
    return v.groupBy(*keep, "_s0").agg(F.count_if("_won").alias("_more")).select(*keep, (F.col("_s0") + F.col("_more")).alias("quota"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, max_repeats: int = 2, block_words: int = 8, shard_words: int = 1_000_000, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target and ``taken``: the words of the document that the mix takes, repeats counted.

    A source's taken words are its quota of blocks; that differs from its target
    by about half a block, and by at most a block a shard where the source is
    taken ``max_repeats`` times.  ``taken`` never exceeds
    ``max_repeats * size``.  Reruns agree: the order comes from MD5 of seed and
    doc_id.  Null sources form one source, the last.  Repeated rows are separate
    documents that stand side by side.  An empty table gives no rows; a source
    without words has target 0.
    """
    sizes = stored(doc_sizes(docs), "sizes")
    targets = stored(source_targets(sizes, weights, share, max_repeats), "targets")
    b = int(block_words)
    n_seats = F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / b).cast("long")
    t = targets.withColumn("_g", F.lit(0)).withColumn("seats", n_seats).withColumn("_cap", F.ceil(F.col("source_size") * max_repeats / b))
    quotas = sainte_lague(t, ["source"], ["_g"], "target", "seats", "_cap").drop("_g", "seats", "_cap").withColumnRenamed("quota", "source_quota")
    quotas = quotas.withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)))
    quotas = stored(quotas, "quotas")

    same = F.col("l.source").eqNullSafe(F.col("r.source"))
    d = sizes.alias("l").join(quotas.alias("r"), same).select("l.*", "source_size", "target", "source_quota", "n_shards")
    d = d.withColumn("_m", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    d = d.withColumn("shard", F.pmod(hex_long(F.col("_m")), F.col("n_shards")))
    shards = d.groupBy("source", "shard", "source_quota").agg(F.sum("size").alias("shard_size"))
    shards = shards.withColumn("_cap", F.ceil(F.col("shard_size") * max_repeats / b))
    shards = sainte_lague(shards, ["shard"], ["source", "source_quota"], "shard_size", "source_quota", "_cap").drop("_cap", "source_quota")

    w = Window.partitionBy("source", "shard").orderBy("_m", "doc_id", "size")
    d = d.withColumn("_end", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.alias("l").join(shards.alias("r"), same & (F.col("l.shard") == F.col("r.shard"))).select("l.*", "shard_size", "quota")
    whole, n, end = F.col("shard_size"), F.col("_n"), F.col("_end")
    d = d.withColumn("_words", F.least(F.col("quota") * b, whole * max_repeats))
    d = d.withColumn("_times", F.when(whole > 0, F.floor(F.col("_words") / whole)).otherwise(0))
    d = d.withColumn("_rest", F.col("_words") - F.col("_times") * whole)
    d = d.withColumn("_n", F.ceil(whole / b)).withColumn("_r", F.ceil(F.col("_rest") / b))
    start = hex_long(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("")), F.lit(":"), F.col("shard").cast("string"))))
    # Starts from r on leave out the stream's last block, which may be short, unless all are chosen.
    d = d.withColumn("_u", F.when(F.col("_r") < n, F.col("_r") + F.pmod(start, n - F.col("_r"))).otherwise(0))

    def taken_before(x):
        # Of blocks 0..k-1, floor((k r + u) / n) are chosen; block k is chosen if that number grows.
        k = F.floor(x / b)
        chosen = lambda k: F.floor((k * F.col("_r") + F.col("_u")) / n)
        return F.least(chosen(k) * b + (chosen(k + 1) - chosen(k)) * (x - k * b), F.col("_rest"))

    extra = F.when(n > 0, taken_before(end) - taken_before(end - F.col("size"))).otherwise(0)
    return d.select("doc_id", "source", "size", "source_size", "target", (F.col("_times") * F.col("size") + extra).cast("long").alias("taken"))


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = """
WITH sizes AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s1 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
s2 AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 2 AS cap FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5 AS budget,
         coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS caps_before,
         (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS weights_left FROM s2),
s4 AS (SELECT *, (budget - caps_before) / weights_left AS lvl FROM s3),
lv AS (SELECT arg_min(lvl, caps_before) AS level FROM s4 WHERE lvl * weight <= cap),
tg AS (SELECT source, source_size, least(cap::DOUBLE, weight * coalesce(level, 'inf'::DOUBLE)) AS target FROM s4, lv),
st AS (SELECT *, round((SELECT sum(target) FROM tg) / 8)::BIGINT AS seats, ceil(source_size * 2 / 8.0)::BIGINT AS cap FROM tg),
sq AS (SELECT source, seats, target / (2 * s + 1) AS q, s FROM (SELECT *, unnest(range(0, cap)) AS s FROM st) WHERE target > 0),
sw AS (SELECT source FROM sq QUALIFY row_number() OVER (ORDER BY q DESC, source NULLS LAST, s) <= seats),
qs AS (SELECT t.source, any_value(source_size) AS source_size, any_value(target) AS target, (SELECT count(*) FROM sw WHERE sw.source IS NOT DISTINCT FROM t.source) AS source_quota,
         greatest(1, ceil(any_value(source_size) / 1000000.0))::BIGINT AS n_shards FROM tg t GROUP BY t.source),
d1 AS (SELECT d.*, source_size, target, source_quota, md5('17:' || coalesce(doc_id::VARCHAR, '')) AS m, n_shards FROM sizes d JOIN qs ON d.source IS NOT DISTINCT FROM qs.source),
d2 AS (SELECT *, ('0x' || substr(m, 1, 12))::BIGINT % n_shards AS shard FROM d1),
h0 AS (SELECT source, shard, source_quota, sum(size)::BIGINT AS whole FROM d2 GROUP BY ALL),
hq AS (SELECT *, whole::DOUBLE / (2 * s + 1) AS q FROM (SELECT *, unnest(range(0, ceil(whole * 2 / 8.0)::BIGINT)) AS s FROM h0)),
hw AS (SELECT source, shard FROM hq QUALIFY row_number() OVER (PARTITION BY source ORDER BY q DESC, shard, s) <= source_quota),
h1 AS (SELECT *, (SELECT count(*) FROM hw WHERE hw.source IS NOT DISTINCT FROM h0.source AND hw.shard = h0.shard) AS quota FROM h0),
h2 AS (SELECT *, least(quota * 8, whole * 2) AS words, ceil(whole / 8.0)::BIGINT AS n FROM h1 WHERE whole > 0),
h3 AS (SELECT *, words // whole AS times, words % whole AS rest, ceil((words % whole) / 8.0)::BIGINT AS r FROM h2),
h4 AS (SELECT *, CASE WHEN r < n THEN r + ('0x' || substr(md5('17:' || coalesce(source, '') || ':' || shard::VARCHAR), 1, 12))::BIGINT % (n - r) ELSE 0 END AS u FROM h3),
bl AS (SELECT source, shard, k, least(8, whole - k * 8) AS len, rest FROM (SELECT *, unnest(range(0, n)) AS k FROM h4) WHERE ((k + 1) * r + u) // n > (k * r + u) // n),
bc AS (SELECT source, shard, k, greatest(0, least(len, rest - (sum(len) OVER (PARTITION BY source, shard ORDER BY k) - len))) AS part FROM bl),
e AS (SELECT *, row_number() OVER () AS rid, (sum(size) OVER (PARTITION BY source, shard ORDER BY m, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS e FROM d2),
ek AS (SELECT rid, source, shard, size, e, unnest(range((e - size) // 8, (e - 1) // 8 + 1)) AS k FROM e WHERE size > 0),
x AS (SELECT rid, sum(greatest(0, least(e, ek.k * 8 + part) - greatest(e - size, ek.k * 8))) AS extra
      FROM ek JOIN bc ON ek.source IS NOT DISTINCT FROM bc.source AND ek.shard = bc.shard AND ek.k = bc.k GROUP BY rid)
SELECT doc_id, size, source_size, target, (coalesce(times, 0) * size + coalesce(extra, 0))::BIGINT AS taken
FROM e LEFT JOIN h4 ON e.source IS NOT DISTINCT FROM h4.source AND e.shard = h4.shard LEFT JOIN x USING (rid)
"""
