"""Sharding by global prefix sums of bytes: contiguous shards of near equal size.

1. Documents get one global order: a digest of the text, then doc_id, then the
   other columns.  Equal texts so stand together, and everything else is mixed.
   A range partitioning on this order writes the documents once to the shared
   folder; a row's place ``at`` is its partition and its index there.  A last,
   arbitrary key lets repeated rows fill several partitions.
2. The partitions' totals of rows and bytes (one small row each) are summed up to
   prefix sums, so each cut at k/n of all bytes is known to fall into one
   partition.  Only in these, at most n - 1, a running sum over places and sizes
   (no texts) finds the row.
3. A document belongs to the side of a cut on which its middle lies.  A cut inside
   a run of equal texts moves to the run's nearer end where that end is at most
   one largest document away.
4. Shard and slot of a row follow from its place and the cuts.  No text is
   shuffled again.

All of it is built-in SQL and DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.mixing import hex_long
from quern.llm.store import packed, stored, unpacked

N_SHARDS = 8
#: Rows of a partition count from here in ``monotonically_increasing_id``.
PART_BITS = 33


def doc_bytes(text="text"):
    """UTF-8 bytes of a text plus 1; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_key(text="text"):
    """A digest of the text by which equal texts stand together; null counts as empty."""
    return hex_long(F.md5(F.coalesce(text, F.lit(""))), 15)


def _part(at="at"):
    return F.shiftright(at, PART_BITS)


def _index(at="at"):
    return F.col(at).bitwiseAND(F.lit((1 << PART_BITS) - 1))


def in_order(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """``row``, ``size``, ``key`` and ``at`` of every document, written in the global order."""
    others = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name not in ("text", "doc_id") and f.dataType.typeName() not in ("map", "variant")]
    d = packed(docs, doc_bytes().alias("size"), text_key().alias("key"), F.xxhash64(*others).alias("rest") if others else F.lit(0).alias("rest"))
    d = d.withColumn("salt", F.monotonically_increasing_id())
    order = ["key", "row.doc_id", "rest", "salt"]
    d = d.repartitionByRange(partitions, *order) if partitions else d.repartitionByRange(*order)
    d = d.sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return stored(d.select("row", "size", "key", "at"), "in-order")


def part_totals(placed: DataFrame) -> DataFrame:
    """One row per partition: ``part``, rows and bytes before it (``rows0``, ``bytes0``), its own (``rows``, ``bytes``), all (``total``), and the largest document."""
    t = placed.groupBy(_part().alias("part")).agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return t.select("part", "rows", "bytes", first("rows").alias("rows0"), first("bytes").alias("bytes0"), F.sum("bytes").over(whole).alias("total"), F.max("largest").over(whole).alias("largest"))


def cut_rows(placed: DataFrame, totals: DataFrame, n: int) -> DataFrame:
    """``k``, ``at``, ``rank``, ``key``, ``largest``: the first row whose middle lies at or beyond k/n of all bytes, for every k of 1..n-1 that has one."""
    # Cut k falls into a partition if bytes0 < total k / n <= bytes0 + bytes.
    some = totals.where(f"(bytes0 + bytes) * {n} DIV total > bytes0 * {n} DIV total")
    r = placed.select("at", "size", "key", _part().alias("part")).join(F.broadcast(some), "part")
    end = F.col("bytes0") + F.sum("size").over(Window.partitionBy("part").orderBy("at"))
    r = r.withColumn("end", end).withColumn("shard", F.expr(f"(2 * end - size) * {n} DIV (2 * total)"))
    r = r.withColumn("was", F.lag("shard", 1, -1).over(Window.partitionBy("part").orderBy("at")))
    # A partition's first row opens what its base doesn't reach; rows before the base's own shard are other partitions'.
    r = r.withColumn("was", F.greatest("was", F.expr(f"bytes0 * {n} DIV total"))).where("shard > was")
    r = r.select(F.explode(F.sequence(F.col("was") + 1, "shard")).alias("k"), "at", (F.col("rows0") + _index()).alias("rank"), "key", "largest")
    return r.where(f"k < {n}")


def cuts(placed: DataFrame, totals: DataFrame, n: int) -> DataFrame:
    """``k``, ``at``, ``rank`` of the cuts, at most n - 1 rows; a row at or after ``at`` lies beyond cut k.

    A cut that no row's middle reaches inside its partition stands at the
    partition's end.
    """
    c = stored(cut_rows(placed, totals, n), "cut-rows")
    # The run of equal texts around a cut: bytes on both sides, and its ends.
    run = placed.select("key", "at", "size").join(F.broadcast(c.select("k", "key", F.col("at").alias("cut"), "largest", "rank")), "key")
    run = run.groupBy("k", "cut", "rank", "largest").agg(
        F.sum(F.when(F.col("at") < F.col("cut"), F.col("size")).otherwise(0)).alias("left"),
        F.sum(F.when(F.col("at") >= F.col("cut"), F.col("size")).otherwise(0)).alias("right"),
        F.count_if(F.col("at") < F.col("cut")).alias("n_left"),
        F.count_if(F.col("at") >= F.col("cut")).alias("n_right"),
        F.min("at").alias("first"),
        F.max("at").alias("last"),
    )
    back = (F.col("left") <= F.col("right")) & (F.col("left") <= F.col("largest"))
    on = (F.col("left") > 0) & ~back & (F.col("right") <= F.col("largest"))
    at = F.when(back, F.col("first")).when(on, F.col("last") + 1).otherwise(F.col("cut"))
    rank = F.col("rank") + F.when(back, -F.col("n_left")).when(on, F.col("n_right")).otherwise(0)
    moved = run.select("k", at.alias("at"), rank.alias("rank"))
    # Cuts without a row in their partition: its end.
    ks = totals.select(F.explode(F.sequence(F.expr(f"bytes0 * {n} DIV total + 1"), F.expr(f"greatest((bytes0 + bytes) * {n} DIV total, bytes0 * {n} DIV total + 1)"))).alias("k"), "part", "rows0", "rows", "bytes0", "bytes", "total")
    ks = ks.where(f"k < {n} AND k <= (bytes0 + bytes) * {n} DIV total")
    ends = ks.join(F.broadcast(c.select("k")), "k", "left_anti").select("k", (F.shiftleft("part", PART_BITS) + F.col("rows")).alias("at"), (F.col("rows0") + F.col("rows")).alias("rank"))
    return moved.unionByName(ends)


def sharded(docs: DataFrame, n: int = N_SHARDS, partitions: int | None = None) -> DataFrame:
    """``docs`` with ``size`` (bytes plus 1), ``shard`` (0 to n - 1) and ``slot`` (gapless from 0 in each shard).

    Each end of a shard lies within one and a half largest documents of its equal target.
    Null texts count as empty and have size 1; null doc_ids come first among equal
    texts.  Repeated rows are separate documents side by side, in any order.  An
    empty table gives no rows; with fewer documents than shards, or one that is
    larger than a shard, some shards stay empty.  Columns of ``docs`` named
    ``size``, ``shard`` or ``slot`` are replaced.  Reruns agree.  Bytes times
    2 n must stay below 2^63.
    """
    docs = docs.drop("size", "shard", "slot")
    placed = in_order(docs, partitions)
    totals = stored(part_totals(placed), "totals")
    c = stored(cuts(placed, totals, n), "cuts")
    of_part = c.groupBy(_part().alias("part")).agg(F.array_sort(F.collect_list("at")).alias("inside"))
    # Both tables are bounded by the numbers of partitions and of shards.
    p = totals.select("part", "rows0").join(of_part, "part", "left")
    n_inside = F.coalesce(F.size("inside"), F.lit(0))
    p = p.withColumn("shard0", F.coalesce(F.sum(n_inside).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = placed.withColumn("part", _part()).join(F.broadcast(p), "part")
    past = F.when(F.col("inside").isNull(), 0).otherwise(F.size(F.filter("inside", lambda x: x <= F.col("at"))))
    d = d.withColumn("shard", (F.col("shard0") + past).cast("int"))
    first = c.select(F.col("k").cast("int").alias("shard"), F.col("rank").alias("rank0"))
    d = d.join(F.broadcast(first), "shard", "left")
    d = d.withColumn("slot", F.col("rows0") + _index() - F.coalesce("rank0", F.lit(0)))
    return d.select(*[F.col("row").getField(x).alias(x) for x in docs.columns], "size", "shard", "slot")


def write_shards(docs: DataFrame, path: str, n: int = N_SHARDS, partitions: int | None = None) -> None:
    """Write ``docs`` as Parquet with one folder per shard; a shard's rows are found in order by ``slot``."""
    sharded(docs, n, partitions).write.mode("overwrite").partitionBy("shard").parquet(path)


def op12_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return sharded(docs).select("doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 by its polynomial, byte by byte; ``{x}`` is a string.
CRC_TABLE = "crc AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS tbl)"
CRC = "xor(list_reduce(list_transform(range(0, strlen({x})), lambda i: ('0x' || substr(hex(encode({x})), (2 * i + 1)::INT, 2))::BIGINT), lambda a, b: xor(a >> 8, tbl[xor(a & 255, b) + 1]), 4294967295::BIGINT), 4294967295)"

OP12_SQL = f"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, coalesce(text, '') AS text, (strlen(coalesce(text, '')) + 1)::BIGINT AS size, md5(coalesce(text, '')) AS m FROM documents),
o AS (SELECT *, row_number() OVER w - 1 AS rank, (sum(size) OVER w)::BIGINT AS e, (sum(size) OVER ())::BIGINT AS total, max(size) OVER () AS largest FROM d WINDOW w AS (ORDER BY substr(m, 1, 15), doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)),
c AS (SELECT k, min(rank) AS cut FROM o, (SELECT unnest(range(1, 8)) AS k) WHERE (2 * e - size) * 8 // (2 * total) >= k GROUP BY k),
g AS (SELECT k, cut, coalesce(sum(o.size) FILTER (o.rank < cut), 0) AS l, coalesce(sum(o.size) FILTER (o.rank >= cut), 0) AS r, min(o.rank) AS first, max(o.rank) AS last, any_value(o.largest) AS largest
      FROM c JOIN o x ON x.rank = cut JOIN o ON o.m = x.m GROUP BY k, cut),
f AS (SELECT k, CASE WHEN l <= r AND l <= largest THEN first WHEN l > 0 AND r <= largest THEN last + 1 ELSE cut END AS cut FROM g),
s AS (SELECT o.*, (SELECT count(*) FROM f WHERE f.cut <= o.rank) AS shard FROM o)
SELECT doc_id, size, {CRC.format(x="text")} AS text_crc32, 'bytes' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY rank) - 1 AS slot, NULL::INT AS grown_shard FROM s, crc
"""
