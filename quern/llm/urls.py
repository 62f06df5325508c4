"""URL filters: host and path rules, then a blocked Bloom filter of listed URLs.

A URL's canonical form drops scheme, leading ``www.`` or ``m.``, fragment,
tracking parameters, ``.html`` and closing slashes, and sorts what parameters
remain.  The listed canonical URLs are hashed into a blocked Bloom filter: one
64-bit word picks a 256-bit block and four bits in it, one in each 64-bit lane.
The filter is a table (block, four longs) built by an aggregate.  URLs that it
passes go to an exact hash join with the list, so a false positive of the
filter never shows; URLs that it stops are never shuffled.

Everything is built-in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (action, host and path prefix).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Host labels whose pages the query lists: all that name junk in the table.
LISTED_LABELS = ("casino-win", "cheap-pills", "free-bets", "ads-track", "spam-farm", "adult-x")
BITS_PER_URL = 16
#: Blocks (40 bytes each as rows) up to which the filter is broadcast; a larger filter is joined by shuffle.
BROADCAST_BLOCKS = 1 << 17
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def parsed(pages: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, ``host``, ``path`` and ``canon`` (null for a null URL or one without ``://``)."""
    p = pages.select(*keep, F.col("url").alias("url")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    query = F.regexp_extract("url", r"(?s)^[^?#]*\?([^#]*)", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike("^(utm_[^=]*|ref|fbclid|gclid)(=|$)")))
    path = F.regexp_replace(F.regexp_replace("path", r"/+\z", ""), r"\.html\z", "")
    canon = F.concat(F.regexp_replace("host", r"^(www|m)\.", ""), path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))
    return p.withColumn("canon", F.when(F.instr("url", "://") > 0, canon)).drop("url")


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, null if none does; equally long ones go by longer host, then by name.

    A rule fits its host and all subdomains, if the path starts with the rule's path.
    """
    order = sorted(rules, key=lambda r: (-len(r[1]), -len(r[1].partition("/")[0]), r[1]))
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in reversed(order):
        h, slash, rest = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + rest)
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def _probe(canon: Column, n_blocks: int) -> tuple[Column, list[Column]]:
    """Block number and one bit for each of the four lanes."""
    pick, bits = F.xxhash64(canon), F.xxhash64(canon, F.lit(1))
    block = F.pmod(pick, F.lit(n_blocks))
    return block, [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]


def bloom_filter(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, l0..l3) of the column ``canon`` of ``listed``; blocks without a URL are left out."""
    block, bits = _probe(F.col("canon"), n_blocks)
    return listed.select(block.alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(bits)]).groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"l{i}") for i in range(4)])


def judged(pages: DataFrame, listed: DataFrame, rules=RULES, bits_per_url: int = BITS_PER_URL, broadcast_blocks: int = BROADCAST_BLOCKS, key: str = "page_id") -> DataFrame:
    """(``key``, host, path, rule, verdict, listed) for every row of ``pages`` (``key``, url).

    ``listed`` has a column ``canon``; repeats and nulls in it don't matter.  The
    verdict is the rule's where one fits, else block for a listed URL and allow
    for any other.  A null URL, or one without ``://``, has empty host and path,
    fits no rule, is not listed and is allowed.  Repeated rows are judged alike.
    """
    listed = listed.select("canon").where(F.col("canon").isNotNull()).distinct()
    n = listed.count()
    n_blocks = max(1, -(-n * bits_per_url // 256))
    blocks = bloom_filter(listed, n_blocks)
    few = n_blocks <= broadcast_blocks
    p = parsed(pages, key)
    block, bits = _probe(F.col("canon"), n_blocks)
    p = p.withColumn("block", block)
    if few:
        seen = p.join(F.broadcast(blocks), "block", "left")
    else:  # URLs without a canonical form would all meet in one task
        lanes = [F.lit(None).cast("long").alias(f"l{i}") for i in range(4)]
        seen = p.where("canon IS NOT NULL").join(blocks, "block", "left").unionByName(p.where("canon IS NULL").select("*", *lanes))
    possible = F.col("canon").isNotNull()
    for i, b in enumerate(bits):
        possible = possible & F.coalesce(F.col(f"l{i}").bitwiseAND(b) != 0, F.lit(False))
    cols = [key, "host", "path"]
    rule, action = rule_for(F.col("host"), F.col("path"), rules)
    passed = seen.where(possible).select(*cols, "canon").join(listed.withColumnRenamed("canon", "_hit"), F.col("canon") == F.col("_hit"), "left")
    passed = passed.select(*cols, F.col("_hit").isNotNull().alias("listed"))
    stopped = seen.where(~possible).select(*cols, F.lit(False).alias("listed"))
    both = passed.unionByName(stopped)
    verdict = F.coalesce(action, F.when(F.col("listed"), "block").otherwise("allow"))
    return both.select(*cols, rule.alias("rule"), verdict.alias("verdict"), "listed")


def listed_pages(pages: DataFrame, labels=LISTED_LABELS) -> DataFrame:
    """The list that the query uses: canonical URLs of the pages on hosts with one of ``labels``."""
    return parsed(pages).where(F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, labels)))).select("canon")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judged(pages, listed_pages(pages))


def _sql() -> str:
    order = sorted(RULES, key=lambda r: (-len(r[1]), -len(r[1].partition("/")[0]), r[1]))

    def case(out):
        whens = ""
        for act, text in order:
            h, slash, rest = text.partition("/")
            whens += f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{slash + rest}') THEN '{text if out == 'rule' else act}'"
        return f"CASE{whens} END"

    labels = ", ".join(f"'{x}'" for x in LISTED_LABELS)
    return f"""
WITH r AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, url, rest, coalesce(translate(regexp_extract(rest, '(?s)^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host,
       coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path,
       list_sort(list_filter(string_split(regexp_extract(url, '(?s)^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS params FROM r),
c AS (SELECT *, CASE WHEN rest IS NOT NULL THEN regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(regexp_replace(path, '/+\\z', ''), '\\.html\\z', '')
       || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS canon FROM p),
l AS (SELECT DISTINCT canon FROM c WHERE canon IS NOT NULL AND list_has_any(string_split(host, '.'), [{labels}])),
j AS (SELECT page_id, host, path, {case('rule')} AS rule, {case('act')} AS action, l.canon IS NOT NULL AS listed FROM c LEFT JOIN l ON c.canon = l.canon)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM j
"""


OP1_SQL = _sql()
