"""Chat formatting by quotation linking.

A message's lines are read with their quote level (the number of leading ``>``).
Runs of lines of one level are passages.  Quoted passages, and their single
lines, are normalised (lower case, letters and digits only) and hashed; a join
finds the earliest message of the conversation that wrote that passage or line
itself.  A message replies to the message that its level-1 quotes (or, without
any, its least level) match in the most characters, else to the one before.
What a message wrote itself, without quotes and their "... wrote:" lines, is its
text in the conversation.

Only conversations with quotes take part in the join.  Hashes and lengths are
shuffled, not texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.store import dropped, stored

PREFIX = r"^(?:[ \t]*>)+"
#: Lines that announce a quote.
ANNOUNCES = r"(?i)^\s*(on .* wrote|am .* schrieb.*|le .* a écrit|el .* escribió)\s*:\s*$"


def _norm(col):
    return F.trim(F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", " "))


def passages(messages: DataFrame) -> DataFrame:
    """(key, conv_id, turn, pos, level, body, island): every line of the messages that have one, in islands of one level."""
    lines = messages.select("key", "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    prefix = F.regexp_extract("line", PREFIX, 0)
    lines = lines.select("key", "conv_id", "turn", "pos", F.regexp_count(prefix, F.lit(">")).alias("level"), F.substring("line", F.length(prefix) + 1, F.length("line")).alias("body"))
    w = Window.partitionBy("key").orderBy("pos")
    lines = lines.withColumn("_new", F.coalesce((F.col("level") != F.lag("level").over(w)).cast("int"), F.lit(1)))
    return lines.withColumn("island", F.sum("_new").over(w)).drop("_new")


def own_text(text):
    """A message without quoted lines and the lines that announce them; outer line ends are cut."""
    lines = F.split(text, "\n")
    quoted = lambda x: x.rlike(PREFIX)
    keep = F.filter(lines, lambda x, i: ~quoted(x) & ~(x.rlike(ANNOUNCES) & F.coalesce(quoted(F.get(lines, i + 1)), F.lit(False))))
    return F.when(text.contains(">"), F.regexp_replace(F.array_join(keep, "\n"), r"^\n+|\n+\z", "")).otherwise(text)


def keyed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; ``key``, a hash of all four, and ``c``, one of conv_id."""
    m = messages.select("conv_id", "turn", "role", "text")
    return m.withColumn("key", F.xxhash64("conv_id", "turn", "role", "text")).withColumn("c", F.xxhash64("conv_id"))


def links(m: DataFrame) -> DataFrame:
    """(key, c, quoted_turn, n_quoted, n_linked) of the messages of :func:`keyed` that quote; ``quoted_turn`` is null where no quote has a source."""
    asks = m.where(F.col("text").contains(">"))
    lines = passages(m.join(asks.select("conv_id").distinct(), "conv_id", "left_semi").dropDuplicates(["key"]))
    whole = lines.groupBy("key", "conv_id", "turn", "level", "island").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]), " ").alias("body"))
    units = lines.select("key", "conv_id", "turn", "level", "body").unionByName(whole.drop("island"))
    units = units.select("key", "conv_id", "turn", "level", _norm(F.col("body")).alias("norm")).where("norm != ''")
    units = units.select("key", "conv_id", "turn", "level", F.xxhash64("norm").alias("h"), F.length("norm").alias("weight"))
    wrote = units.where("level = 0").groupBy("conv_id", "h").agg(F.min("turn").alias("from_turn"))
    quotes = units.where("level > 0").join(wrote, ["conv_id", "h"], "left")
    quotes = quotes.withColumn("from_turn", F.when(F.col("from_turn") < F.col("turn"), F.col("from_turn")))
    votes = quotes.groupBy("key", "level", "from_turn").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
    best = votes.groupBy("key").agg(
        F.max(F.when(F.col("from_turn").isNotNull(), F.struct(-F.col("level"), F.col("weight"), F.col("from_turn")))).alias("best"),
        F.sum("n").alias("n_quoted"), F.sum(F.when(F.col("from_turn").isNotNull(), F.col("n")).otherwise(0)).alias("n_linked"),
    ).select("key", F.col("best.from_turn").alias("quoted_turn"), "n_quoted", "n_linked")
    return best.join(asks.select("key", "c").distinct(), "key")


def reply_order(nodes: DataFrame) -> DataFrame:
    """(c, n, position) of messages (c, n, up): the preorder of each conversation's reply tree, replies to one message by ``n``.

    ``n`` counts a conversation's messages from 0, and ``up`` is the number of the
    message replied to, null for 0.  Where every message replies to the one before,
    the position is ``n``.  Other trees are walked as a list of entries and exits,
    ranked by pointer doubling: in each round every element jumps over what it knows
    already, so a conversation of m messages takes log2(2 m) joins and is never
    gathered in one task.
    """
    branched = nodes.where("up != n - 1").select("c").distinct()
    t = stored(nodes.join(branched, "c"), "tree")
    chain = nodes.join(branched, "c", "left_anti").select("c", "n", F.col("n").alias("position"))
    first = t.where("up IS NOT NULL").groupBy("c", F.col("up").alias("n")).agg(F.min("n").alias("child"))
    sibling = F.lead("n").over(Window.partitionBy("c", "up").orderBy("n"))
    v = t.withColumn("sibling", F.when(F.col("up").isNotNull(), sibling)).join(first, ["c", "n"], "left")
    enter, leave = 2 * F.col("n"), 2 * F.col("n") + 1
    steps = F.array(
        F.struct(enter.alias("a"), F.coalesce(2 * F.col("child"), leave).alias("b"), F.lit(1).cast("long").alias("w")),
        F.struct(leave.alias("a"), F.coalesce(2 * F.col("sibling"), 2 * F.col("up") + 1).alias("b"), F.lit(0).cast("long").alias("w")),
    )
    e = stored(v.select("c", F.explode(steps).alias("x")).select("c", "x.a", "x.b", "x.w"), "tour")
    while e.where("b IS NOT NULL").limit(1).count():
        on = e.select("c", F.col("a").alias("b"), F.col("b").alias("_b"), F.col("w").alias("_w"))
        going = e.where("b IS NOT NULL").join(on, ["c", "b"]).select("c", "a", F.col("_b").alias("b"), (F.col("w") + F.col("_w")).alias("w"))
        nxt = stored(going.unionByName(e.where("b IS NULL")), "tour")
        dropped(e)
        e = nxt
    size = t.groupBy("c").agg(F.count("*").alias("m"))
    walked = e.where("a % 2 = 0").join(size, "c").select("c", (F.col("a") / 2).cast("long").alias("n"), (F.col("m") - F.col("w")).alias("position"))
    return chain.unionByName(walked)


def conversations_of(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, position, turn, role, parent_turn, n_quoted, n_linked and ``own``, its text without quotes.

    ``position`` counts from 0 in reply order: a message stands behind the one it
    replies to and that one's earlier replies with all theirs.  A null text has no
    quotes and stays null.  A message of quotes only has an empty ``own``.  Repeated
    rows each keep their row; equal turns of one conversation stand by role, then
    text, nulls last, and a reply to a turn is one to its first message.  Null
    conv_ids form one conversation.
    """
    m = keyed(messages)
    found = stored(links(m), "links")
    w = Window.partitionBy("conv_id").orderBy(*[F.col(c).asc_nulls_last() for c in ("turn", "role", "text")])
    number = (F.row_number().over(w) - 1).cast("long")
    # Only conversations with a linked quote can leave the order of turns; their texts are needed for ties alone.
    asked = found.where("quoted_turn IS NOT NULL").select("c").distinct()
    slim = m.join(asked, "c", "left_semi").withColumn("n", number).select("c", "n", "turn", "key").join(found.select("key", "quoted_turn"), "key", "left")
    slim = stored(slim.select("c", "n", "turn", "quoted_turn"), "numbered")
    of_turn = slim.groupBy("c", F.col("turn").alias("quoted_turn")).agg(F.min("n").alias("_up"))
    nodes = slim.join(of_turn, ["c", "quoted_turn"], "left").select("c", "n", F.coalesce("_up", F.when(F.col("n") > 0, F.col("n") - 1)).alias("up"))
    places = reply_order(stored(nodes, "replies"))
    out = m.withColumn("n", number).withColumn("_before", F.lag("turn").over(w)).join(found.drop("c"), "key", "left").join(places, ["c", "n"], "left")
    return out.select(
        "conv_id", F.coalesce("position", "n").cast("long").alias("position"), "turn", "role", F.coalesce("quoted_turn", "_before").alias("parent_turn"),
        F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), own_text(F.col("text")).alias("own"),
    )


def op7_chat_quotes(spark, sf_dir: str) -> DataFrame:
    out = conversations_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.select("conv_id", "position", "turn", "role", "parent_turn", "n_quoted", "n_linked", F.sha2(F.coalesce("own", F.lit("")), 256).alias("own_sha256"))


#: SQL for Spark and DuckDB alike: every message quotes the one that stood one to three messages before it,
#: and some of them a second one, a level deeper; announced by a line, and above what they wrote themselves.
_ORDER = "OVER (PARTITION BY conv_id ORDER BY turn, role, text)"
_QUOTED = (
    "conv_id", "turn", "role", "text", f"CASE turn % 3 WHEN 0 THEN lag(text, 1) {_ORDER} WHEN 1 THEN lag(text, 2) {_ORDER} ELSE lag(text, 3) {_ORDER} END AS q1",
    f"CASE WHEN turn % 2 = 0 THEN lag(text, 4) {_ORDER} END AS q2",
)
_QUOTING = (
    "conv_id", "turn", "role",
    "CASE WHEN q1 IS NULL THEN text ELSE concat(CASE WHEN q2 IS NULL THEN '' ELSE concat('>> ', replace(q2, chr(10), concat(chr(10), '>> ')), chr(10)) END,"
    " 'On the day before she wrote:', chr(10), '> ', replace(q1, chr(10), concat(chr(10), '> ')), chr(10), coalesce(text, '')) END AS text",
)


def quoting(messages: DataFrame) -> DataFrame:
    """The messages with quotes of earlier messages of their conversation put before their texts."""
    return messages.selectExpr(*_QUOTED).selectExpr(*_QUOTING)


def quoted_conversations(spark, sf_dir: str) -> DataFrame:
    """As op7 over all conversations, with quotes made from the messages: the table's own messages hold none."""
    out = conversations_of(quoting(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return out.select("conv_id", "position", "turn", "role", "parent_turn", "n_quoted", "n_linked", F.sha2(F.coalesce("own", F.lit("")), 256).alias("own_sha256"))


OP7_SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, row_number() OVER (ORDER BY conv_id, turn, role, text) AS rid FROM conversations),
l AS (SELECT rid, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM m),
v AS (SELECT *, len(regexp_extract_all(regexp_extract(line, '^(?:[ \t]*>)+'), '>')) AS level, substr(line, length(regexp_extract(line, '^(?:[ \t]*>)+')) + 1) AS body FROM l),
i AS (SELECT *, sum(nw) OVER (PARTITION BY rid ORDER BY pos) AS island FROM (SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY rid ORDER BY pos) THEN 1 ELSE 0 END AS nw FROM v)),
u AS (SELECT rid, conv_id, turn, level, body FROM i UNION ALL SELECT rid, conv_id, turn, level, string_agg(body, ' ' ORDER BY pos) FROM i GROUP BY rid, conv_id, turn, level, island),
n AS (SELECT rid, conv_id, turn, level, trim(regexp_replace(lower(body), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM u),
o AS (SELECT conv_id, norm, min(turn) AS from_turn FROM n WHERE level = 0 AND norm <> '' GROUP BY ALL),
q AS (SELECT rid, level, length(norm) AS weight, CASE WHEN from_turn < turn THEN from_turn END AS from_turn FROM n LEFT JOIN o USING (conv_id, norm) WHERE level > 0 AND norm <> ''),
s AS (SELECT rid, level, from_turn, sum(weight) AS weight, count(*) AS n FROM q GROUP BY ALL),
b AS (SELECT rid, sum(n)::BIGINT AS n_quoted, coalesce(sum(n) FILTER (from_turn IS NOT NULL), 0)::BIGINT AS n_linked FROM s GROUP BY 1),
t AS (SELECT rid, from_turn AS quoted_turn FROM s WHERE from_turn IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rid ORDER BY level, weight DESC, from_turn DESC) = 1),
w AS (SELECT rid, string_agg(line, chr(10) ORDER BY pos) FILTER (level = 0 AND NOT (regexp_matches(line, '(?i)^\s*(on .* wrote|am .* schrieb.*|le .* a écrit|el .* escribió)\s*:\s*$') AND coalesce(nx, 0) > 0)) AS own
      FROM (SELECT *, lead(level) OVER (PARTITION BY rid ORDER BY pos) AS nx FROM v) GROUP BY rid),
z AS (SELECT m.*, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, rid) - 1 AS n, quoted_turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn, role, rid) AS before FROM m LEFT JOIN t USING (rid)),
up AS (SELECT z.rid, z.conv_id, z.n, coalesce((SELECT min(y.n) FROM z y WHERE y.conv_id IS NOT DISTINCT FROM z.conv_id AND y.turn = z.quoted_turn), CASE WHEN n > 0 THEN n - 1 END) AS up FROM z),
p AS (SELECT rid, conv_id, n, [n] AS path FROM up WHERE up IS NULL UNION ALL SELECT up.rid, up.conv_id, up.n, list_append(p.path, up.n) FROM up JOIN p ON up.conv_id IS NOT DISTINCT FROM p.conv_id AND up.up = p.n)
SELECT z.conv_id, row_number() OVER (PARTITION BY z.conv_id ORDER BY path) - 1 AS position, turn, role, coalesce(quoted_turn, before) AS parent_turn,
  coalesce(n_quoted, 0) AS n_quoted, coalesce(n_linked, 0) AS n_linked,
  sha256(coalesce(CASE WHEN text LIKE '%>%' THEN regexp_replace(coalesce(own, ''), '^\n+|\n+\z', '', 'g') ELSE text END, '')) AS own_sha256
FROM z JOIN p USING (rid) LEFT JOIN b USING (rid) LEFT JOIN w USING (rid)
"""
QUOTED_SQL = OP7_SQL.replace("FROM conversations", f"FROM (SELECT {', '.join(_QUOTING)} FROM (SELECT {', '.join(_QUOTED)} FROM conversations))")
