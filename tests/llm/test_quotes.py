import random
from collections import Counter

import duckdb

from quern.llm import quotes

MESSAGES = "conv_id long, turn long, role string, text string"


def quoted(text, level=1):
    return "\n".join(("> " * level).strip() + " " + x for x in text.split("\n"))


def preorder(parents):
    """(conversation, turn) to place, where a reply stands behind what it answers and that one's earlier replies."""
    out = {}
    for c in {k[0] for k in parents}:
        stack, at = [0], 0
        while stack:
            v = stack.pop()
            out[c, v] = at
            at += 1
            stack += sorted((t for (k, t), up in parents.items() if k == c and up == v), reverse=True)
    return out


def test_round_trip_of_nested_quotes(spark):
    """Conversations written as mails that quote their parents come back as they were."""
    rng = random.Random(1)
    say = lambda: "\n".join(" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(3, 9))) + "." for _ in range(rng.randint(1, 3)))
    rows, own, parent = [], {}, {}
    for c in range(30):
        texts = []
        for t in range(rng.randint(1, 6)):
            mine, body = say(), ""
            if t:
                p = rng.randrange(t)
                parent[c, t] = p
                body = "On Monday someone wrote:\n" + quoted(texts[p][0]) + "\n"
                if p:
                    body += quoted(texts[parent[c, p]][0], 2).upper() + "\n"
            texts.append((mine,))
            own[c, t] = mine
            rows.append((c, t, "user", body + mine))
    got = quotes.conversations_of(spark.createDataFrame(rows, MESSAGES).repartition(3)).collect()
    assert len(got) == len(rows)
    order = preorder({k: parent.get(k) for k in own})
    for r in got:
        key = (r["conv_id"], r["turn"])
        assert r["own"] == own[key] and r["parent_turn"] == parent.get(key) and r["position"] == order[key]
        assert r["n_linked"] == r["n_quoted"]


def test_plain_conversation_replies_in_turn(spark):
    got = quotes.conversations_of(spark.createDataFrame([(1, 0, "user", "a"), (1, 2, "user", "b > c"), (1, 1, "assistant", None), (2, 5, "user", "")], MESSAGES)).orderBy("conv_id", "position").collect()
    assert [(r["turn"], r["parent_turn"], r["own"]) for r in got] == [(0, None, "a"), (1, 0, None), (2, 1, "b > c"), (5, None, "")]


def test_quote_of_nobody_and_of_later_turns(spark):
    got = quotes.conversations_of(spark.createDataFrame([(1, 0, "u", "> later words here\nmine"), (1, 1, "u", "later words here"), (1, 2, "u", "> only a quote")], MESSAGES)).orderBy("turn").collect()
    assert [(r["parent_turn"], r["n_quoted"], r["n_linked"], r["own"]) for r in got] == [(None, 2, 0, "mine"), (0, 0, 0, "later words here"), (1, 2, 0, "")]


def test_repeats_empty_and_clashing(spark):
    rows = spark.createDataFrame([(None, 0, "u", "x"), (3, 0, "u", "> x"), (3, 0, "u", "> x"), (3, None, None, None)], MESSAGES)
    for c in ("key", "own", "position", "h", "level"):
        rows = rows.withColumn(c, rows["role"])
    assert quotes.conversations_of(rows).count() == 4
    assert quotes.conversations_of(rows.where("false")).count() == 0


def test_quoted_conversations_link_to_the_quoted_turns(spark):
    sf = "/root/testdata/sf0.001"
    rows = quotes.quoted_conversations(spark, sf).collect()
    plain = {(r["conv_id"], r["turn"], r["role"], r["own_sha256"]) for r in quotes.op7_chat_quotes(spark, sf).collect()}
    quoted = [r for r in rows if r["n_quoted"]]
    assert len(quoted) > len(rows) / 5 and all(r["n_linked"] == r["n_quoted"] for r in quoted)
    assert any(r["parent_turn"] < r["turn"] - 1 for r in quoted)
    assert sum((r["conv_id"], r["turn"], r["role"], r["own_sha256"]) in plain for r in rows) >= 0.95 * len(rows)  # the quotes are gone again


def test_replies_stand_behind_what_they_answer(spark):
    import random

    rng = random.Random(5)
    nodes = [(c, n, None if n == 0 else n - 1 if c == 0 or rng.random() < 0.3 else rng.randrange(n)) for c in range(12) for n in range(1 + c * 7)]
    got = {(r["c"], r["n"]): r["position"] for r in quotes.reply_order(spark.createDataFrame(nodes, "c long, n long, up long")).collect()}
    want = preorder({(c, n): up for c, n, up in nodes})
    assert got == want


def test_repeated_turns_as_in_the_sql(spark):
    """Several messages of one turn, of one role or several, equal ones among them, with quotes of them: the SQL's rows."""
    rng = random.Random(11)
    texts = ["eee", "ddd", "aaa", "bbb", "ccc", "words of some length here", "other words of some length"]
    rows = [(1, 0, "u", t) for t in texts[:5]]
    for c in range(2, 14):
        for t in sorted(rng.choices(range(4), k=9)):
            said = rng.choice(texts)
            rows.append((c, t, rng.choice(("a", "u")), f"> {rng.choice(texts)}\n{said}" if rng.random() < 0.5 else said))
    rows += [(20, 3, "u", None), (20, None, "u", "x"), (20, 3, None, "y"), (20, 3, "u", "z"), (20, 3, "u", "z")]
    rng.shuffle(rows)
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    cols = ["conv_id", "position", "turn", "role", "parent_turn", "n_quoted", "n_linked", "own_sha256"]
    want = Counter(db.execute(f"SELECT {', '.join(cols)} FROM ({quotes.OP7_SQL})").fetchall())
    out = quotes.conversations_of(spark.createDataFrame(rows, MESSAGES).repartition(4))
    own = quotes.F.sha2(quotes.F.coalesce("own", quotes.F.lit("")), 256).alias("own_sha256")
    assert Counter(tuple(r) for r in out.select(*cols[:-1], own).collect()) == want
    assert [r["own"] for r in out.where("conv_id = 1").orderBy("position").collect()] == sorted(texts[:5])
