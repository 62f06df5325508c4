import re

import pytest
from pyspark.sql import functions as F

from quern.functions import dims, ids, text
from quern.operators import chunkers, datasets, evalx, graph, ledger, symbols, sync, vectors
from quern.plans import index, steps


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f("x").alias("y")).first()["y"]


# ---------------------------------------------------------------- text


@pytest.mark.parametrize("s,n,want", [("aé", 2, "a"), ("aé", 3, "aé"), ("日本", 4, "日"), ("\U0001f600x", 3, ""), ("abc", 2, "ab"), ("", 2, ""), ("é", 1, "")])
def test_cap_utf8(spark, s, n, want):
    assert one(spark, s, lambda c: text.cap_utf8(c, n)) == want


def test_cap_lines(spark):
    assert one(spark, "ab\ncdef", lambda c: text.cap_lines(c, 5)) == "ab\n... [truncated, original 7 bytes]"
    assert one(spark, "abcdefg", lambda c: text.cap_lines(c, 5)) == "abcde\n... [truncated, original 7 bytes]"


def test_lines(spark):
    for s, want in (("", []), ("a", ["a"]), ("a\r\nb\n", ["a", "b"]), ("\n", [""]), ("a\n\n", ["a", ""])):
        assert one(spark, s, text.lines_of) == want == chunkers.scan_lines(s)


def test_cites(spark):
    assert one(spark, "éD17 D18 xD1 AP3, SB-04 WA-L-2 ABB-1a D-563a AP-720-2", text.cites) == ["ABB-1a", "AP3", "D-563a", "D17", "D18", "SB-04", "WA-L-2"]
    assert one(spark, "AP2 D1 UTF-8 D1", text.commit_cites) == ["D1", "AP2", "UTF-8"]


def test_classes(spark):
    for s, form, mode in (("What?", "question", ""), ("Go!", "imperative", ""), ("If a, b", "conditional", "conditional"), ("It is not so", "negation", ""), ("Run the thing", "imperative", ""), ("You MUST NOT go", "negation", "forbidden"), ("You should prefer it", "affirmation", "recommended"), ("", "affirmation", "")):
        assert one(spark, s, text.syntactic_form) == form and one(spark, s, text.modality) == mode


def test_slugs(spark):
    assert one(spark, " A_b - C! ", lambda c: text.slug_anchor(c, F.lit(3))) == "a-b---c"
    assert one(spark, "!!", lambda c: text.slug_anchor(c, F.lit(3))) == "section-3" == chunkers.slug("!!", 3)
    assert one(spark, "A_b - C/d!", text.slug_words) == "a-b-c-d"


def test_scalars(spark):
    assert [one(spark, s, text.parse_bytes) for s in ("12", "3k", "4M", "1G", "x", "", "99999999999999999G")] == [12, 3072, 4 << 20, 1 << 30, None, None, None]
    assert one(spark, "a {b {c}} d", text.json_object_in) == "{b {c}}"
    assert one(spark, "```json\n{}\n```", text.strip_fence) == "{}"
    assert [one(spark, s, lambda c: text.parse_time(c).isNotNull()) for s in ("2026-01-01T00:00:00Z", "2026-01-01T00:00:00", "2026-01-01", "soon")] == [True, True, True, False]
    assert one(spark, "catch (E e) { }\nconsole.log(1)", text.code_signals) == "empty catch/except swallowed exception; console logging left in code"
    assert one(spark, "src/Test/AUTH/x", text.path_concerns) == ["security", "testing"]


def test_ids(spark):
    import hashlib

    df = spark.createDataFrame([("s", "a", "b")], "s string, a string, b string")
    r = df.select(ids.chunk_id("s", "a", "b").alias("c"), ids.cache_key("s", "a").alias("k"), ids.symbol_id("s", F.lit(3), "b").alias("y")).first()
    assert r["c"] == hashlib.sha1(b"s\0a\0b").hexdigest() and r["k"] == hashlib.sha256(b"1:s1:a").hexdigest() and r["y"] == "SYM-" + hashlib.sha1(b"s:3:b").hexdigest()[:12]


def test_dims(spark):
    assert one(spark, "workflows/web/x.md", dims.path_scope) == "webapp" and one(spark, "zzz", dims.path_scope) == "universal"
    assert one(spark, "decisions/a.yaml", dims.path_doc_type) == "decision" and one(spark, "decisions/a.md", dims.path_doc_type) == "doc"
    assert one(spark, "a/Dockerfile", dims.language) == "dockerfile" and one(spark, "a/b.TSX", dims.language) == "typescript"
    assert dims.with_universal(["a", "universal", "a"]) == ["a", "universal"]


# ---------------------------------------------------------------- chunkers and symbols


def test_markdown_sections():
    body = "# Title\nlost\n## A\n" + "x" * 300 + "\n```\n## not a heading\n```\n## B\nshort\n## C\n" + "y " * 150 + "\n### C1\n" + "z" * 900 + "\n### C2\n" + "q" * 900 + "\n"
    title, s = chunkers.markdown_sections(body)
    assert title == "Title" and [x.title for x in s] == ["A", "B + C > C1", "C > C2"]
    assert "## not a heading" in s[0].body and "lost" not in "".join(x.body for x in s)
    assert any("lost" in x.body for x in chunkers.markdown_sections(body, keep_preamble=True)[1])


def test_packing():
    parts = chunkers.paragraphs("a\nb\n\n```\nc\n\nd\n```\n\n\ne\n")
    assert parts == ["a\nb\n", "```\nc\n\nd\n```\n", "e\n"]
    assert chunkers.pack(["a" * 700, "b" * 700, "c" * 700, "d" * 2000, "e"]) == ["a" * 700 + "\n\n" + "b" * 700, "c" * 700, "d" * 2000, "e"]


def test_yaml_chunks(spark):
    raw = "rules:\n- id: D1\n  severity: low\n  n: 1\n- name: x\nother: 3\n"
    files = spark.createDataFrame([("decisions/a.yaml", "s", "universal", "decision", raw), ("decisions/b.yaml", "s", "universal", "decision", "a: [")], "source string, source_sha string, scope string, doc_type string, text string")
    got = chunkers.chunk_files(files).orderBy("seq").collect()
    assert [(r["source_anchor"], r["artifact_id"], r["severity"], r["body"]) for r in got] == [("decisions/a.yaml#D1", "D1", "LOW", "id: D1\nn: '1'\nseverity: low"), ("decisions/a.yaml#item-1", None, None, "name: x")]


@pytest.mark.parametrize("n", [0, 1, 80, 81, 140, 141, 200, 1000])
def test_code_windows_cover_every_line(spark, n):
    files = spark.createDataFrame([("r", "a.py", "python", "".join(f"l{i}\n" for i in range(n)))], "repo string, path string, language string, text string")
    got = [(r["start"], r["end"]) for r in chunkers.code_windows(files).orderBy("start").collect()]
    want = []
    for start in range(0, n, 60):
        want.append((start + 1, min(start + 80, n)))
        if start + 80 >= n:
            break
    assert got == want and {i for a, b in got for i in range(a, b + 1)} == set(range(1, n + 1))


def test_sentences(spark):
    md = "# Head\nFirst *sentence* is here. Second one [link](u) goes on\nand ends!\n\n> quoted words that go on and on\n```\ncode is skipped here too.\n```\n- a bullet with `code` and some words\n| a table row with many words |\ntiny. x\n"
    got = chunkers.sentences(spark.createDataFrame([("d", md)], "source string, text string")).orderBy("line", "pos").collect()
    assert [(r["line"], r["text"]) for r in got] == [(2, "First sentence is here."), (2, "Second one link goes on and ends!"), (9, "a bullet with  and some words")]


def test_declarations(spark):
    f = lambda lang, t: [(r["kind"], r["text"], r["line"]) for r in symbols.declarations(spark.createDataFrame([("core-api", "a/x", t)], "repo string, source string, text string"), lang).orderBy("line").collect()]
    assert f("java", "package a.b;\npublic @interface N {}\n public final class C {\ninterface I\nenum E {\n// class X") == [("package", "a.b", 1), ("annotation", "N", 2), ("class", "C", 3), ("interface", "I", 4), ("enum", "E", 5)]
    assert f("typescript", "export interface A {\ntype B = 1\nconst enum C {\nexport function useX(\nfunction Panel(\nfunction help(\n  getY: builder.query({\nexport const MAX_N = 3\nconst Box = () =>") == [("interface", "A", 1), ("type", "B", 2), ("enum", "C", 3), ("hook", "useX", 4), ("component", "Panel", 5), ("endpoint", "getY", 7), ("constant", "MAX_N", 8), ("component", "Box", 9)]
    assert f("hcl", 'resource "a" "b" {\ndata "c" "d" {\nmodule "m" {\nprovider "p" {') == [("resource", "a.b", 1), ("resource", "data.c.d", 2), ("module", "m", 3), ("config_key", "p", 4)]


def test_other_symbols(spark):
    f = lambda g, t: [(r["kind"], r["text"], r["id_family"]) for r in g(spark.createDataFrame([("r", "s", t)], "repo string, source string, text string")).orderBy("line").collect()]
    assert f(symbols.heading_symbols, "# no\n## D17: x\n### Free words \n##### no\n## ZZ9 x") == [("id", "D17", "decision"), ("class", "Free words", None), ("class", "ZZ9 x", None)]
    assert f(symbols.dictionary_terms, "- term: a\n- x: 1\n- term: b\n") == [("term", "a", None), ("term", "b", None)]
    assert f(symbols.collection_symbols, '{"info":{"name":"c"},"item":[{"name":"f","item":[{"name":"e","request":{}}]}],"variable":[{"key":"v"}]}') == [("package", "c", None), ("module", "f", None), ("endpoint", "e", None), ("variable", "v", None)]


# ---------------------------------------------------------------- sync


def test_sync_and_refusals(spark, tmp_path):
    from quern.sources import tables

    root = str(tmp_path / "index")
    rows = lambda *r: spark.createDataFrame([(s, h, sc, "doc", f"{s}{h}{sc}", b) for s, h, sc, b in r], "source string, source_sha string, scope string, doc_type string, chunk_id string, body string")
    a = rows(("x", "1", "universal", "t"), ("y", "1", "infra", "t"), ("memory/m", "1", "universal", "t"))
    with pytest.raises(sync.SyncRefused):
        sync.sync(spark, root, a)
    tables.write_generation(spark, root, a, sync.source_rows(a), sync.BUILDER_VERSION)
    assert sync.sync(spark, root, a).no_op and tables.clean(spark, root) == 0
    b = rows(("x", "2", "universal", "t"), ("y", "1", "backend", "t"), ("z", "1", "e2e", "t"), ("memory/m", "1", "universal", "t"))
    done = sync.sync(spark, root, b)
    assert (done.added, done.changed, done.removed) == (1, 2, 0)
    now = spark.read.parquet(f"{tables.current(spark, root)}/chunks")
    assert {(r["source"], r["source_sha"], r["scope"]) for r in now.collect()} == {("x", "2", "universal"), ("y", "1", "backend"), ("z", "1", "e2e"), ("memory/m", "1", "universal")}
    for bad in (rows(("x", "2", "universal", "t")), rows(("memory/m", "1", "universal", "t"))):
        with pytest.raises(sync.SyncRefused):
            sync.sync(spark, root, bad)
    with pytest.raises(sync.SyncRefused):
        sync.sync(spark, root, b, version="2")
    with pytest.raises(sync.SyncRefused):
        sync.delete_where(b)
    assert sync.delete_where(b, scope=["e2e", "infra"]).count() == 3
    assert tables.clean(spark, root) == 1


# ---------------------------------------------------------------- retrieval


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 0.0], [-3.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(vectors.cosine("a", "b")).collect()] == [0.0, -1.0, 0.0, 0.0]


def test_balanced_matches_a_loop(spark):
    import random

    rng = random.Random(1)
    hits = [(1, i, f"s{rng.randrange(8)}", rng.choice(["corpus", "failure_modes"]), rng.choice(["pattern", "standard", "retro"]), rng.choice([[], ["AP1"], ["D2"]]), round(rng.random(), 3)) for i in range(60)]
    got = vectors.balanced(spark.createDataFrame(hits, "qid int, id long, source string, family string, doc_type string, cites array<string>, distance double"), 7).orderBy("rank").collect()
    by, seen = {"avoid": [], "prefer": [], "convention": []}, set()
    for _, i, s, fam, kind, cites, _ in sorted(hits, key=lambda h: (h[6], str(h[1]))):
        if fam != "failure_modes" and kind not in vectors.RULE_DOC_TYPES:
            continue
        b = "avoid" if fam == "failure_modes" else "prefer" if kind == "pattern" else "avoid" if any(c.startswith("AP") for c in cites) else "convention"
        if s not in seen and len(by[b]) < 3:
            seen.add(s)
            by[b].append(str(i))
    assert [r["id"] for r in got] == (by["avoid"] + by["prefer"] + by["convention"])[:7]


def test_relaxed_negatives(spark):
    s = spark.createDataFrame([("a", "s1", "r1", ["c:x"]), ("b", "s2", "r2", ["c:x"]), ("c", "s2", "r2", ["c:y"]), ("d", "", "r1", ["c:y"])], "id string, scope string, semantic_role string, tags array<string>")
    got = {r["anchor_id"]: (r["negative_id"], r["relaxed"]) for r in vectors.tag_negatives(s).collect()}
    assert got == {"a": ("b", True), "b": ("a", True), "c": ("d", True), "d": ("c", True)}


def test_embedding_isolates_bad_texts(spark):
    class Picky(index.HashEmbedder):
        def __call__(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError
            return super().__call__(texts)

    chunks = spark.createDataFrame([("1", "universal", "s", "good words"), ("2", "universal", "s", "bad words"), ("3", "universal", "s", "more")], "chunk_id string, scope string, source string, body string")
    assert {r["id"] for r in index.vectors(chunks, "corpus", Picky(8)).collect()} == {"1", "3"}


# ---------------------------------------------------------------- ledgers and evaluation


def test_effective_precedence(spark):
    r = spark.createDataFrame([("t1", "live", "", "accept", 1), ("t1", "live", "", "reject", 2), ("t2", "live", "", "accept", 3), ("t2", "retro", "wrong", "", 4), ("t2", "live", "", "accept", 5), ("t3", "live", "confirmed", "", 6), ("t3", "live", "retracted", "", 7), ("none", "live", "", "accept", 8), ("", "live", "", "accept", 9)], "turn_id string, phase string, label string, reaction string, line_no long")
    assert {x["turn_id"]: x["line_no"] for x in ledger.effective(r).collect()} == {"t1": 2, "t2": 4}
    assert r.agg(ledger.unjoinable(r)).first()[0] == 2


def test_dispositions(spark):
    rows = [(1, "u1", "challenge", "wrong", "INVALID", "2026-02-01"), (2, "u2", "challenge", "wrong", "INVALID", "2026-02-02"), (3, "u3", "validate", "wrong", "failed", "2026-02-02"), (4, "u4", "retrieve", "wrong", "x", "2026-02-02"), (5, "u5", "challenge", "", "INVALID", "2026-02-02"), (6, "u6", "challenge", "wrong", "VALID", "2026-02-02"), (7, "u7", "challenge", "wrong", "INVALID", "2020-01-01"), (8, "u8", "challenge", "wrong", "INVALID", "soon"), (9, "u9", "challenge", "wrong", "", "2026-02-02"), (10, "none-1", "challenge", "confirmed", "INVALID", "2026-02-02")]
    r = spark.createDataFrame([(n, t, s, lab, v, ts, "live", "") for n, t, s, lab, v, ts in rows], "line_no long, turn_id string, subcommand string, label string, verdict string, ts string, phase string, reaction string")
    state = spark.createDataFrame([("challenge", True, "2026-01-01T00:00:00Z"), ("validate", False, "2026-01-01")], "surface string, blocking boolean, promoted_at string")
    turns = spark.createDataFrame([], "turn_id string, verdict string, proceed string")
    got = {x["line_no"]: x["reason"] for x in ledger.dispositions(r, state, turns).collect()}
    assert got == {1: None, 2: "already demoted", 3: "surface is advisory", 4: "not a promotable surface", 5: "no human label", 6: "not the hard block", 7: "predates promotion", 8: "unparseable ts", 9: "no verdict evidence", 10: "not a confirmed false block"}


@pytest.mark.parametrize("h,d,m,want", [(0, 0, 0, 0.0), (3, 0, 0, 1.0), (0, 0, 3, 0.0), (2, 0, 2, 0.5), (2, 1, 1, 1 / 3), (1, 2, 0, 0.0)])
def test_hit_rate(spark, h, d, m, want):
    assert abs(spark.range(1).select(ledger.hit_rate(F.lit(h), F.lit(d), F.lit(m))).first()[0] - want) < 1e-12


def test_prune_refuses_and_combines(spark):
    import datetime as dt

    day = lambda n: dt.datetime(2026, 1, n)
    o = spark.createDataFrame([(f"p{n}", 10, day(n)) for n in range(1, 11)], "path string, size long, mtime timestamp_ntz")
    with pytest.raises(ValueError):
        ledger.prune(o)
    got = {r["path"]: r["reason"] for r in ledger.prune(o, cutoff=day(3), max_bytes=55).collect()}
    assert got == {"p1": "age", "p2": "age", "p3": "size", "p4": "size", "p5": "size"}


def test_gate(spark):
    c = spark.createDataFrame([("a", 0, 0, 0, 1, "", "x"), ("b", 1, 0, 0, 2, "", "y"), ("c", 0, 1, 0, 1, "boom", "z")], "case_id string, blockers int, warnings int, infos int, attempts int, error string, raw_output string")
    base = spark.createDataFrame([("a", 0, 0, ""), ("b", 0, 0, ""), ("c", 0, 1, "")], "case_id string, blockers int, warnings int, error string")
    g = evalx.gate(c, 2, 1, 0.5, base).first()
    assert not g["pass"] and (g["errors"], g["new_blockers"]) == (1, 1) and g["reasons"] == ["new blockers on clean cases", "errors"]
    assert sorted(map(tuple, evalx.gate_cases(c, base).collect())) == [("b", "new blocker"), ("c", "error")]
    assert evalx.gate(c.where("case_id = 'a'"), 1, 0, 0.9).first()["pass"]


def test_assessments(spark):
    out = spark.createDataFrame([("k", '{"assessments":[{"claim_id":"c1","cites":["D1"]},{"claim_id":"c9","cites":[]}]}'), ("bad", "{")], "case_id string, raw string")
    claims = spark.createDataFrame([("k", "c1"), ("k", "c2")], "case_id string, claim_id string")
    known = spark.createDataFrame([("D2",)], "cite string")
    got = sorted((r["case_id"], r["code"], r["location"]) for r in evalx.assessment_violations(out, claims, known).collect())
    assert got == [("bad", "output_not_parseable_json", "(root)"), ("k", "assessment_unsupported", "assessments[1]"), ("k", "cite_unresolved", "assessments[0].cites[0]"), ("k", "claim_not_assessed", "claims.c2"), ("k", "unknown_claim", "assessments[1]")]


# ---------------------------------------------------------------- datasets and plans


def test_example_builders(spark):
    d = spark.createDataFrame([(0, "D1", "n", "ctx", "yes", "", "why", None), (1, "D1", "n", "", "again", "", "", ""), (2, "D2", None, "", " ", "", "", "")], "pos int, id string, name string, context string, decision string, alternatives string, rationale string, outcome string")
    got = {r["source"]: r["messages"][1]["content"] for r in datasets.decisions(d).collect()}
    assert got == {"D1": "Decision: yes\n\nContext: ctx\n\nRationale: why", "D1-2": "Decision: again"}
    files = spark.createDataFrame([("r.md", "core-api", "## 1. Good practice\n" + "w " * 40 + "\n## 2 - Wrong turns\n" + "v " * 40 + "\n## 3 Short\nx\n"), ("q.md", "unknown", "## A\n" + "w " * 40)], "source string, project string, text string")
    rows = {r["messages"][0]["content"]: (r["role"], r["scope"]) for r in datasets.retros(files).collect()}
    assert rows == {"What did core-api learn about: Good practice?": ("practice", "backend"), "What did core-api learn about: - Wrong turns?": ("avoid", "backend")} or len(rows) == 2


def test_commit_rows(spark):
    msg = "fix: D1 thing\n\nbody line\n\n\n\nCo-authored-by: helper bot <b@x.y>\nend AP2"
    c = spark.createDataFrame([("r", "s" * 40, "sssssss", "p", "a", msg, "infra", [("f%02d" % i, "M", None, i % 3, 0) for i in range(12)])], "repo string, sha string, short_sha string, parent_sha string, author string, message string, scope string, files array<struct<path:string,status:string,old_path:string,additions:int,deletions:int>>").withColumn("committed_at", F.lit("2026-01-01").cast("timestamp"))
    p = datasets.parsed_commits(c)
    r = p.first()
    assert r["subject"] == "fix: D1 thing" and r["body"] == "body line\n\nend AP2" and r["cite_ids"] == ["D1", "AP2"]
    text_ = datasets.commit_summaries(p).first()["messages"][1]["content"]
    assert "(top 10 by changed lines; 2 more)" in text_ and re.findall(r"- (f\d\d)", text_)[:5] == ["f02", "f05", "f08", "f11", "f01"]


def test_sanitizing_counts(spark):
    rows = spark.createDataFrame([("s", [("user", "keep\nsecret Brand here\nend")], "brand line\n", {"k": "a BRAND"})], "system string, messages array<struct<role:string,content:string>>, source string, metadata map<string,string>")
    r = datasets.sanitized(rows, (text.line_with("brand"),)).first()
    assert r["lines_stripped"] == 3 and r["messages"][0]["content"] == "keep\nend" and r["source"] == "" and r["metadata"] == {"k": ""}


def test_plans():
    S = steps.Step
    diamond = [S("a"), S("c", ["b", "a"]), S("b", ["a"]), S("d", ["c", "b"])]
    assert steps.in_order(diamond) == ["a", "b", "c", "d"] and not steps.problems(diamond)
    assert steps.problems([S("a", ["b"]), S("b", ["a"])]) == ["the plan has a cycle"]
    assert steps.problems([S("a"), S("a", ["z"])]) == ["step a is defined twice", "step a depends on unknown z"]
    calls = []

    class Flaky:
        def execute(self, step, inputs):
            calls.append(step.id)
            if step.id == "b" or (step.id == "a" and calls.count("a") < 3):
                raise RuntimeError("no")
            return step.id + "".join(sorted(inputs))

    slept = []
    got = steps.run([S("a", max_attempts=3, backoff=20), S("b", ["a"]), S("c", ["b"]), S("d", ["a"])], {"local": Flaky()}, sleep=slept.append)
    assert [(r["step_id"], r["status"], r["attempts"]) for r in got] == [("a", "ok", 3), ("b", "failed", 1), ("d", "ok", 1), ("c", "skipped", 0)] or {r["step_id"]: r["status"] for r in got} == {"a": "ok", "b": "failed", "c": "skipped", "d": "ok"}
    assert slept == [20, 30]


def test_document_cites(spark):
    docs = spark.createDataFrame([("d", "see D1\nand D9 in a/b.md:12-20, D1")], "doc string, text string")
    c = graph.document_cites(docs)
    src = spark.createDataFrame([("D1", "x.md")], "cite string, source string")
    files = spark.createDataFrame([("x.md", "1", "2"), ("a/b.md", "1", "1")], "path string, indexed_sha string, live_sha string")
    got = {(r["cite"], r["line"], r["status"]) for r in graph.resolved(c, src, files).collect()}
    assert got == {("D1", 1, "stale"), ("D9", 2, "unresolved"), ("a/b.md", 2, "ok")}


def test_pending_commits(spark):
    c = spark.createDataFrame([("r", "a", 1), ("r", "b", 2), ("r", "c", 3), ("q", "d", 1)], "repo string, sha string, committed_at int")
    cur = spark.createDataFrame([("r", "a"), ("q", "gone")], "repo string, sha string")
    assert {r["repo"]: r["pending"] for r in datasets.pending(c, cur).collect()} == {"r": 2, "q": 1}


def test_pending_commits_of_repeated_and_early_rows(spark, tmp_path):
    """Rows that a table repeats, keys at zero and below, and null keys count as in the query's SQL."""
    import duckdb

    from quern import queries

    rows = [(k, n) for k, n in [(0, 1), (-3, 1), (4, 1), (5, 2), (5, 2), (5, 2), (7, 2), (-1, 4), (0, 4), (2, None), (0, None), (None, 2), (None, 3), (9, 3)]] * 2
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    got = sorted(map(tuple, queries.queries()["pending_commits"](spark, str(tmp_path)).collect()), key=str)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW customer AS FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert got == sorted(db.execute(queries.oracle_sql()["pending_commits"]).fetchall(), key=str)


def test_sentences_are_found_once_and_in_place(spark):
    """Fences, open ones too, and breaks are told apart without sorting lines, and no list is computed twice."""
    md = "One is a whole sentence here. Two is another one here.\n  ```\nnot this line of code, is it.\n```x\n\n\n- *Three* is a `bullet` [point](url) here.\n \t\nand goes on in the next line here.\r\n# A heading that is left out.\n```\nthe open fence hides this sentence.\n"
    df = chunkers.sentences(spark.createDataFrame([("d", md), ("e", ""), ("f", None), ("g", "```\n")], "source string, text string"))
    assert sorted(tuple(r) for r in df.collect()) == [("d", 1, 0, "One is a whole sentence here."), ("d", 1, 1, "Two is another one here."), ("d", 7, 0, "Three is a  point here."), ("d", 9, 0, "and goes on in the next line here.")]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("```") <= 2
