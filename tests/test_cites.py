"""Ids found in one pass as by every pattern alone; cites that name files; findings on assessments."""

import random
import re

from quern.functions import text
from quern.operators import evalx


def test_one_pass_finds_what_every_pattern_finds(spark):
    rng = random.Random(2)
    # Pieces of ids, what stands between them, and letters and digits outside ASCII.
    pieces = [*"D AP RL SB SI U B W T I WA WA-T WA-SS AWC AWTA AMTA ABB TBX TAP TWU OL AO SS CI PC AB ABCD ABCDE".split(), *"- - - 1 12 3 45678".split(), *"a b _ . , / x ( )".split(), "\n", " ", " ", " ", "é", "ß", "À", "٣"]
    rows = [("".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))),) for _ in range(20_000)]
    rows += [(t,) for t in ("", "WA-T-5", "WA-FOO-12b", "AWC-12a AWC-12", "D1-D2-AP3", "AP-12a D-3b", "xD1 D1x D1_ _D1 D1é", "TAP-3-SS-4", "D1٣", None)]
    df = spark.createDataFrame(rows, "t string").select("t", text.cites("t").alias("a"), text.commit_cites("t").alias("b")).collect()
    find = lambda p, t: [m[0] for m in re.finditer(rf"{text.LEFT}(?:{p}){text.RIGHT}", t)]
    some = 0
    for r in df:
        t = r.t or ""
        assert r.a == sorted({x for p in text.CITE_PATTERNS for x in find(p, t)}), t
        assert r.b == list(dict.fromkeys(x for p in text.COMMIT_CITE_PATTERNS for x in find(p, t))), t
        some += len(r.a) > 1
    assert some > 200


def test_resolving_cites(spark):
    known = spark.createDataFrame([("D1",), ("AP3#x",), ("glossary term",), ("D1",)], "cite string")
    files = spark.createDataFrame([("decisions/log.md",), ("knowledge-base/standards/My Rules/a+b.yaml",), ("core-api/src/A.java",), (None,)], "path string")
    want = {
        "D1": True, " D1 ": True, "D1#why": True, "AP3#x": True, "AP3": False, "glossary term": True, "D2": False, "": False, "  ": False, None: False, "#D1": False,
        "decisions/log.md": True, "decisions/log.md#D1": True, "knowledge-base/decisions/log.md#L1-L9": True, "knowledge-base/standards/My Rules/a+b.yaml": True, "standards/My Rules/a+b.yaml": True,
        "core-api/src/A.java": True, "knowledge-base/core-api/src/A.java": True, "core-api/src/B.java": False, "web/src/A.java": False, "decisions/log": False, "log.md": False, "decisions/../x.md": False,
    }
    cites = spark.createDataFrame([(c,) for c in want] * 2, "cite string")
    got = [r.cite for r in evalx.resolving_cites(cites, known, files, ("decisions", "standards", "core-api", "web")).collect()]
    assert len(got) == len(set(got)) and set(got) == {c for c, ok in want.items() if ok}
    # A path counts only below a folder that is named; without files none does.
    assert {r.cite for r in evalx.resolving_cites(cites, known, files, ("core-api",)).collect()} & {"decisions/log.md"} == set()
    assert {r.cite for r in evalx.resolving_cites(cites, known).collect()} == {"D1", " D1 ", "D1#why", "AP3#x", "glossary term"}


def test_assessments_are_parsed_once(spark):
    out = spark.createDataFrame(
        [("k", '{"assessments":[{"claim_id":"c1","cites":["D1","decisions/a.md#x"]},{"claim_id":"c9","cites":[]},{"claim_id":null,"cites":[null,""]}]}'), ("bad", "{"), ("none", '{"assessments":[]}'), ("free", '{"assessments":[{"claim_id":"c1","cites":["D2"]}]}')],
        "case_id string, raw string",
    )
    claims = spark.createDataFrame([("k", "c1"), ("k", "c2"), ("k", "c2"), ("none", "c1"), ("bad", "c1")], "case_id string, claim_id string")
    known, files = spark.createDataFrame([("D2",)], "cite string"), spark.createDataFrame([("decisions/a.md",)], "path string")
    df = evalx.assessment_violations(out, claims, known, files, ("decisions",))
    assert sorted((r.case_id, r.code, r.location, r.value) for r in df.collect()) == [
        ("bad", "output_not_parseable_json", "(root)", "{"), ("free", "unknown_claim", "assessments[0]", "c1"),
        ("k", "assessment_unsupported", "assessments[1]", ""), ("k", "cite_unresolved", "assessments[0].cites[0]", "D1"), ("k", "cite_unresolved", "assessments[2].cites[0]", ""), ("k", "cite_unresolved", "assessments[2].cites[1]", ""),
        ("k", "claim_not_assessed", "claims.c2", "c2"), ("k", "unknown_claim", "assessments[1]", "c9"), ("k", "unknown_claim", "assessments[2]", ""), ("none", "claim_not_assessed", "claims.c1", "c1"),
    ]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
