"""Markdown chunks against a plain version that works on whole lists of lines."""

import random
from itertools import groupby

from quern import queries
from quern.operators import chunkers
from tests.conftest import DATA

BLANK = " \t\n\f\r\v"


def outside(lines):
    """Whether each line is neither a fence nor inside one."""
    fences = [line.strip(BLANK).startswith("```") for line in lines]
    return [not f and sum(fences[:i]) % 2 == 0 for i, f in enumerate(fences)]


def joined(lines):
    return "".join(line + "\n" for line in lines)


def cut(lines, level):
    free = outside(lines)
    starts = lambda m: [i for i, line in enumerate(lines) if free[i] and line.strip(BLANK).startswith(m)]
    top, heads = starts("# ")[:1], starts("#" * level + " ")
    names = [lines[i].strip(BLANK)[level + 1 :].strip(BLANK) for i in heads]
    bodies = [[lines[j] for j in range(a + 1, b) if j not in top] for a, b in zip(heads, [*heads[1:], len(lines)])]
    return (lines[top[0]].strip(BLANK)[2:].strip(BLANK) if top else ""), list(zip(names, bodies))


def packed(lines):
    free = outside(lines)
    parts = [joined(lines[i] for i in g).rstrip("\n") + "\n\n" for breaks, g in ((k, list(v)) for k, v in groupby(range(len(lines)), lambda i: free[i] and not lines[i].strip(BLANK))) if not breaks]
    out = []
    for p in parts:
        if out and len((out[-1] + p).encode()) <= 1500:
            out[-1] += p
        else:
            out.append(p)
    return [o.rstrip("\n") for o in out]


def fits(lines):
    return len(joined(lines).encode()) <= 1500


def plain(body):
    lines = [line.removesuffix("\r") for line in body.split("\n")]
    lines = lines[:-1] if lines[-1] == "" else lines
    title, found = cut(lines, 2)
    pieces = []
    for name, own in found:
        subs = cut(own, 3)[1]
        if fits(own):
            pieces.append((name, name, joined(own)))
        elif len(subs) < 2:
            pieces += [(name, name, p) for p in packed(own)]
        else:
            for sub, sublines in subs:
                pieces += [(f"{name} > {sub}",) * 2 + (p,) for p in ([joined(sublines)] if fits(sublines) else packed(sublines))]
    if not found:
        whole = [body] if len(body.encode()) <= 1500 else packed(lines) if len(cut(lines, 3)[1]) < 2 else None
        if whole is None:
            for sub, sublines in cut(lines, 3)[1]:
                pieces += [(f"{title} > {sub}",) * 2 + (p,) for p in ([joined(sublines)] if fits(sublines) else packed(sublines))]
        else:
            pieces = [(title, title, p) for p in whole]
    out = []
    for name, head, text in pieces:
        if out and len(out[-1][2].encode()) < 200:
            a, b, c = out[-1]
            out[-1] = (f"{a} + {name}", f"{b} + {head}", c.rstrip("\n") + "\n\n" + text)
        else:
            out.append((name, head, text))
    return title, out


def test_made_documents():
    rng = random.Random(5)
    kinds = ["# Top", "## Two {}", "### Three {}", "```", "", "  ", "word {} " * 30, "é{} " * 60, "short {}", "\tindented {}\r", "##", "#### four"]
    for n in range(400):
        some = [rng.choice(kinds).replace("{}", str(rng.randrange(9))) for _ in range(rng.randrange(60))]
        body = "\n".join(some) + rng.choice(["", "\n", "\n\n"])
        title, got = chunkers.markdown_sections(body)
        assert (title, [(s.title, s.heading, s.body) for s in got]) == plain(body), n


def test_the_query(spark):
    docs = queries._headed(spark, DATA).collect()
    want = set()
    for r in docs:
        title, pieces = plain("# T\n" + r.text)
        source = f"patterns/{r.doc_id}.md"
        for i, (name, head, body) in enumerate(pieces):
            full = f"[pattern] {title}" + (f" > {name}" if name else "") + "\n\n" + body.strip(BLANK)
            want.add((source, i, f"{source}#{chunkers.slug(head, i)}", name, len(full.encode())))
    got = [tuple(r) for r in queries.queries()["markdown_chunks"](spark, DATA).select("source", "seq", "source_anchor", "title", "bytes").collect()]
    assert len(got) == len(want) > 100 and set(got) == want
