"""Text functions as Spark column expressions.

Lengths that decide anything are bytes (``octet_length``).  Patterns follow
RE2's reading so that they agree with other engines: ``(?d)`` keeps line ends to
``\\n``, word boundaries are spelled out for ASCII, white space is
``[\\t\\n\\f\\r ]``, and ``\\z`` is the end of the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\t\n\f\r ]"
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lines_of(text) -> Column:
    """The lines of a text as a line scanner gives them: ``\\r`` before the line end is cut, a closing line end adds none."""
    parts = F.split(F.regexp_replace(col(text), r"\r?\n\z", ""), r"\r?\n")
    return F.when(F.octet_length(col(text)) > 0, parts).otherwise(F.array().cast("array<string>"))


def trim_space(c) -> Column:
    return F.btrim(col(c), F.lit(" \t\n\f\r"))


def bound(c, use) -> Column:
    """``use(c)``, with ``c`` evaluated once however often it is used: an array of one element binds it to a name."""
    return F.transform(F.array(c), use)[0]


def cap_utf8(c, n: int) -> Column:
    """At most ``n`` bytes, cut back to a whole code point."""
    c = col(c)
    raw = F.substring(F.encode(c, "UTF-8"), 1, n)
    # Decoding an incomplete last code point gives U+FFFD; at most three bytes of it can be there.
    head = [F.substring(raw, 1, n - k) for k in range(4)]
    ok = F.lit("")
    for k in (3, 2, 1, 0):
        # The cut is clean where the next byte of the text is no continuation byte.
        nxt = F.conv(F.hex(F.substring(F.encode(c, "UTF-8"), n - k + 1, 1)), 16, 10).cast("int")
        clean = (nxt < 128) | (nxt >= 192)
        ok = F.when(clean, F.decode(head[k], "UTF-8")).otherwise(ok) if k < n else ok
    return F.when(F.octet_length(c) <= n, c).otherwise(ok)


def cap_lines(c, n: int) -> Column:
    """At most ``n`` bytes, cut back to the last line end if there is one after the first byte, with a note of the size."""
    c = col(c)
    head = cap_utf8(c, n)
    cut = F.when(F.instr(F.substring(head, 2, n), "\n") > 0, F.regexp_replace(head, r"\n[^\n]*\z", "")).otherwise(head)
    return F.when(F.octet_length(c) <= n, c).otherwise(F.concat(cut, F.lit("\n... [truncated, original "), F.octet_length(c).cast("string"), F.lit(" bytes]")))


def slug_anchor(heading, index) -> Column:
    """A heading as an anchor: letters and digits stay, each blank, hyphen or underscore is a hyphen; at most 80 bytes."""
    s = F.regexp_replace(F.regexp_replace(F.lower(col(heading)), "[^a-z0-9 _-]", ""), "[ _]", "-")
    s = F.regexp_replace(s, r"\A-+|-+\z", "")
    return F.when(s != "", F.substring(s, 1, 80)).otherwise(F.concat(F.lit("section-"), col(index).cast("string")))


def slug_words(c) -> Column:
    """A title as a slug with single hyphens and no cap."""
    s = F.regexp_replace(F.lower(col(c)), "[ _/-]+", "-")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9-]", ""), "-+", "-"), r"\A-|-\z", "")


def one_line(c, n: int) -> Column:
    flat = F.array_join(F.split(trim_space(c), SPACE + "+"), " ")
    return F.when(F.octet_length(flat) > n, F.concat(cap_utf8(flat, n), F.lit("…"))).otherwise(flat)


def first_runes(c, n: int) -> Column:
    c = col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


# ---------------------------------------------------------------- artifact ids

# The artifact-id dialect of catalogs.
CITE_PATTERNS = (
    r"(?:D|RL|RK|RM|RS)[0-9]+",
    r"AP[0-9]+",
    r"(?:SB|SI|SW|SM|SX)-[0-9]+",
    r"(?:U|B|W|M|T|E|I)-[0-9]+",
    r"WA-[A-Z]+(?:-[0-9]+)?",
    r"(?:AWC|AWH|AWS|AWR|AWT|AWB|AWTA|AWA)-[0-9]+",
    r"(?:AMC|AMP|AMS|AMN|AMH|AME|AMTA)-[0-9]+",
    r"(?:ABB|ABO|ABC|ABD|ABE|ABS|ABT)-[0-9]+",
    r"(?:TBX|TBU|TBC|TBE|TAP)-[0-9]+",
    r"(?:TWU|TWC|TWE|TAW)-[0-9]+",
    r"(?:TMU|TMC|TME|TAM)-[0-9]+",
    r"(?:OL|OT|OM|OH|OE|OW|OA|OI|AO)-[0-9]+",
    r"SS-[0-9]+",
    r"(?:AP|D)-[0-9]+[a-z]",
    r"(?:ABB|ABO|ABC|ABD|ABE|ABS|ABT|AWC|AWH|AWS|AWR|AWT|AWB|AWTA|AWA|AMC|AMP|AMS|AMN|AMH|AME|AMTA)-[0-9]+[a-z]",
)
# The artifact-id dialect of commit messages.
COMMIT_CITE_PATTERNS = (r"D[0-9]{1,4}", r"AP[0-9]{1,4}", r"[A-Z]{2,4}-[A-Z]?[0-9]+[a-z]?", r"CI[0-9]{1,4}", r"PC[0-9]{1,4}")


#: Every id begins with up to four capitals and a digit, or a hyphen and a digit or capital.  A candidate reaches to the
#: end of its run of word characters and hyphens, so it holds every id that begins in it, with what decides its ends.
CANDIDATE = r"(?=[A-Z])(?<![A-Za-z0-9_])[A-Z]{1,4}(?:[0-9]|-[A-Z0-9])[A-Za-z0-9_-]*"


def _found(c, patterns) -> Column:
    """The ids of a text, pattern by pattern.  The text is read once for candidates; the patterns see only these."""
    ids_of = lambda x: F.flatten(F.array(*[F.regexp_extract_all(x, F.lit(f"{LEFT}({p}){RIGHT}"), 1) for p in patterns]))
    candidates = F.regexp_extract_all(col(c), F.lit(CANDIDATE), 0)
    return bound(F.array_join(candidates, " "), lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(ids_of(x)))


def cites(c) -> Column:
    """Distinct artifact ids of a text, sorted; every pattern is tried on its own, as matches may overlap."""
    return F.array_sort(F.array_distinct(_found(F.coalesce(col(c), F.lit("")), CITE_PATTERNS)))


def commit_cites(c) -> Column:
    """Distinct artifact ids of a commit message, pattern by pattern in order of appearance."""
    return F.array_distinct(_found(F.coalesce(col(c), F.lit("")), COMMIT_CITE_PATTERNS))


# ---------------------------------------------------------------- sentence and path classes


def syntactic_form(c) -> Column:
    # Verbs that open an instruction.
    verbs = ("use", "run", "check", "verify", "ensure", "set", "add", "remove", "delete", "create", "configure", "install", "build", "test", "deploy")
    form = lambda t, low: (
        F.when(t == "", "affirmation").when(t.endswith("?"), "question").when(t.endswith("!"), "imperative")
        .when(low.startswith("if ") | low.contains(" unless ") | low.contains(" otherwise "), "conditional")
        .when(low.contains(" not ") | low.contains(" never ") | low.startswith("no ") | low.startswith("do not ") | low.startswith("don't "), "negation")
        .when(low.rlike(r"\A(?:" + "|".join(verbs) + ") "), "imperative").otherwise("affirmation")
    )
    return bound(trim_space(c), lambda t: bound(F.lower(t), lambda low: form(t, low)))


# Modalities from strongest to weakest, and their cues.
MODALITIES = (
    ("forbidden", ("MUST NOT", "NEVER ", "FORBIDDEN", "PROHIBITED", "NO EXCEPTIONS", "DO NOT ")),
    ("mandatory", ("MUST ", "HARD RULE", "REQUIRED", "REQUIRES ", "MANDATORY", "NON-NEGOTIABLE")),
    ("recommended", ("SHOULD ", "RECOMMEND", "PREFER")),
    ("allowed", (" MAY ", " CAN ", "OPTIONAL", "ALLOWED")),
)


def modality(c) -> Column:
    """The strongest modality whose cue the text holds; empty if none does."""
    low = F.lower(col(c))

    def of(up: Column) -> Column:
        out = F.when(low.startswith("if ") | low.contains(" unless "), "conditional").otherwise("")
        for name, cues in reversed(MODALITIES):
            test = up.contains(cues[0])
            for cue in cues[1:]:
                test = test | up.contains(cue)
            out = F.when(test, name).otherwise(out)
        return out

    return bound(F.upper(col(c)), of)


# Path parts and their concern, in order.
PATH_CONCERNS = (
    ("security", "security"), ("auth", "security"), ("jwt", "security"), ("passkey", "security"),
    ("multi-tenant", "tenancy"), ("multitenant", "tenancy"), ("tenant", "tenancy"),
    ("repository", "persistence"), ("datamodel", "persistence"), ("migration", "persistence"), ("sqldelete", "persistence"),
    ("observability", "observability"), ("logging", "observability"), ("metric", "observability"),
    ("controller", "api-contract"), ("dto", "api-contract"), ("endpoint", "api-contract"),
    ("/test/", "testing"), ("src/test", "testing"),
    ("/components/", "ui"), ("/pages/", "ui"), ("/screens/", "ui"), ("/theme/", "ui"), ("/i18n/", "ui"), ("/locales/", "ui"),
)


def path_concerns(c) -> Column:
    low = F.lower(col(c))
    return F.array_distinct(F.array_compact(F.array(*[F.when(low.contains(n), F.lit(k)) for n, k in PATH_CONCERNS])))


# Code constructs and the hint that each gives.
CODE_SIGNALS = (
    (rf"{LEFT}any{SPACE}*\(|{LEFT}any[A-Z][A-Za-z0-9_]*\(", "Mockito any() matcher argument matching"),
    (rf"{LEFT}for{SPACE}*\(|\.forEach\(", "manual loop instead of streams"),
    (rf'(?i:"{SPACE}*(?:select|insert|update|delete){SPACE})|@Query', "raw SQL native query bypassing the ORM"),
    (r"System\.(?:out|err)\.", "System.out logging instead of a logger"),
    (rf"catch{SPACE}*\([^)]*\){SPACE}*\{{{SPACE}*\}}|except[^:]*:{SPACE}*pass", "empty catch/except swallowed exception"),
    (r"@Autowired", "field injection instead of constructor injection"),
    (rf"(?i){LEFT}password{RIGHT}|{LEFT}secret{RIGHT}|api[_-]?key|token{SPACE}*=", "hardcoded secret / credential handling"),
    (rf"=={SPACE}*null|!={SPACE}*null|Optional\.get\(", "null handling / Optional misuse"),
    (r"console\.(?:log|error|warn)\(", "console logging left in code"),
    (rf"{LEFT}var{SPACE}|{LEFT}any{RIGHT}{SPACE}*[:=]|as{SPACE}+any{RIGHT}", "loose typing (var / any) in TypeScript"),
    (r"useEffect\(|useState\(", "React hooks — effect/state dependency and setState pitfalls"),
    (r"process\.env\.", "process.env access (Vite import.meta.env)"),
    (r"fmt\.Print|panic\(", "fmt.Print / panic instead of error handling + logging"),
    (rf"_{SPACE}*={SPACE}*[A-Za-z0-9_]+|err{SPACE}*!={SPACE}*nil", "error handling — swallowed or unchecked errors"),
    (rf"{LEFT}print\(", "print() instead of logging"),
)


def code_signals(c) -> Column:
    """Hints for the code constructs that a text holds, joined by ``; ``."""
    return F.array_join(F.array_compact(F.array(*[F.when(col(c).rlike(p), F.lit(h)) for p, h in CODE_SIGNALS])), "; ")


# ---------------------------------------------------------------- line removal


def strip_lines(c, patterns) -> Column:
    """The text without the lines that match, pattern by pattern."""
    out = col(c)
    for p in patterns:
        out = F.regexp_replace(out, p, "")
    return out


def stripped_count(c, patterns) -> Column:
    """How many matches :func:`strip_lines` removes, each pattern counted on what the one before leaves."""
    total, text = F.lit(0), col(c)
    for p in patterns:
        total = total + F.regexp_count(text, F.lit(p))
        text = F.regexp_replace(text, p, "")
    return total


def line_with(*needles: str) -> str:
    """A pattern for whole lines that hold one of the given patterns, in any case."""
    return r"(?imd)^[^\n]*(?:" + "|".join(needles) + r")[^\n]*\n?"


#: Attribution trailers in commit messages and documents: co-author lines, "generated with" footers, robot marks.
ATTRIBUTION = (line_with(r"co-?authored-?by:[ \t]*[^<\n]*(?:bot|assistant)", r"🤖[ \t]*generated[ \t]+with", r"generated[ \t]+with[ \t]+\[?(?:ai|bot)"),)
DOC_ATTRIBUTION = (
    r"(?imd)^[ \t]*co-?authored-?by:[ \t]*[^<\n]*(?:bot|assistant)[^\n]*\n?",
    r"(?imd)^[ \t]*🤖[ \t]*generated[ \t]+with[^\n]*\n?",
    r"(?imd)^[ \t]*generated[ \t]+with[ \t]+\[?(?:ai|bot)[^\n]*\n?",
)


def collapse_blank_lines(c) -> Column:
    return trim_space(F.regexp_replace(col(c), r"\n{3,}", "\n\n"))


# ---------------------------------------------------------------- small scalars


def json_object_in(c) -> Column:
    """From the first ``{`` to the last ``}``; empty if there is none."""
    return F.regexp_extract(col(c), r"(?s)\{.*\}", 0)


def json_field(c, *path: str) -> Column:
    """A field of a JSON text as a string, by the names that lead to it; null where the text is no JSON or lacks it."""
    return F.get_json_object(col(c), "$" + "".join(f"['{p}']" for p in path))


def strip_fence(c) -> Column:
    return trim_space(F.regexp_replace(trim_space(c), r"(?s)\A```[a-z]*\n|\n?```\z", ""))


def parse_bytes(c) -> Column:
    """``12``, ``3K``, ``4M``, ``1G`` as bytes; null for anything else or on overflow."""
    num = F.regexp_extract(trim_space(c), r"\A([0-9]+)([KMGkmg]?)B?\z", 1)
    unit = F.upper(F.regexp_extract(trim_space(c), r"\A([0-9]+)([KMGkmg]?)B?\z", 2))
    scale = F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).otherwise(1).cast("decimal(20,0)")
    value = num.try_cast("decimal(18,0)") * scale
    return F.when(value <= (1 << 63) - 1, value.try_cast("long"))


def human_bytes(c) -> Column:
    v, out = col(c).cast("double"), F.concat(col(c).cast("string"), F.lit(" B"))
    for size, unit in ((1 << 10, "KiB"), (1 << 20, "MiB"), (1 << 30, "GiB")):
        out = F.when(v >= size, F.format_string(f"%.1f {unit}", v / size)).otherwise(out)
    return out


def tokens_per_second(tokens, nanos) -> Column:
    return F.when(col(nanos) > 0, col(tokens) / (col(nanos) / 1e9)).otherwise(F.lit(0.0))


def parse_time(c) -> Column:
    """A timestamp in one of three layouts, else null."""
    return F.coalesce(F.try_to_timestamp(col(c), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(col(c), F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(col(c), F.lit("yyyy-MM-dd")))
