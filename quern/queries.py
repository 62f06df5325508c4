"""Queries of the operators on the driver's tables, each with DuckDB SQL where SQL can express it.

The tables hold no headings, artifact ids or ledgers, so some queries derive
such columns by an expression that Spark and DuckDB share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import dims, text
from quern.operators import chunkers, datasets, evalx, graph, ledger, sync, vectors
from quern.plans import steps
from quern.shared import new_folder
from quern.streaming import ledgers

FLAGSHIP = "code_windows"
_Q: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    from quern import queries_extra, queries_more  # noqa: F401  they register their own

    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    from quern import queries_extra, queries_more  # noqa: F401

    return dict(_SQL)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


S, E = r"[\t\n\f\r ]", r"\z"
LINES = "string_split_regex(regexp_replace(text, '\\r?\\n\\z', ''), '\\r?\\n')"

# ---------------------------------------------------------------- chunkers


@query(f"""
WITH d AS (SELECT doc_id, {LINES} AS ls FROM documents WHERE strlen(text) > 0),
k AS (SELECT doc_id, ls, len(ls) AS n, unnest(range(0, greatest(0, ceil((len(ls) - 80) / 60.0))::INT + 1)) AS k FROM d),
w AS (SELECT doc_id, (k * 60 + 1)::INT AS start, least(k * 60 + 80, n)::INT AS "end", array_to_string(ls[(k * 60 + 1):least(k * 60 + 80, n)], chr(10)) AS part FROM k),
a AS (SELECT *, 'docs/' || doc_id || '.txt' AS source, 'docs/' || doc_id || '.txt#L' || start || '-L' || "end" AS anchor FROM w)
SELECT doc_id, start, "end", anchor, sha1(source || chr(0) || anchor || chr(0) || '[code/text] ' || anchor || chr(10) || part || chr(10)) AS chunk_id FROM a
""")
def code_windows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lit("docs").alias("repo"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.lit("text").alias("language"), "text")
    return chunkers.code_windows(docs, keep=("doc_id",)).select("doc_id", "start", "end", "anchor", "chunk_id")


SENTENCES = f"""
l AS (SELECT doc_id, unnest({LINES}) AS raw, generate_subscripts({LINES}, 1) - 1 AS i FROM documents WHERE strlen(text) > 0),
f AS (SELECT *, trim(raw, ' \t\n\r\f') AS bare FROM l),
g AS (SELECT *, starts_with(bare, '```') AS fence, starts_with(bare, '```') OR (sum(starts_with(bare, '```')::INT) OVER (PARTITION BY doc_id ORDER BY i)) % 2 = 1 AS code FROM f),
c AS (SELECT *, fence OR (NOT code AND (bare = '' OR regexp_matches(bare, '^(#|>|\\||---|===|<!--)'))) AS cut FROM g),
p AS (SELECT *, sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY i) AS para FROM c),
n AS (SELECT doc_id, i, para, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '^{S}*[-*+]{S}+', ''), '^{S}*[0-9]+\\.{S}+', ''), '<[^>]+>', '', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '`[^`]+`', '', 'g'), '\\*+([^*]+)\\*+', '\\1', 'g'), ' \t\n\r\f') AS clean FROM p WHERE NOT code AND NOT cut),
t AS (SELECT doc_id, para, min(i) + 1 AS line, string_agg(clean, ' ' ORDER BY i) AS t FROM n WHERE clean <> '' GROUP BY doc_id, para),
u AS (SELECT doc_id, line, unnest(string_split_regex(regexp_replace(t, '([.!?]){S}+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM t),
s AS (SELECT doc_id, line::INT AS line, trim(s, ' \t\n\r\f') AS text FROM u WHERE strlen(trim(s, ' \t\n\r\f')) >= 20 AND contains(trim(s, ' \t\n\r\f'), ' ') AND regexp_matches(s, '[A-Za-z]'))
"""


def _sentences(spark, d):
    return chunkers.sentences(table(spark, d, "documents"), "doc_id").select("doc_id", F.col("line").cast("int").alias("line"), "text")


@query(f"WITH {SENTENCES} SELECT doc_id, line, text FROM s")
def sentences(spark, d):
    return _sentences(spark, d)


FORM = "CASE WHEN ends_with(text, '?') THEN 'question' WHEN ends_with(text, '!') THEN 'imperative' WHEN starts_with(lower(text), 'if ') OR contains(lower(text), ' unless ') OR contains(lower(text), ' otherwise ') THEN 'conditional' WHEN contains(lower(text), ' not ') OR contains(lower(text), ' never ') OR starts_with(lower(text), 'no ') OR starts_with(lower(text), 'do not ') OR starts_with(lower(text), 'don''t ') THEN 'negation' WHEN regexp_matches(lower(text), '^(use|run|check|verify|ensure|set|add|remove|delete|create|configure|install|build|test|deploy) ') THEN 'imperative' ELSE 'affirmation' END"
MODAL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(upper(text), '{c}')" for c in cues) + f" THEN '{m}'" for m, cues in text.MODALITIES) + " WHEN starts_with(lower(text), 'if ') OR contains(lower(text), ' unless ') THEN 'conditional' ELSE '' END"


@query(f"WITH {SENTENCES} SELECT syntactic_form, modality, count(*) AS n FROM (SELECT {FORM} AS syntactic_form, {MODAL} AS modality FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'If you must not ' || text WHEN doc_id % 3 = 1 THEN 'Use it; it may ' || text ELSE text END AS text FROM s)) GROUP BY ALL")
def sentence_axes(spark, d):
    m = F.col("doc_id") % 3
    s = _sentences(spark, d).select(F.when(m == 0, F.concat(F.lit("If you must not "), "text")).when(m == 1, F.concat(F.lit("Use it; it may "), "text")).otherwise(F.col("text")).alias("text"))
    return s.groupBy(text.syntactic_form("text").alias("syntactic_form"), text.modality("text").alias("modality")).agg(F.count("*").alias("n"))


HEADED = f"SELECT doc_id, array_to_string(list_transform({LINES}, lambda x, i: CASE WHEN i % 5 = 1 THEN '## S' || (i - 1) ELSE x END), chr(10)) AS text FROM documents WHERE strlen(text) > 0"


def _headed(spark, d):
    ls = F.transform(text.lines_of("text"), lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("## S"), i.cast("string"))).otherwise(x))
    return table(spark, d, "documents").where(F.octet_length("text") > 0).select("doc_id", F.array_join(ls, "\n").alias("text"))


@query(f"""
WITH h AS ({HEADED}), l AS (SELECT doc_id, unnest({LINES}) AS raw, generate_subscripts({LINES}, 1) AS i FROM h),
s AS (SELECT *, starts_with(trim(raw, ' \t\n\r\f'), '## ') AS head, sum(starts_with(trim(raw, ' \t\n\r\f'), '## ')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM l)
SELECT doc_id, section::BIGINT AS section, max(CASE WHEN head THEN substr(raw, 4) END) AS heading, md5(coalesce(string_agg(CASE WHEN NOT head THEN raw END, chr(10) ORDER BY i), '')) AS body_md5 FROM s WHERE section > 0 GROUP BY doc_id, section
""")
def heading_sections(spark, d):
    s = chunkers.heading_sections(_headed(spark, d))
    return s.select("doc_id", F.col("section").cast("long").alias("section"), "heading", F.md5("body").alias("body_md5"))


@query()
def markdown_chunks(spark, d):
    """Sections split, packed and merged: an order-dependent fold, so there is no SQL for it."""
    files = _headed(spark, d).select(F.concat(F.lit("patterns/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source"), F.lit("").alias("source_sha"), F.lit("universal").alias("scope"), F.lit("pattern").alias("doc_type"), F.concat(F.lit("# T\n"), "text").alias("text"))
    return chunkers.markdown_chunks(files).select("source", "seq", "source_anchor", "title", "chunk_id", F.octet_length("body").alias("bytes"))


# ---------------------------------------------------------------- citations

CITED = "SELECT doc_id AS chunk_id, CASE WHEN doc_id % 10 < 9 THEN 'D' || doc_id ELSE '' END AS artifact_id, coalesce(text, '') || ' See D' || (doc_id // 2) || ', D' || (doc_id // 3 * 2) || ', AP' || (doc_id % 9) || ' and xD1, SB-' || (doc_id % 4) || '; WA-L-3.' AS body FROM documents"


def _cited(spark, d):
    n = F.col("doc_id")
    s = lambda x: x.cast("string")
    half, third = (F.floor(n / k) for k in (2, 3))
    body = F.concat(F.coalesce("text", F.lit("")), F.lit(" See D"), s(half), F.lit(", D"), s(third * 2), F.lit(", AP"), s(n % 9), F.lit(" and xD1, SB-"), s(n % 4), F.lit("; WA-L-3."))
    c = table(spark, d, "documents").select(n.alias("chunk_id"), F.when(n % 10 < 9, F.concat(F.lit("D"), s(n))).otherwise("").alias("artifact_id"), body.alias("body"))
    return c.withColumn("cites_outbound", text.cites("body"))


CITES = "list_sort(list_distinct(list_concat(" + ", ".join(f"regexp_extract_all(body, '\\b(?:{p})\\b')" for p in text.CITE_PATTERNS) + ")))"


@query(f"SELECT chunk_id, array_to_string({CITES}, ',') AS cites FROM ({CITED})")
def cites(spark, d):
    return _cited(spark, d).select("chunk_id", F.array_join("cites_outbound", ",").alias("cites"))


@query(f"""
WITH c AS ({CITED}), e AS (SELECT chunk_id, artifact_id, unnest({CITES}) AS cite FROM c),
i AS (SELECT o.chunk_id, string_agg(DISTINCT e.artifact_id, ',' ORDER BY e.artifact_id) AS inbound FROM e JOIN c o ON o.artifact_id = e.cite AND o.artifact_id <> '' AND o.chunk_id <> e.chunk_id WHERE e.artifact_id <> '' GROUP BY 1)
SELECT chunk_id, coalesce(inbound, '') AS inbound FROM c LEFT JOIN i USING (chunk_id)
""")
def cites_inbound(spark, d):
    return graph.with_inbound(_cited(spark, d)).select("chunk_id", F.array_join("cites_inbound", ",").alias("inbound"))


@query(f"WITH c AS ({CITED}), e AS (SELECT chunk_id, unnest({CITES}) AS cite FROM c) SELECT e.cite, count(*) AS n FROM e JOIN c o ON o.artifact_id = e.cite AND o.artifact_id <> '' AND o.chunk_id <> e.chunk_id GROUP BY 1")
def cite_edges(spark, d):
    return graph.cite_edges(_cited(spark, d)).groupBy("cite").agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE 'AP' || (p_partkey % 40) END AS term, p_name AS body FROM part) SELECT term, min(p_partkey) AS first_part, arg_min(body, p_partkey) AS body FROM t WHERE term <> 'x' GROUP BY term")
def first_definition(spark, d):
    p = table(spark, d, "part").select(F.when(F.col("p_partkey") % 5 == 0, "x").otherwise(F.concat(F.lit("AP"), (F.col("p_partkey") % 40).cast("string"))).alias("artifact_id"), F.col("p_partkey").alias("source"), F.lit("").alias("source_anchor"), F.col("p_name").alias("body"))
    return graph.first_definitions(p, graph.category("artifact_id")).select("term", F.col("source").alias("first_part"), "body")


@query("SELECT count(*) AS n, count(*) FILTER (p_size > 25) AS known FROM part")
def dictionary_merge(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("term"), "p_size")
    old = p.where("p_size > 25")
    m = graph.merged_terms(old, p)
    return m.agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("known"))


# ---------------------------------------------------------------- paths and scalars


def _case(col: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN '{v}'" for test, v in rules)


FOLDERS = [p for p, _ in dims.scope_rules()] + ["other/"]
_FOLDER = f"[{', '.join(repr(x) for x in FOLDERS)}][(page_id % {len(FOLDERS)} + 1)::INT] || page_id || CASE WHEN page_id % 2 = 0 THEN '.yaml' ELSE '.md' END"


def _paths(spark, d):
    n = F.col("page_id")
    path = F.concat(F.element_at(F.array(*map(F.lit, FOLDERS)), (n % len(FOLDERS) + 1).cast("int")), n.cast("string"), F.when(n % 2 == 0, ".yaml").otherwise(".md"))
    return table(spark, d, "pages").select("page_id", path.alias("path"))


@query(f"SELECT page_id, path, {_case('path', [(f'''starts_with(path, '{p}')''', s) for p, s in dims.scope_rules()])} ELSE 'universal' END AS scope, {_case('path', [(f'''starts_with(path, '{p}')''' + (f''' AND ends_with(path, '{x}')''' if x else ''), t) for p, x, t in dims.DOC_TYPES])} ELSE 'doc' END AS doc_type FROM (SELECT page_id, {_FOLDER} AS path FROM pages)")
def path_scope_doctype(spark, d):
    return _paths(spark, d).select("page_id", "path", dims.path_scope("path").alias("scope"), dims.path_doc_type("path").alias("doc_type"))


_NEEDLES = [n for n, _ in text.PATH_CONCERNS]
_MIX = f"'src/' || upper([{', '.join(repr(x) for x in _NEEDLES)}][(page_id % {len(_NEEDLES)} + 1)::INT]) || '/' || [{', '.join(repr(x) for x in _NEEDLES)}][(page_id * 7 % {len(_NEEDLES)} + 1)::INT] || '.java'"


@query(f"SELECT page_id, array_to_string(list_filter([{', '.join(f'''CASE WHEN {' OR '.join(f'contains(lower(path), {n!r})' for n, k in text.PATH_CONCERNS if k == c)} THEN {c!r} END''' for c in dict.fromkeys(k for _, k in text.PATH_CONCERNS))}], lambda x: x IS NOT NULL), ',') AS concerns FROM (SELECT page_id, {_MIX} AS path FROM pages)")
def path_concerns(spark, d):
    n, a = F.col("page_id"), F.array(*map(F.lit, _NEEDLES))
    path = F.concat(F.lit("src/"), F.upper(F.element_at(a, (n % len(_NEEDLES) + 1).cast("int"))), F.lit("/"), F.element_at(a, (n * 7 % len(_NEEDLES) + 1).cast("int")), F.lit(".java"))
    return table(spark, d, "pages").select("page_id", F.array_join(text.path_concerns(path), ",").alias("concerns"))


_EXTS = [*dims.LANGUAGES, "zzz"]


@query(f"SELECT doc_id, {_case('e', [(f'''e = '{k}' ''', v) for k, v in dims.LANGUAGES.items()])} ELSE 'text' END AS language FROM (SELECT doc_id, [{', '.join(repr(x) for x in _EXTS)}][(doc_id % {len(_EXTS)} + 1)::INT] AS e FROM documents)")
def language_from_ext(spark, d):
    ext = F.element_at(F.array(*map(F.lit, _EXTS)), (F.col("doc_id") % len(_EXTS) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", dims.language(F.concat(F.lit("a/b."), F.upper(ext))).alias("language"))


@query("""
SELECT p_partkey, substr(regexp_replace(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9 _-]', '', 'g'), '[ _]', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS anchor,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' / X_Y'), '[ _/-]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS words FROM part
""")
def slugs(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slug_anchor("p_name", F.lit(0)).alias("anchor"), text.slug_words(F.concat("p_name", F.lit(" / X_Y"))).alias("words"))


_CAP = "left(text, list_max(list_filter(range(0, 102), lambda k: strlen(left(text, k::INT)) <= 101))::INT)"


@query(f"SELECT doc_id, {_CAP} AS capped, CASE WHEN strlen(text) <= 101 THEN text ELSE CASE WHEN instr(substr({_CAP}, 2), chr(10)) > 0 THEN regexp_replace({_CAP}, '\\n[^\\n]*\\z', '') ELSE {_CAP} END || chr(10) || '... [truncated, original ' || strlen(text) || ' bytes]' END AS lines FROM documents WHERE text IS NOT NULL")
def byte_caps(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", text.cap_utf8("text", 101).alias("capped"), text.cap_lines("text", 101).alias("lines"))


_BANNED = "(?im)^[^\\n]*(?:licen[sc]ed under|apache license|public license)[^\\n]*\\n?"


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{_BANNED}')) AS n, md5(regexp_replace(text, '{_BANNED}', '', 'g')) AS clean_md5 FROM documents WHERE text IS NOT NULL")
def strip_lines(spark, d):
    p = (text.line_with("licen[sc]ed under", "apache license", "public license"),)
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", text.stripped_count("text", p).cast("long").alias("n"), F.md5(text.strip_lines("text", p)).alias("clean_md5"))


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k, strlen(props)::INT AS bytes FROM events")
def json_extract(spark, d):
    """The object inside a model's answer, and a field of it."""
    found = text.json_object_in(F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone.")))
    return table(spark, d, "events").select("event_id", text.json_field(found, "k").cast("long").alias("k"), F.octet_length(found).alias("bytes"))


# ---------------------------------------------------------------- manifests and sync


@query("SELECT CASE WHEN g = 1 THEN 'scope' WHEN g = 2 THEN 'doc_type' ELSE 'total' END AS axis, CASE WHEN g = 1 THEN lang WHEN g = 2 THEN source ELSE '' END AS value, n FROM (SELECT lang, source, grouping(lang, source) AS g, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ()))")
def manifest_rollup(spark, d):
    return sync.tallies(table(spark, d, "documents").select(F.col("lang").alias("scope"), F.col("source").alias("doc_type")))


@query("SELECT scope, count(doc_id) AS n FROM (VALUES ('universal'), ('backend'), ('webapp'), ('mobile'), ('e2e'), ('infra'), ('platform-process')) AS s(scope) LEFT JOIN (SELECT doc_id, CASE WHEN lang = 'en' THEN 'universal' WHEN lang = 'fr' THEN 'infra' END AS sc FROM documents) ON sc = scope GROUP BY scope")
def zero_scope_counts(spark, d):
    docs = table(spark, d, "documents").select(F.when(F.col("lang") == "en", "universal").when(F.col("lang") == "fr", "infra").alias("scope"))
    return sync.scope_counts(docs).select("scope", "n")


_OLD = "SELECT doc_id AS path, md5(text) AS sha, lang AS scope FROM documents WHERE doc_id % 7 <> 3"
_NEW = "SELECT doc_id AS path, CASE WHEN doc_id % 11 = 0 THEN md5(text || 'x') ELSE md5(text) END AS sha, CASE WHEN doc_id % 13 = 0 THEN 'moved' ELSE lang END AS scope FROM documents WHERE doc_id % 7 <> 5"
_DIFF = f"SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change, o.scope AS old_scope, n.scope AS new_scope FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.sha IS DISTINCT FROM n.sha OR o.scope IS DISTINCT FROM n.scope"


def _pair(spark, d):
    docs, n = table(spark, d, "documents"), F.col("doc_id")
    old = docs.where(n % 7 != 3).select(n.alias("path"), F.md5("text").alias("sha"), F.col("lang").alias("scope"))
    new = docs.where(n % 7 != 5).select(n.alias("path"), F.when(n % 11 == 0, F.md5(F.concat("text", F.lit("x")))).otherwise(F.md5("text")).alias("sha"), F.when(n % 13 == 0, "moved").otherwise(F.col("lang")).alias("scope"))
    return old, new


@query(_DIFF)
def manifest_diff(spark, d):
    return sync.diff(*_pair(spark, d))


@query(f"SELECT path AS source, sha, scope FROM ({_NEW})")
def sync_apply(spark, d):
    """The table after a sync equals the new one."""
    old, new = _pair(spark, d)
    changes = sync.diff(old, new)
    as_chunks = lambda df: df.select(F.col("path").alias("source"), "sha", "scope", F.concat_ws(":", "path", "sha", "scope").alias("chunk_id"))
    return sync.upsert(as_chunks(old), sync.affected(as_chunks(new), changes), changes).select("source", "sha", "scope")


# ---------------------------------------------------------------- retrieval

_V = "SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS nv FROM embeddings"
_HITS = f"q AS (SELECT vec_id AS qid, label AS ql, embedding AS qe, nv AS nq FROM ({_V}) WHERE vec_id % 20 = 0), h AS (SELECT qid, ql, vec_id AS id, label, round(1 - CASE WHEN nq > 0 AND nv > 0 THEN list_sum(list_transform(list_zip(qe, embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (nq * nv) ELSE 0 END, 6) AS distance FROM q, ({_V}))"


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    scope = F.when(F.col("label") < 5, "backend").otherwise("universal")
    family = F.when(F.col("label") % 5 == 0, "failure_modes").when(F.col("label") % 5 < 3, "corpus").otherwise("code")
    return e.select(F.col("vec_id").alias("id"), family.alias("family"), scope.alias("scope"), F.col("label").cast("string").alias("source"), F.lit("").alias("doc"), "embedding")


def _asked(spark, d, scopes=None):
    """Every 20th vector is a query, against all vectors."""
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), (F.lit(None).cast("array<string>") if scopes is None else scopes).alias("scopes"), "label", "embedding")


_FAM = "CASE WHEN label % 5 = 0 THEN 'failure_modes' WHEN label % 5 < 3 THEN 'corpus' ELSE 'code' END"
_SCO = "CASE WHEN label < 5 THEN 'backend' ELSE 'universal' END"


@query(f"WITH {_HITS} SELECT qid, id, distance, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM h) WHERE rank <= 10")
def topk_per_query(spark, d):
    return vectors.nearest_in_blocks(_asked(spark, d), _vectors(spark, d), 10, 6).select("qid", "id", "distance", "rank")


@query(f"WITH {_HITS} SELECT qid, scope, family, id, distance FROM (SELECT qid, id, distance, {_SCO} AS scope, {_FAM} AS family, row_number() OVER (PARTITION BY qid, {_SCO}, {_FAM} ORDER BY distance, id) AS rank FROM h WHERE {_FAM} <> 'code' OR {_SCO} = 'backend') WHERE rank <= 3")
def scoped_topn_union(spark, d):
    q = _asked(spark, d, F.array(F.lit("backend"), F.lit("universal")))
    return vectors.scoped_families(q, _vectors(spark, d), 3, digits=6).select("qid", "scope", "family", "id", "distance")


@query(f"""
WITH {_HITS}, k AS (SELECT qid, id, distance, {_FAM} = 'failure_modes' AND row_number() OVER (PARTITION BY qid, {_FAM} ORDER BY distance, id) <= 2 AS kept FROM h),
p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY kept DESC, distance, id) AS place FROM k)
SELECT qid, id, (row_number() OVER (PARTITION BY qid ORDER BY distance, id))::INT AS rank FROM p WHERE place <= 6
""")
def topn_with_reserve(spark, d):
    return vectors.reserved(_asked(spark, d), _vectors(spark, d), 6, digits=6).select("qid", "id", "rank")


@query(f"""
WITH RECURSIVE {_HITS}, n AS (SELECT qid, id, label, distance FROM h QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, id) <= 120),
o AS (SELECT qid, id::VARCHAR AS id, distance, label || '/' || (id % 4) AS source, CASE WHEN {_FAM} = 'failure_modes' THEN 'avoid' WHEN {_FAM} = 'corpus' THEN 'prefer' ELSE 'convention' END AS bucket, row_number() OVER (PARTITION BY qid ORDER BY distance, id::VARCHAR) AS i FROM n),
f AS (SELECT qid, 0::BIGINT AS i, []::STRUCT(distance DOUBLE, id VARCHAR, source VARCHAR, bucket VARCHAR)[] AS held FROM (SELECT DISTINCT qid FROM o) UNION ALL
  SELECT f.qid, o.i, CASE WHEN NOT list_contains(list_transform(held, lambda x: x.source), o.source) AND len(list_filter(held, lambda x: x.bucket = o.bucket)) < 4 THEN list_append(held, {{'distance': o.distance, 'id': o.id, 'source': o.source, 'bucket': o.bucket}}) ELSE held END FROM f JOIN o ON o.qid = f.qid AND o.i = f.i + 1),
l AS (SELECT qid, unnest(held) AS x FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY qid ORDER BY i DESC) = 1)),
r AS (SELECT qid, x.id AS id, x.bucket AS bucket, (row_number() OVER (PARTITION BY qid ORDER BY CASE x.bucket WHEN 'avoid' THEN 0 WHEN 'prefer' THEN 1 ELSE 2 END, x.distance, x.id))::INT AS rank FROM l)
SELECT * FROM r WHERE rank <= 9
""")
def bucket_balanced_topk(spark, d):
    """Source and bucket caps interact in the order of distance: a fold.  Every 20th vector is a query."""
    h = vectors.nearest_in_blocks(_asked(spark, d), _vectors(spark, d), 120, 6).drop("rank").withColumn("doc_type", F.when(F.col("family") == "corpus", "pattern").otherwise("standard")).withColumn("cites", F.array(F.concat(F.lit("D"), "source"))).withColumn("source", F.concat_ws("/", "source", F.col("id") % 4))
    return vectors.balanced(h, 9).select("qid", "id", "bucket", "rank")


@query(f"""
WITH {_HITS}, r AS (SELECT qid, ql, label, id, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM h WHERE id <> qid),
b AS (SELECT qid, coalesce(min(rank) FILTER (label = ql AND rank <= 10), 0) AS hit_at FROM r GROUP BY qid)
SELECT avg(CASE WHEN hit_at BETWEEN 1 AND 1 THEN 1.0::DOUBLE ELSE 0 END) AS recall_1, avg(CASE WHEN hit_at BETWEEN 1 AND 5 THEN 1.0::DOUBLE ELSE 0 END) AS recall_5, avg(CASE WHEN hit_at BETWEEN 1 AND 10 THEN 1.0::DOUBLE ELSE 0 END) AS recall_10 FROM b
""")
def recall_at_k(spark, d):
    q = _asked(spark, d)
    others = vectors.nearest_in_blocks(q, _vectors(spark, d), 11, 6).drop("rank").where("id != qid")
    h = vectors.hit_ranks(vectors.nearest(others, 10), q.select("qid", F.col("label").cast("string").alias("expected_source")))
    return h.agg(*[vectors.recall_at(h, k).alias(f"recall_{k}") for k in (1, 5, 10)])


@query("SELECT o_custkey, b::DOUBLE AS b, c::DOUBLE AS c, CASE WHEN b = 0 AND c = 0 THEN 0::DOUBLE WHEN b = 0 THEN 1.7976931348623157e308 ELSE (c - b)::DOUBLE / b END AS rel, CASE WHEN b = 0 AND c = 0 THEN false WHEN b = 0 THEN true ELSE (c - b)::DOUBLE / b >= 0.1 END AS pass FROM (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS b, count(*) FILTER (o_orderstatus = 'O') AS c FROM orders GROUP BY 1)")
def relative_gate(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("b"), F.count_if(F.col("o_orderstatus") == "O").cast("double").alias("c"))
    rel, ok = vectors.relative_gate("b", "c")
    return o.select("o_custkey", "b", "c", rel.alias("rel"), ok.alias("pass"))


@query(f"WITH {_HITS} SELECT qid, id AS negative_id, score FROM (SELECT qid, id, round(1 - distance, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(1 - distance, 6) DESC, id) AS r FROM h WHERE label <> ql) WHERE r = 1")
def hard_negatives(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.dense_negatives(e.select(F.col("vec_id").alias("id"), "label", "embedding"), _asked(spark, d)).select("qid", "negative_id", "score")


_TAGGED = "SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE p_brand END AS scope, (p_size % 3)::VARCHAR AS role, list_sort(['c:' || (p_partkey % 4), 'l:' || (p_size % 5), 'f:' || (p_partkey % 3)]) AS tags FROM part"


@query(f"""
WITH t AS ({_TAGGED}), g AS (SELECT scope, role, tags, min(lpad(id::VARCHAR, 9, '0')) AS rep FROM t GROUP BY ALL),
p AS (SELECT a.scope, a.role, a.tags, n.rep, n.role AS nr, len(list_intersect(a.tags, n.tags)) / sqrt(len(a.tags) * len(n.tags)) AS score FROM g a JOIN g n ON a.scope = n.scope AND a.role <> n.role AND a.scope <> ''),
b AS (SELECT *, false AS relaxed FROM p QUALIFY row_number() OVER (PARTITION BY scope, role, tags ORDER BY round(score, 9) DESC, rep) = 1),
r AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.scope = g.scope AND b.role = g.role AND b.tags = g.tags)),
l AS (SELECT a.scope, a.role, a.tags, n.rep, n.role AS nr, len(list_intersect(a.tags, n.tags)) / sqrt(len(a.tags) * len(n.tags)) AS score FROM r a JOIN g n ON a.role <> n.role),
c AS (SELECT *, true AS relaxed FROM l QUALIFY row_number() OVER (PARTITION BY scope, role, tags ORDER BY round(score, 9) DESC, rep) = 1)
SELECT lpad(t.id::VARCHAR, 9, '0') AS anchor_id, rep AS negative_id, nr AS negative_role, relaxed FROM t JOIN (SELECT * FROM b UNION ALL SELECT * FROM c) USING (scope, role, tags)
""")
def tag_negatives(spark, d):
    """A sixth of the sentences has no scope, so their negatives come from all scopes."""
    p = table(spark, d, "part")
    scope = F.when(F.col("p_partkey") % 6 == 0, "").otherwise(F.col("p_brand"))
    s = p.select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("id"), scope.alias("scope"), (F.col("p_size") % 3).cast("string").alias("semantic_role"), vectors.sentence_tags(F.array((F.col("p_partkey") % 4).cast("string")), (F.col("p_size") % 5).cast("string"), (F.col("p_partkey") % 3).cast("string")).alias("tags"))
    return vectors.tag_negatives(s).select("anchor_id", "negative_id", "negative_role", "relaxed")


# ---------------------------------------------------------------- ledgers

_REACT = "SELECT event_id AS line_no, CASE WHEN user_id % 9 = 0 THEN 'none' ELSE 't' || user_id END AS turn_id, CASE WHEN event_id % 10 = 0 THEN 'retro' ELSE 'live' END AS phase, CASE WHEN event_id % 7 = 0 THEN 'retracted' WHEN event_id % 7 = 1 THEN 'wrong' WHEN event_id % 7 = 2 THEN 'confirmed' ELSE '' END AS label, CASE WHEN event_id % 3 = 0 THEN 'accept' WHEN event_id % 3 = 1 THEN 'reject' ELSE 'partial' END AS reaction, CASE WHEN event_id % 2 = 0 THEN 'challenge' ELSE 'validate' END AS subcommand FROM events"
_EFF = f"e AS (SELECT turn_id, arg_max(struct_pack(line_no, phase, label, reaction, subcommand), (phase = 'retro')::BIGINT * 1000000000 + line_no) AS r FROM ({_REACT}) WHERE turn_id NOT IN ('', 'none') GROUP BY turn_id), f AS (SELECT turn_id, r.* FROM e WHERE r.label IS DISTINCT FROM 'retracted')"


def _reactions(spark, d):
    n = F.col("event_id")
    return table(spark, d, "events").select(
        n.alias("line_no"), F.when(F.col("user_id") % 9 == 0, "none").otherwise(F.concat(F.lit("t"), F.col("user_id").cast("string"))).alias("turn_id"), F.when(n % 10 == 0, "retro").otherwise("live").alias("phase"),
        F.when(n % 7 == 0, "retracted").when(n % 7 == 1, "wrong").when(n % 7 == 2, "confirmed").otherwise("").alias("label"), F.when(n % 3 == 0, "accept").when(n % 3 == 1, "reject").otherwise("partial").alias("reaction"),
        F.when(n % 2 == 0, "challenge").otherwise("validate").alias("subcommand"), F.lit("").alias("verdict"), F.lit("n").alias("note"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
        F.when(n % 4 == 0, F.array(F.lit("D999"), F.lit("plain word"))).alias("unresolved_cites"),
    )


def _turns(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(F.concat(F.lit("t"), k.cast("string")).alias("turn_id"), F.array("c_mktsegment").alias("scope"), F.col("c_name").alias("request"), F.when(k % 2 == 0, "INVALID").otherwise("failed").alias("verdict"), F.when(k % 5 == 0, "abort").alias("proceed"), F.when(k % 3 == 0, F.col("c_name")).alias("claim"), F.when(k % 3 == 0, F.lit("diff")).alias("diff"), F.array().cast("array<string>").alias("cites"))


@query(f"WITH {_EFF} SELECT turn_id, line_no, phase, label, reaction FROM f")
def effective_reaction(spark, d):
    return ledger.effective(_reactions(spark, d)).select("turn_id", "line_no", "phase", "label", "reaction")


@query(f"WITH {_EFF} SELECT f.turn_id, f.line_no, c.c_name AS request FROM f LEFT JOIN customer c ON f.turn_id = 't' || c.c_custkey")
def harvest_join(spark, d):
    return ledger.signals(_reactions(spark, d), _turns(spark, d)).select("turn_id", "line_no", F.col("turn.request").alias("request"))


@query(f"""
WITH {_EFF}, s AS (SELECT f.*, CASE WHEN label <> '' THEN label WHEN reaction = 'accept' THEN 'confirmed' WHEN reaction = 'reject' THEN 'wrong' ELSE 'partial' END AS h, c.c_custkey AS k FROM f LEFT JOIN customer c ON f.turn_id = 't' || c.c_custkey),
p AS (SELECT turn_id, CASE WHEN h = 'confirmed' THEN CASE WHEN k IS NOT NULL THEN 'eval_case' ELSE 'eval_pointer' END WHEN h IN ('wrong', 'partial') THEN 'investigate' END AS kind, h FROM s
  UNION ALL SELECT turn_id, 'corpus_gap', h FROM s WHERE line_no % 4 = 0 UNION ALL SELECT turn_id, 'dictionary_term', h FROM s WHERE line_no % 4 = 0)
SELECT kind || ':' || turn_id AS id, kind, h AS label FROM p WHERE kind IS NOT NULL
""")
def harvest_classify(spark, d):
    return ledger.proposals(ledger.signals(_reactions(spark, d), _turns(spark, d))).select("id", "kind", "label")


@query(f"""
WITH r AS (SELECT *, ts FROM ({_REACT}) JOIN (SELECT event_id AS line_no, ts FROM events) USING (line_no)),
b AS (SELECT turn_id, arg_max(line_no, (phase = 'retro')::BIGINT * 1000000000000 + line_no) AS best, arg_max(label, (phase = 'retro')::BIGINT * 1000000000000 + line_no) AS best_label FROM r WHERE turn_id <> 'none' GROUP BY turn_id),
x AS (SELECT r.*, best, best_label, r.turn_id <> 'none' AS live, CASE WHEN c_custkey % 2 = 0 THEN 'INVALID' WHEN c_custkey IS NOT NULL THEN 'failed' END AS v, CASE WHEN c_custkey % 5 = 0 THEN 'abort' END AS p,
  CASE WHEN label <> '' THEN label WHEN reaction = 'accept' THEN 'confirmed' WHEN reaction = 'reject' THEN 'wrong' ELSE 'partial' END AS h
  FROM r LEFT JOIN b USING (turn_id) LEFT JOIN customer ON r.turn_id = 't' || c_custkey),
w AS (SELECT *, CASE WHEN live AND best_label = 'retracted' THEN 'retracted' WHEN live AND best <> line_no THEN 'superseded' WHEN h <> 'wrong' THEN 'not a confirmed false block'
  WHEN p IS NULL AND v IS NULL THEN 'no verdict evidence'
  WHEN NOT coalesce(CASE WHEN p IS NOT NULL THEN p = CASE subcommand WHEN 'challenge' THEN 'abort' ELSE 'block' END WHEN subcommand = 'challenge' THEN v IN ('INVALID', 'OUT_OF_SCOPE') ELSE v = 'failed' END, false) THEN 'not the hard block'
  WHEN subcommand = 'validate' THEN 'surface is advisory' WHEN date_trunc('second', ts) <= TIMESTAMP '2023-06-01' THEN 'predates promotion' END AS why FROM x),
f AS (SELECT subcommand, min(line_no) AS first FROM w WHERE why IS NULL GROUP BY subcommand),
z AS (SELECT line_no, turn_id, w.subcommand, CASE WHEN why IS NULL AND line_no <> first THEN 'already demoted' ELSE why END AS reason FROM w LEFT JOIN f ON w.subcommand = f.subcommand)
SELECT line_no, turn_id, subcommand, CASE WHEN reason IS NULL THEN 'demoted' ELSE 'skipped' END AS action, reason FROM z
""")
def demotion_dispositions(spark, d):
    state = spark.createDataFrame([("challenge", True, "2023-06-01"), ("validate", False, "2023-06-01")], "surface string, blocking boolean, promoted_at string")
    return ledger.dispositions(_reactions(spark, d), state, _turns(spark, d).select("turn_id", "verdict", "proceed"))


_LOG = "SELECT CASE event_id % 6 WHEN 0 THEN 'hit' WHEN 1 THEN 'hit' WHEN 2 THEN 'miss' WHEN 3 THEN 'store' WHEN 4 THEN 'drift' ELSE 'invalidate' END AS event, user_id % 100 AS creation, user_id % 50 AS reads, user_id FROM events"


def _log(spark, d):
    m = F.col("event_id") % 6
    return table(spark, d, "events").select("user_id", F.when(m <= 1, "hit").when(m == 2, "miss").when(m == 3, "store").when(m == 4, "drift").otherwise("invalidate").alias("event"), (F.col("user_id") % 100).alias("cache_creation_tokens"), (F.col("user_id") % 50).alias("cache_read_tokens"))


@query(f"SELECT hits, misses, stores, invalidates, drifts, 0::BIGINT AS prunes, c AS cache_creation_tokens, r AS cache_read_tokens, 100 * (CASE WHEN greatest(hits - drifts, 0) + misses + drifts = 0 THEN 0 ELSE greatest(hits - drifts, 0)::DOUBLE / (greatest(hits - drifts, 0) + misses + drifts) END) AS hit_rate_pct FROM (SELECT count(*) FILTER (event = 'hit') AS hits, count(*) FILTER (event = 'miss') AS misses, count(*) FILTER (event = 'store') AS stores, count(*) FILTER (event = 'invalidate') AS invalidates, count(*) FILTER (event = 'drift') AS drifts, (sum(creation) FILTER (event = 'store'))::BIGINT AS c, (sum(reads) FILTER (event = 'store'))::BIGINT AS r FROM ({_LOG}))")
def cache_stats(spark, d):
    return ledger.cache_stats(_log(spark, d))


@query(f"SELECT user_id, CASE WHEN t = 0 THEN 0::DOUBLE ELSE s::DOUBLE / t END AS rate FROM (SELECT user_id, greatest(h - dr, 0) AS s, greatest(h - dr, 0) + m + dr AS t FROM (SELECT user_id, count(*) FILTER (event = 'hit') AS h, count(*) FILTER (event = 'miss') AS m, count(*) FILTER (event = 'drift') AS dr FROM ({_LOG}) GROUP BY user_id))")
def hit_rate(spark, d):
    g = _log(spark, d).groupBy("user_id").agg(*[F.count_if(F.col("event") == k).alias(k) for k in ("hit", "drift", "miss")])
    return g.select("user_id", ledger.hit_rate("hit", "drift", "miss").alias("rate"))


@query("""
WITH o AS (SELECT event_id AS path, (event_id % 1000 + 1)::BIGINT AS size, ts AS mtime FROM events),
c AS (SELECT *, coalesce(sum(size) OVER (ORDER BY mtime, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum, sum(size) OVER () AS total FROM o)
SELECT path, size FROM c WHERE total - cum > 1000000
""")
def prune_oldest_first(spark, d):
    o = table(spark, d, "events").select(F.col("event_id").alias("path"), (F.col("event_id") % 1000 + 1).cast("long").alias("size"), F.col("ts").alias("mtime"))
    return ledger.prune(o, max_bytes=1_000_000).select("path", "size")


@query("SELECT o_custkey, max(o_orderkey) AS line_no, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def latest_receipt(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "line_no")
    return ledger.latest_receipt(o, ["o_custkey"], o_orderstatus="F").select("o_custkey", "line_no", "o_totalprice")


# ---------------------------------------------------------------- evaluation

_CASES = "SELECT l_orderkey AS case_id, count(*) FILTER (l_returnflag = 'R') AS blockers, count(*) FILTER (l_returnflag = 'A') AS warnings, count(*) FILTER (l_returnflag = 'N') AS infos, min(l_linenumber) AS attempts, CASE WHEN l_orderkey % 97 = 0 THEN 'boom' ELSE '' END AS error FROM lineitem GROUP BY l_orderkey"
_BASE = "SELECT l_orderkey AS case_id, count(*) FILTER (l_returnflag = 'R' AND l_linenumber > 2) AS blockers, count(*) FILTER (l_returnflag = 'A' AND l_linenumber > 2) AS warnings, '' AS error FROM lineitem GROUP BY l_orderkey"


def _cases(spark, d):
    flag = lambda x: F.count_if(F.col("l_returnflag") == x)
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(flag("R").alias("blockers"), flag("A").alias("warnings"), flag("N").alias("infos"), F.min("l_linenumber").alias("attempts"))
    return g.withColumn("error", F.when(F.col("case_id") % 97 == 0, "boom").otherwise(""))


def _baseline(spark, d):
    flag = lambda x: F.count_if((F.col("l_returnflag") == x) & (F.col("l_linenumber") > 2))
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(flag("R").alias("blockers"), flag("A").alias("warnings")).withColumn("error", F.lit(""))


@query(f"SELECT count(*) AS total_cases, count(*) FILTER (blockers = 0) AS clean_cases, sum(blockers)::BIGINT AS total_blockers, sum(warnings)::BIGINT AS total_warnings, sum(infos)::BIGINT AS total_infos, (count(*) FILTER (attempts = 1))::DOUBLE / count(*) AS first_try_rate, count(*) FILTER (error <> '') AS errors FROM ({_CASES})")
def eval_report(spark, d):
    return evalx.report(_cases(spark, d)).drop("graded_rate")


@query(f"SELECT c.case_id FROM ({_CASES}) c WHERE blockers > 0 AND case_id IN (SELECT case_id FROM ({_BASE}) WHERE error = '' AND blockers = 0 AND warnings = 0)")
def new_blockers(spark, d):
    return evalx.new_blockers(_cases(spark, d), _baseline(spark, d))


@query(f"SELECT c.case_id, CASE WHEN c.error <> '' THEN 'ERROR' ELSE c.blockers || '/' || c.warnings END AS now, coalesce(b.blockers || '/' || b.warnings, '-') AS was FROM ({_CASES}) c LEFT JOIN ({_BASE}) b USING (case_id)")
def diff_table(spark, d):
    return evalx.diff_table(_cases(spark, d), _baseline(spark, d))


@query(f"SELECT false AS pass, 4::BIGINT AS n_reasons, (SELECT count(*) FROM ({_CASES}) WHERE error <> '') AS errors, (SELECT count(*) FROM ({_CASES}) WHERE blockers > 0 AND case_id IN (SELECT case_id FROM ({_BASE}) WHERE error = '' AND blockers = 0 AND warnings = 0)) AS new_blockers")
def gate_verdict(spark, d):
    g = evalx.gate(_cases(spark, d), 10**9, 0, 0.0, _baseline(spark, d))
    return g.select("pass", F.size("reasons").cast("long").alias("n_reasons"), "errors", "new_blockers")


@query("SELECT doc_id, NOT contains(text, 'the the') AND contains(text, 'and') AS matched FROM documents")
def expected_grading(spark, d):
    docs = table(spark, d, "documents")
    r = docs.select(F.col("doc_id").alias("case_id"), F.col("text").alias("raw_output"), F.lit("VALID").alias("verdict"), F.lit(0).alias("blockers"))
    e = docs.select(F.col("doc_id").alias("case_id"), F.lit("VALID").alias("verdict"), F.lit(0).alias("max_blockers"), F.array(F.lit("and")).alias("must_cite_any_of"), F.array(F.lit("the the")).alias("must_not_cite_any_of"))
    return evalx.graded(r, e).select(F.col("case_id").alias("doc_id"), "matched")


_OUT = """'{"challenge":{"request":"' || CASE WHEN event_id % 5 = 0 THEN 'none' ELSE 'please look at this' END || '","verdict":"' || CASE WHEN event_id % 3 = 0 THEN 'INVALID' ELSE 'VALID' END || '","proceed":"' || CASE WHEN event_id % 4 = 0 THEN 'abort' ELSE 'proceed_directly' END || '","confirms":[],"contradicts":[],"clarify":[],"applicable_rules":{"standards":["D' || (event_id % 10) || '","D1"],"patterns":[],"anti_patterns_to_avoid":[],"decisions_to_honor":[]}}}'"""


@query("""
WITH e AS (SELECT event_id AS id, event_id % 3 = 0 AS inv, event_id % 4 = 0 AS ab, event_id % 5 = 0 AS ph, event_id % 10 AS k FROM events)
SELECT code, count(*) AS n FROM (
  SELECT 'cite_unresolved' AS code FROM e WHERE k > 5 UNION ALL SELECT 'duplicate_cite' FROM e WHERE k = 1 UNION ALL SELECT 'verdict_proceed_mismatch' FROM e WHERE inv <> ab
  UNION ALL SELECT 'invalid_without_contradicts' FROM e WHERE inv UNION ALL SELECT 'placeholder_request' FROM e WHERE ph UNION ALL SELECT 'empty_assessment' FROM e WHERE inv) GROUP BY code
""")
def violations(spark, d):
    n = F.col("event_id")
    raw = F.concat(
        F.lit('{"challenge":{"request":"'), F.when(n % 5 == 0, "none").otherwise("please look at this"), F.lit('","verdict":"'), F.when(n % 3 == 0, "INVALID").otherwise("VALID"), F.lit('","proceed":"'), F.when(n % 4 == 0, "abort").otherwise("proceed_directly"),
        F.lit('","confirms":[],"contradicts":[],"clarify":[],"applicable_rules":{"standards":["D'), (n % 10).cast("string"), F.lit('","D1"],"patterns":[],"anti_patterns_to_avoid":[],"decisions_to_honor":[]}}}'),
    )
    known = spark.createDataFrame([(f"D{i}",) for i in range(6)], "cite string")
    v = evalx.challenge_violations(table(spark, d, "events").select(n.alias("case_id"), raw.alias("raw")), known)
    return v.groupBy("code").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- datasets and plans


@query("SELECT conv_id, max(text) FILTER (role = 'user') AS workflow, max(text) FILTER (role = 'assistant') AS prompt FROM conversations GROUP BY conv_id HAVING workflow IS NOT NULL AND prompt IS NOT NULL")
def lifecycle_pivot(spark, d):
    c = table(spark, d, "conversations").where("role IN ('user', 'assistant')")
    f = c.select(F.col("text").alias("path"), F.col("conv_id").cast("string").alias("project"), F.lit("s").alias("stem"), F.when(F.col("role") == "user", "workflow").otherwise("prompt").alias("kind"))
    f = f.unionByName(f.select(F.lit("r").alias("path"), "project", "stem", F.lit("retrospective").alias("kind")).distinct())
    return datasets.triples(f).select(F.col("project").cast("long").alias("conv_id"), "workflow", "prompt")


@query("SELECT o_orderkey AS id, 'Decision: ' || o_orderpriority || CASE WHEN o_orderstatus = 'O' THEN '' ELSE chr(10) || chr(10) || 'Context: ' || o_orderstatus END AS answer FROM orders")
def sharegpt_rows(spark, d):
    s = lambda c: F.col(c).cast("string")
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), s("o_orderkey").alias("id"), F.lit("n").alias("name"), F.when(F.col("o_orderstatus") == "O", " ").otherwise(F.col("o_orderstatus")).alias("context"), F.col("o_orderpriority").alias("decision"), *[F.lit(None).cast("string").alias(c) for c in ("alternatives", "rationale", "outcome")])
    return datasets.decisions(e).select(F.col("source").cast("long").alias("id"), F.col("messages")[1]["content"].alias("answer"))


@query("SELECT l_orderkey, string_agg(path, ',' ORDER BY r) FILTER (r <= 3) AS top, greatest(max(n) - 3, 0)::INT AS more FROM (SELECT l_orderkey, 'f' || l_linenumber AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity::INT + l_linenumber DESC, 'f' || l_linenumber) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) GROUP BY l_orderkey")
def commit_top_files(spark, d):
    li = table(spark, d, "lineitem")
    f = li.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("path"), F.col("l_quantity").cast("int").alias("additions"), F.col("l_linenumber").alias("deletions"))).alias("files"))
    top, more = datasets.top_files("files", 3)
    return f.select("l_orderkey", F.array_join(F.transform(top, lambda x: x["path"]), ",").alias("top"), more.cast("int").alias("more"))


@query("""
WITH i AS (SELECT l_orderkey, l_partkey % 5 AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem)
SELECT l_orderkey AS case_id, 'applicable_rules.standards[' || i || ']' AS location, 'P' || k AS value FROM i QUALIFY row_number() OVER (PARTITION BY l_orderkey, k ORDER BY i) = 2
""")
def duplicate_second_occurrence(spark, d):
    """An order's parts as the cites of one answer: what is cited twice is reported once."""
    cite = F.concat(F.lit("P"), (F.col("l_partkey") % 5).cast("string"))
    o = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", cite.alias("c")))), lambda x: x["c"]).alias("standards"))
    out = o.select("case_id", F.to_json(F.struct(F.struct(F.lit("look at this").alias("request"), F.struct("standards").alias("applicable_rules")).alias("challenge"))).alias("raw"))
    v = evalx.challenge_violations(out, spark.createDataFrame([], "cite string"))
    return v.where("code = 'duplicate_cite'").select("case_id", "location", "value")


@query("SELECT part_id, count(*) AS n, max(seeded_from) AS seeded_from FROM (SELECT 'c' || c || '-part-' || (p // 25 + 1) AS part_id, CASE WHEN p >= 25 THEN 'c' || c || '-part-' || (p // 25) END AS seeded_from FROM (SELECT o_custkey % 30 AS c, row_number() OVER (PARTITION BY o_custkey % 30 ORDER BY o_orderkey) - 1 AS p FROM orders)) GROUP BY part_id")
def plan_split(spark, d):
    o = table(spark, d, "orders").withColumn("c", F.col("o_custkey") % 30)
    s = o.select(F.concat(F.lit("c"), F.col("c").cast("string")).alias("plan_id"), (F.row_number().over(Window.partitionBy("c").orderBy("o_orderkey")) - 1).alias("step_pos"))
    return steps.split(s).groupBy("part_id").agg(F.count("*").alias("n"), F.max("seeded_from").alias("seeded_from"))


@query("""
WITH RECURSIVE s AS (SELECT l_orderkey AS plan, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))::INT AS step FROM lineitem), e AS (SELECT plan, step, step // 2 AS dep FROM s WHERE step // 2 >= 1 UNION SELECT plan, step, step - 2 FROM s WHERE step - 2 >= 1),
r AS (SELECT plan, step, 0 AS level, [step] AS path FROM s WHERE step = 1 OR NOT EXISTS (SELECT 1 FROM e WHERE e.plan = s.plan AND e.step = s.step) UNION ALL SELECT e.plan, e.step, r.level + 1, list_append(r.path, e.step) FROM e JOIN r ON r.plan = e.plan AND r.step = e.dep),
l AS (SELECT plan, step, max(level)::INT AS level, arg_max(path, {'l': level, 'p': path}) AS path FROM r GROUP BY plan, step)
SELECT plan, step, level, (row_number() OVER (PARTITION BY plan ORDER BY level, path) - 1)::INT AS position FROM l
""")
def topo_levels(spark, d):
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    li = table(spark, d, "lineitem").withColumn("n", n)
    n = F.col("n")
    name = lambda c: c.cast("int").cast("string")
    deps = F.array_distinct(F.array_compact(F.array(F.when(F.floor(n / 2) >= 1, name(F.floor(n / 2))), F.when(n - 2 >= 1, name(n - 2)))))
    s = li.select(F.col("l_orderkey").cast("string").alias("plan_id"), n.alias("step_pos"), name(n).alias("step_id"), deps.alias("depends_on"))
    return steps.levels(s).select(F.col("plan_id").cast("long").alias("plan"), F.col("step_id").cast("int").alias("step"), "level", "position")


@query("""
WITH h AS (SELECT o_custkey AS qid, 'f' || (o_orderkey % 7) || CASE WHEN o_orderstatus = 'P' THEN '@x' ELSE '' END AS source, o_comment AS body FROM (SELECT *, o_orderpriority || o_orderstatus AS o_comment FROM orders)),
s AS (SELECT DISTINCT qid, source FROM h WHERE NOT contains(source, '@'))
SELECT qid, sum(strlen(body))::BIGINT AS payload, coalesce((SELECT sum(100 + ord(substr(s.source, 2, 1))) FROM s WHERE s.qid = h.qid), 0)::BIGINT AS sources FROM h GROUP BY qid
""")
def token_economy(spark, d):
    o = table(spark, d, "orders")
    h = o.select(F.col("o_custkey").alias("qid"), F.concat(F.lit("f"), (F.col("o_orderkey") % 7).cast("string"), F.when(F.col("o_orderstatus") == "P", "@x").otherwise("")).alias("source"), F.concat("o_orderpriority", "o_orderstatus").alias("body"))
    files = h.select("source").distinct().select(F.col("source").alias("path"), (F.ascii(F.substring("source", 2, 1)) + 100).cast("long").alias("size"))
    return vectors.economy(h, files)


# ---------------------------------------------------------------- streams


def _events(spark, d) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/event[s].parquet")


_SLOG = "SELECT CASE event_id % 3 WHEN 0 THEN 'hit' WHEN 1 THEN 'miss' ELSE 'store' END AS event, user_id AS creation FROM events"


@query(f"SELECT event, count(*) AS n, (sum(CASE WHEN event = 'store' THEN creation ELSE 0 END))::BIGINT AS creation_tokens FROM ({_SLOG}) GROUP BY event")
def stream_event_counts(spark, d):
    """An append-only cache log as a stream, counted until it is drained."""
    m = F.col("event_id") % 3
    log = _events(spark, d).select(F.when(m == 0, "hit").when(m == 1, "miss").otherwise("store").alias("event"), F.col("user_id").cast("long").alias("cache_creation_tokens"))
    at = new_folder(spark, "counts")
    ledgers.run_to_end(ledgers.into_table(ledgers.cache_counts(log), f"{at}/table", f"{at}/mark", "complete"), spark)
    return ledgers.last_batch(spark, f"{at}/table")


@query(f"WITH {_EFF.replace(', f AS', ', g AS (SELECT turn_id, r.* FROM e), f AS')} SELECT turn_id, phase, label, reaction, line_no, label = 'retracted' AS removed FROM g")
def stream_effective(spark, d):
    """Each turn's standing reaction after a stream of reactions in several batches: live lines first, corrections in a later run."""
    at = new_folder(spark, "effective")
    rows = _reactions(spark, d).select("turn_id", "phase", "label", "reaction", "line_no")
    for phase in ("live", "retro"):
        rows.where(F.col("phase") == phase).repartition(4).write.mode("append").json(f"{at}/log")
        log = ledgers.read_log(spark, f"{at}/log", ledgers.REACTIONS, per_trigger=2)
        ledgers.run_to_end(ledgers.into_table(ledgers.effective_updates(log), f"{at}/table", f"{at}/mark", "update"), spark)
    return ledgers.latest(spark, f"{at}/table", "turn_id")
