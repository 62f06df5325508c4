"""The jobs as queries: each runs twice into one new folder, and the result is what stands there then."""

from __future__ import annotations

from pyspark.sql import DataFrame

from jobs import chunk_sync, training_pairs
from jobs.settings import read_config
from quern.queries import FORM, LINES, MODAL, SENTENCES
from quern.shared import new_folder


def job1_chunk_sync(spark, sf_dir: str) -> DataFrame:
    config = read_config("chunk_sync") | {"documents": f"{sf_dir}/documents.parquet", "output": new_folder(spark, "chunk-sync")}
    chunk_sync.run(spark, **config)
    chunk_sync.run(spark, **config)
    return chunk_sync.chunks(spark, config["output"])


def job2_training_pairs(spark, sf_dir: str) -> DataFrame:
    config = read_config("training_pairs") | {"documents": f"{sf_dir}/documents.parquet", "output": new_folder(spark, "training-pairs")}
    training_pairs.run(spark, **config)
    training_pairs.run(spark, **config)
    return training_pairs.written(spark, config["output"])


JOB1_SQL = f"""
WITH d AS (SELECT 'docs/' || doc_id || '.txt' AS source, coalesce(nullif(lang, ''), 'universal') AS scope, {LINES} AS ls, row_number() OVER (PARTITION BY doc_id ORDER BY sha1(coalesce(text, '')) DESC, lang DESC) AS nth FROM documents WHERE doc_id IS NOT NULL AND strlen(text) > 0),
k AS (SELECT source, scope, ls, len(ls) AS n, unnest(range(0, greatest(0, ceil((len(ls) - 80) / 60.0))::INT + 1)) AS k FROM d WHERE nth = 1),
w AS (SELECT source, scope, (k * 60 + 1)::INT AS start, least(k * 60 + 80, n)::INT AS "end", array_to_string(ls[(k * 60 + 1):least(k * 60 + 80, n)], chr(10)) AS part FROM k),
a AS (SELECT *, source || '#L' || start || '-L' || "end" AS anchor FROM w),
b AS (SELECT *, '[code/text] ' || anchor || chr(10) || part || chr(10) AS body FROM a)
SELECT source, scope, start, "end", anchor, body, sha1(source || chr(0) || anchor || chr(0) || body) AS chunk_id, (('0x' || substr(md5(source), 1, 8))::BIGINT % 64)::INT AS bucket FROM b
"""

_BANNED = "(?im)^[^\\n]*(?:licen[sc]ed under|apache license|public license)[^\\n]*\\n?"
#: The library's sentences with their place in the paragraph.
_PLACED = SENTENCES.replace("AS s FROM t)", "AS s, generate_subscripts(string_split_regex(regexp_replace(t, '([.!?])[\\t\\n\\f\\r ]+', '\\1' || chr(1), 'g'), chr(1)), 1) - 1 AS pos FROM t)").replace("s AS (SELECT doc_id, line::INT AS line,", "s AS (SELECT doc_id, line::INT AS line, pos::INT AS pos,").replace("FROM documents", "FROM clean")
_OF = lambda axis: axis.replace("text", "p.text")
JOB2_SQL = f"""
WITH clean AS (SELECT doc_id, lang, regexp_replace(text, '{_BANNED}', '', 'g') AS text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
{_PLACED},
nx AS (SELECT doc_id, line, pos, text, lead(text) OVER (PARTITION BY doc_id ORDER BY line, pos) AS positive FROM s),
pr AS (SELECT * FROM nx WHERE positive IS NOT NULL AND positive <> text QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id, line, pos) = 1)
SELECT 'PAIR-' || substr(sha1(p.text || chr(0) || positive), 1, 12) AS id, doc_id, line, pos, p.text AS anchor, positive, {_OF(FORM)} AS form, {_OF(MODAL)} AS modality,
  CASE WHEN ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 100 < 10 THEN 'eval' ELSE 'train' END AS split, coalesce(nullif(lang, ''), 'und') AS lang
FROM pr p JOIN clean USING (doc_id)
"""


def queries() -> dict:
    return {"job1_chunk_sync": job1_chunk_sync, "job2_training_pairs": job2_training_pairs}


def oracle_sql() -> dict[str, str]:
    return {"job1_chunk_sync": JOB1_SQL, "job2_training_pairs": JOB2_SQL}
