"""Content-addressed identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\0"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def chunk_id(source, anchor, body) -> Column:
    nul = F.lit(b"\x00")
    return F.sha1(F.concat(F.encode(_col(source), "UTF-8"), nul, F.encode(_col(anchor), "UTF-8"), nul, F.encode(_col(body), "UTF-8")))


def symbol_id(source, line, text) -> Column:
    return F.concat(F.lit("SYM-"), F.substring(F.sha1(F.concat_ws(":", _col(source), _col(line).cast("string"), _col(text))), 1, 12))


def history_id(prefix: str, key) -> Column:
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(_col(key), 256), 1, 24))


def failure_mode_id(entry_id) -> Column:
    return F.substring(F.sha1(F.concat(F.lit("fm:"), _col(entry_id))), 1, 24)


def item_id(kind, item) -> Column:
    return F.concat_ws("-", _col(kind), _col(item))


def turn_id(stamp, seed) -> Column:
    nul = F.lit(b"\x00")
    return F.concat(_col(stamp), F.lit("-"), F.substring(F.sha1(F.concat(F.encode(_col(stamp), "UTF-8"), nul, F.encode(_col(seed), "UTF-8"))), 1, 6))


def cache_key(*fields) -> Column:
    """SHA-256 over length-prefixed fields, so that no two field lists collide."""
    parts = []
    for f in fields:
        parts += [F.octet_length(_col(f)).cast("string"), F.lit(":"), _col(f)]
    return F.sha2(F.concat(*parts), 256)


def source_sha(git_sha, content) -> Column:
    return F.coalesce(_col(git_sha), F.sha1(_col(content)))


def digest_name(path, content) -> Column:
    return F.concat(F.substring(F.sha2(_col(path), 256), 1, 16), F.lit("-"), F.substring(F.sha2(_col(content), 256), 1, 12), F.lit(".md"))
