"""Exact scoped vector retrieval, reserved and balanced top-k, recall, and hard-negative mining.

``vectors``: id, family, scope, source, doc, embedding (array<float>).  Sums are
taken in double.  Every ranking ends in a unique key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import dims
from quern.operators import pivots

#: Queries (rows) up to which a query table is broadcast to the scan; beyond, scopes are joined by shuffle.
BROADCAST_QUERIES = 10_000
OVER_FETCH = (3, 15, 30)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a, b, norm_a=None, norm_b=None) -> Column:
    """Cosine similarity; 0 where a vector has no length or the dimensions differ."""
    na, nb = norm(a) if norm_a is None else _c(norm_a), norm(b) if norm_b is None else _c(norm_b)
    return F.when((F.size(_c(a)) == F.size(_c(b))) & (na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def tag_cosine(a, b) -> Column:
    """Cosine of two tag sets as multi-hot vectors; 0 where one is empty."""
    a, b = F.array_distinct(_c(a)), F.array_distinct(_c(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.sqrt((F.size(a) * F.size(b)).cast("double"))).otherwise(F.lit(0.0))


def top_k(ranked: DataFrame, by: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per group; the limit is applied before the shuffle too (WindowGroupLimit)."""
    return ranked.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def scored(queries: DataFrame, vectors: DataFrame, digits: int | None = None) -> DataFrame:
    """Every query against every vector of its scopes: (qid, id, family, scope, source, doc, distance).

    ``queries``: qid, scopes (array; null for all), embedding.  A query table
    whose size is checked to be small is broadcast, so that the vectors are
    scanned in place; a larger one is joined scope by scope.
    """
    q = queries.select("qid", "scopes", F.col("embedding").alias("_q"), norm("embedding").alias("_nq"))
    v = vectors.withColumn("_nv", norm("embedding"))
    few = q.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    if few:
        both = v.join(F.broadcast(q), F.col("scopes").isNull() | F.array_contains("scopes", F.col("scope")))
    else:
        all_scopes = F.array(*map(F.lit, dims.SCOPES))
        both = v.join(q.withColumn("scope", F.explode(F.coalesce("scopes", all_scopes))), "scope")
    d = 1 - cosine("_q", "embedding", "_nq", "_nv")
    return both.select("qid", "id", "family", "scope", "source", "doc", (F.round(d, digits) if digits is not None else d).alias("distance"))


def scoped_families(queries: DataFrame, vectors: DataFrame, per_family: int, always=("corpus", "failure_modes"), code_scopes=dims.CODE_SCOPES, digits: int | None = None) -> DataFrame:
    """Per query, the nearest ``per_family`` of each (scope, family) in its scopes; families outside ``always`` only in ``code_scopes``.

    Whole-number ids go by pruned blocks; others, for a few queries, row by row.
    """
    allowed = F.col("family").isin(*always) | F.col("scope").isin(*code_scopes)
    if "string" in (queries.schema["qid"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()):
        return top_k(scored(queries, vectors.where(allowed), digits), ["qid", "scope", "family"], [F.col("distance"), F.col("id")], per_family)
    near = _near(queries, vectors.where(allowed), per_family, digits, "each", None, F.xxhash64("scope", "family")).join(queries.select("qid", "scopes"), "qid")
    near = near.where(F.col("scopes").isNull() | F.array_contains("scopes", F.col("scope"))).drop("scopes")
    return top_k(near, ["qid", "scope", "family"], [F.col("distance"), F.col("id")], per_family)


def nearest(hits: DataFrame, n: int) -> DataFrame:
    """The nearest ``n`` hits of every query, by distance then id; ``n`` <= 0 keeps all."""
    return top_k(hits, ["qid"], [F.col("distance"), F.col("id")], n, "rank") if n > 0 else hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id")))


def _near(queries: DataFrame, vectors: DataFrame, n: int, digits: int | None, mode: str, q_cell=None, v_cell=None, columns=("family", "scope", "source", "doc")) -> DataFrame:
    """(qid, id, ``columns``, distance) of the nearest by :func:`pivots.nearest`: columns are fetched for them alone."""
    none = F.lit(0)
    q = queries.select("qid", (none if q_cell is None else q_cell).alias("cell"), "embedding")
    v = vectors.select("id", (none if v_cell is None else v_cell).alias("cell"), "embedding")
    near = pivots.nearest(q, v, n, digits, mode)
    return near.join(vectors.select("id", *columns), "id").select("qid", "id", *columns, "distance")


def nearest_in_blocks(queries: DataFrame, vectors: DataFrame, n: int, digits: int | None = None) -> DataFrame:
    """``nearest(scored(queries, vectors, digits), n)`` for queries of all scopes, whole-number ids and n > 0, by pruned blocks."""
    return top_k(_near(queries, vectors, n, digits, "all"), ["qid"], [F.col("distance"), F.col("id")], n)


def reserved(queries: DataFrame, vectors: DataFrame, n: int, reserve: int = 2, family: str = "failure_modes", digits: int | None = None) -> DataFrame:
    """:func:`with_reserve` of all vectors' hits, from the nearest ``n`` and the nearest ``reserve`` of the family."""
    hits = nearest_in_blocks(queries, vectors, n, digits).unionByName(nearest_in_blocks(queries, vectors.where(F.col("family") == family), reserve, digits))
    return with_reserve(hits.drop("rank").dropDuplicates(["qid", "id"]), n, reserve, family)


def with_reserve(hits: DataFrame, n: int, reserve: int = 2, family: str = "failure_modes") -> DataFrame:
    """The nearest ``n`` of a query, ``reserve`` of which are kept for the nearest of one family, by distance again at the end."""
    own = F.row_number().over(Window.partitionBy("qid", "family").orderBy("distance", "id"))
    h = hits.withColumn("_kept", (F.col("family") == family) & (own <= reserve))
    h = h.withColumn("_place", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("_kept").desc(), "distance", "id"))).where(F.col("_place") <= n)
    return h.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))).drop("_kept", "_place")


def over_fetch(n: int) -> int:
    """How many hits to take where a filter follows that may turn some away."""
    factor, least, most = OVER_FETCH
    return min(most, max(least, factor * n))


def filtered_after(hits: DataFrame, wanted: Column, n: int) -> DataFrame:
    """The first ``n`` hits of every query that are ``wanted``, among its nearest ``over_fetch(n)``: what the filter turns away isn't made up for."""
    return top_k(nearest(hits, over_fetch(n)).drop("rank").where(wanted), ["qid"], [F.col("distance"), F.col("id")], n)


# Document types that hold rules.
RULE_DOC_TYPES = ("anti_pattern", "pattern", "standard", "decision")


def advice_bucket(family, doc_type, cites) -> Column:
    return (
        F.when((_c(family) == "failure_modes") | (_c(doc_type) == "anti_pattern"), "avoid").when(_c(doc_type) == "pattern", "prefer")
        .when(F.exists(F.coalesce(_c(cites), F.array().cast("array<string>")), lambda x: x.startswith("AP")), "avoid").otherwise("convention")
    )


def balanced(hits: DataFrame, keep: int, noise: tuple[str, ...] = (), doc_types=RULE_DOC_TYPES) -> DataFrame:
    """Advice per query: at most keep/3+1 per bucket, one per source, avoid before prefer before convention, ``keep`` in all.

    ``hits``: qid, id, source, family, doc_type, cites, distance.  Whether a row
    that its full bucket turned away lets its source come again depends on the
    order, so the rows of a query (a bounded retrieval result) pass through one
    SQL fold.
    """
    per = keep // 3 + 1
    wanted = (F.col("family") == "failure_modes") | F.col("doc_type").isin(*doc_types)
    for p in noise:
        wanted = wanted & ~F.col("source").startswith(p)
    h = hits.where(wanted).withColumn("bucket", advice_bucket("family", "doc_type", "cites"))
    rows = F.array_sort(F.collect_list(F.struct("distance", "id", "source", "bucket")))
    kind = "array<struct<distance:double,id:string,source:string,bucket:string>>"
    h = h.select("qid", F.col("distance").cast("double").alias("distance"), F.col("id").cast("string").alias("id"), "source", "bucket")
    folded = F.aggregate(
        F.col("rows"), F.array().cast(kind),
        lambda acc, x: F.when(~F.exists(acc, lambda y: y["source"] == x["source"]) & (F.size(F.filter(acc, lambda y: y["bucket"] == x["bucket"])) < per), F.concat(acc, F.array(x))).otherwise(acc),
    )
    order = F.when(F.col("bucket") == "avoid", 0).when(F.col("bucket") == "prefer", 1).otherwise(2)
    out = h.groupBy("qid").agg(rows.alias("rows")).select("qid", F.inline(folded))
    return top_k(out.withColumn("_o", order), ["qid"], [F.col("_o"), F.col("distance"), F.col("id")], keep).drop("_o")


def hit_ranks(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, scope, hit_at): the rank of the first hit from the expected source, 0 if none."""
    best = ranked.join(queries.select("qid", "expected_source"), "qid").where(F.col("source") == F.col("expected_source")).groupBy("qid").agg(F.min("rank").alias("hit_at"))
    return queries.select("qid").join(best, "qid", "left").select("qid", F.coalesce("hit_at", F.lit(0)).alias("hit_at"))


def recall_at(hits: DataFrame, k: int) -> Column:
    return F.avg(F.when(F.col("hit_at").between(1, k), 1.0).otherwise(0.0))


def economy(hits: DataFrame, files: DataFrame) -> DataFrame:
    """(qid, payload, sources): bytes of a query's hits (qid, source, body) against those of the distinct ``files`` (path, size) behind them.

    Sources named with an ``@`` are commits, not files, and count on neither file side.
    """
    h = hits.groupBy("qid", "source").agg(F.sum(F.octet_length("body")).alias("bytes"))
    f = files.where(~F.col("path").contains("@")).select(F.col("path").alias("source"), "size")
    return h.join(f, "source", "left").groupBy("qid").agg(F.sum("bytes").cast("long").alias("payload"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("sources"))


def relative_gate(baseline, candidate, least: float = 0.10) -> tuple[Column, Column]:
    """(relative improvement, pass); from nothing to something passes, from nothing to nothing fails."""
    b, c = _c(baseline), _c(candidate)
    rel = F.when((b == 0) & (c == 0), 0.0).when(b == 0, 1.7976931348623157e308).otherwise((c - b) / b)
    return rel, F.when((b == 0) & (c == 0), False).when(b == 0, True).otherwise(rel >= least)


# ---------------------------------------------------------------- hard negatives


def sentence_tags(concerns, language, form) -> Column:
    """Tags of a sentence, told apart by axis; empty values give none."""
    some = lambda p, c: F.when(F.coalesce(_c(c), F.lit("")) != "", F.concat(F.lit(p), _c(c)))
    return F.array_distinct(F.array_compact(F.concat(F.transform(F.coalesce(_c(concerns), F.array().cast("array<string>")), lambda x: F.concat(F.lit("c:"), x)), F.array(some("l:", language), some("f:", form)))))


def tag_negatives(sentences: DataFrame) -> DataFrame:
    """(anchor_id, negative_id, scope, anchor_role, negative_role, relaxed): the most similar sentence of another role.

    ``sentences``: pos (unique), id, scope, semantic_role, tags.  First among the
    same scope (a null or empty scope has none), else among all.  Ties go to the
    least id.  Rows with equal (scope, role, tags) are one class whose least id
    stands for it, so pairs are between
    classes, not rows: their number follows the tag vocabulary.
    """
    s = sentences.withColumn("_k", F.array_sort("tags"))
    groups = s.groupBy("scope", "semantic_role", "_k").agg(F.min("id").alias("rep"))
    anchors = groups.select(F.col("scope").alias("a_scope"), F.col("semantic_role").alias("a_role"), F.col("_k").alias("a_k"))
    n = groups.select(F.col("scope").alias("n_scope"), F.col("semantic_role").alias("n_role"), F.col("_k").alias("n_k"), "rep")
    differs = ~F.col("a_role").eqNullSafe(F.col("n_role"))
    score = tag_cosine("a_k", "n_k")

    def best(pairs: DataFrame) -> DataFrame:
        return top_k(pairs.withColumn("score", score), ["a_scope", "a_role", "a_k"], [F.col("score").desc(), F.col("rep")], 1, "_r").drop("_r")

    scoped = best(anchors.join(n, (F.col("a_scope") == F.col("n_scope")) & (F.col("a_scope") != "") & differs)).withColumn("relaxed", F.lit(False))
    keys = ["a_scope", "a_role", "a_k"]
    same = lambda left, right: F.struct(*left).eqNullSafe(F.struct(*right))
    rest = anchors.alias("l").join(scoped.alias("r"), same([f"l.{k}" for k in keys], [f"r.{k}" for k in keys]), "left_anti")
    # Without a scope: classes that share a tag meet by it; where none of another role does, all score 0 and the
    # least id of another role wins, which is that of one of the two roles with the least ids.
    wide = n.groupBy("n_role", "n_k").agg(F.min("rep").alias("rep"))
    tagged = rest.withColumn("tag", F.explode("a_k")).join(wide.withColumn("tag", F.explode("n_k")), "tag").where(differs).drop("tag").distinct()
    by_tag = best(tagged)
    first = F.row_number().over(Window.orderBy("rep"))
    roles = wide.groupBy("n_role").agg(F.min("rep").alias("rep")).withColumn("_r", first).where("_r <= 2").drop("_r")  # one row a role
    alone = rest.alias("l").join(by_tag.alias("r"), same([f"l.{k}" for k in keys], [f"r.{k}" for k in keys]), "left_anti")
    alone = best(alone.join(F.broadcast(roles), differs).withColumn("n_k", F.array().cast("array<string>")))  # two rows
    loose = by_tag.select(*keys, "rep", "n_role").unionByName(alone.select(*keys, "rep", "n_role")).withColumn("relaxed", F.lit(True))
    found = scoped.select(*keys, "rep", "n_role", "relaxed").unionByName(loose.select(*keys, "rep", "n_role", "relaxed"))
    on = F.col("s.scope").eqNullSafe(F.col("f.a_scope")) & F.col("s.semantic_role").eqNullSafe(F.col("f.a_role")) & (F.col("s._k") == F.col("f.a_k"))
    return s.alias("s").join(found.alias("f"), on).select(F.col("s.id").alias("anchor_id"), F.col("rep").alias("negative_id"), F.col("s.scope").alias("scope"), F.col("s.semantic_role").alias("anchor_role"), F.col("n_role").alias("negative_role"), "relaxed")


def dense_negatives(vectors: DataFrame, queries: DataFrame, digits: int = 6) -> DataFrame:
    """Per query (qid, label, embedding): the most similar vector (id, label, embedding) of another label, ties to the least id.  Labels may not be null."""
    near = _near(queries, vectors, 1, digits, "unlike", F.xxhash64("label"), F.xxhash64("label"), ("label",))
    near = top_k(near, ["qid"], [F.col("distance"), F.col("id")], 1, "_r").withColumnRenamed("label", "n_label").join(queries.select("qid", F.col("label").alias("q_label")), "qid")
    return near.select("qid", "q_label", F.col("id").alias("negative_id"), "n_label", F.round(1 - F.col("distance"), digits).alias("score"))


def mining_summary(triples: DataFrame, anchors: DataFrame | None = None, shown: int = 10) -> DataFrame:
    """(axis, value, n): triples by scope and by role, how many are relaxed; with ``anchors`` also how many of them have none,
    and, as axis ``relaxed_id``, the first ``shown`` relaxed anchor ids to look at."""
    by = lambda axis, c: triples.groupBy(F.col(c).alias("value")).count().select(F.lit(axis).alias("axis"), F.coalesce("value", F.lit("")).alias("value"), F.col("count").alias("n"))
    total = triples.agg(F.count_if("relaxed").alias("n")).select(F.lit("relaxed").alias("axis"), F.lit("").alias("value"), "n")
    out = by("scope", "scope").unionByName(by("role", "anchor_role")).unionByName(total)
    if anchors is None:
        return out
    dropped = anchors.join(triples.select(F.col("anchor_id").alias("id")), "id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("dropped").alias("axis"), F.lit("").alias("value"), "n")
    ids = triples.where("relaxed").select(F.lit("relaxed_id").alias("axis"), F.col("anchor_id").cast("string").alias("value"), F.lit(1).cast("long").alias("n")).orderBy("value").limit(shown)
    return out.unionByName(dropped).unionByName(ids)
