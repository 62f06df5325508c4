"""Queries cover all their input, not a fixed part of it."""

from pyspark.sql import functions as F

from quern import queries
from quern.operators import vectors
from tests.conftest import DATA

MANY = "/root/testdata/sf0.1"


def test_bucket_balanced_topk_takes_every_20th_vector(spark):
    want = {r[0] for r in queries.table(spark, DATA, "embeddings").where("vec_id % 20 = 0").select("vec_id").collect()}
    got = {r[0] for r in queries.queries()["bucket_balanced_topk"](spark, DATA).select("qid").distinct().collect()}
    assert len(want) > 20 and got == want


def test_blocks_equal_the_pairwise_search(spark):
    v = queries._vectors(spark, DATA)
    odd = [(9000, [1.0, 2.0]), (9001, None), (9002, []), (9003, [0.0] * 64)]
    v = v.unionByName(spark.createDataFrame(odd, "id long, embedding array<float>").selectExpr("id", "'code' family", "'backend' scope", "'x' source", "'' doc", "embedding"))
    v = v.unionByName(v.where("id < 40").withColumn("id", F.col("id") + 5000))
    q = v.where("id % 20 = 0 OR id >= 9000").select(F.col("id").alias("qid"), F.lit(None).cast("array<string>").alias("scopes"), "embedding")
    cols = ["qid", "id", "family", "scope", "source", "doc", "distance", "rank"]
    want = vectors.nearest(vectors.scored(q, v, 6), 120).select(*cols).collect()
    got = vectors.nearest_in_blocks(q, v, 120, 6).select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_demotion_dispositions_has_a_turn_per_user(spark):
    """Here users outnumber the 200 turns that the SQL of the other ledger queries folds them to."""
    events = queries.table(spark, MANY, "events")
    want = {f"t{r[0]}" for r in events.where("user_id % 9 != 0").select("user_id").distinct().collect()} | {"none"}
    got = queries.queries()["demotion_dispositions"](spark, MANY)
    assert len(want) > 201 and {r[0] for r in got.select("turn_id").distinct().collect()} == want and got.count() == events.count()


def test_every_customer_is_a_turn(spark):
    assert queries._turns(spark, MANY).count() == queries.table(spark, MANY, "customer").count() > 200
