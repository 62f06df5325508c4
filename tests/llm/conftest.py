import pytest

CLASH = ("row", "t", "w", "h", "p", "u", "v", "fp", "size", "target", "root", "key", "line", "lines_removed", "_id", "_keep", "_bad", "_n", "canon", "block", "listed", "lang_pred", "score", "spans", "seed")


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows, and columns of clashing names."""
    prose = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    line = "this line of forty and more characters is shared by many documents"
    rows = [
        (1, prose, "en", "a", 9), (2, None, "en", "a", None), (3, "", None, "b", 0), (4, " \n\t ", "fr", None, 4), (None, prose + " x", "en", "a", 1), (5, prose, "en", "a", 9), (5, prose, "en", "a", 9),
        (6, " ".join(f"w{i % 997}" for i in range(30_000)), "de", "b", 1), (7, "a" * 100_000, "de", "b", 1), (8, line + "\n" + prose[::-1], "en", "c", 1), (9, line + "\nother words here", "en", "c", 1), (10, "\n" * 50, "en", "c", 50), (11, "é 日本語 \U0001f600 ünï", "ja", "c", 3),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASH:
        df = df.withColumn(c, df["source"])
    return df


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.where("false")


@pytest.fixture(params=["broadcast", "shuffle"])
def way(request, spark):
    """Both ways of a join; for the way beyond an operator's limits, Spark's own broadcast is off too."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if request.param == "shuffle":
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield request.param
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
