"""Every query with SQL gives the SQL's rows on the smallest tables; every query runs."""

import duckdb
import pytest

from quern.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, db, tmp_path, name):
    df = queries.queries()[name](spark, DATA)
    df.write.parquet(str(tmp_path / "out"))
    rows = f"'{tmp_path}/out/*.parquet'"
    if name != "op11_prefix_trie":  # has a row per node
        want = "conversations" if name.startswith("op7") or name == "quoted_conversations" else "pages" if name.startswith("op1_") else "documents"
        assert db.execute(f"SELECT (SELECT count(*) FROM {rows}) = (SELECT count(*) FROM {want})").fetchall()[0][0]
    if name in queries.oracle_sql():
        cols = ", ".join(sorted(df.columns))
        sql = f"SELECT {cols} FROM ({queries.oracle_sql()[name]})"
        both = db.execute(f"SELECT (SELECT count(*) FROM ({sql} EXCEPT ALL SELECT {cols} FROM {rows})), (SELECT count(*) FROM (SELECT {cols} FROM {rows} EXCEPT ALL {sql}))").fetchall()[0]
        assert both == (0, 0)
