"""Every query with SQL gives the SQL's rows on the smallest tables; the others give rows."""

import duckdb
import pytest

from quern import queries
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, db, tmp_path, name):
    df = queries.queries()[name](spark, DATA)
    df.write.parquet(str(tmp_path / "out"))
    rows = f"'{tmp_path}/out/*.parquet'"
    if name not in queries.oracle_sql():
        assert db.execute(f"SELECT count(*) FROM {rows}").fetchall()[0][0] > 0
        return
    cols = ", ".join(f'"{c}"' for c in sorted(df.columns))
    sql = f"SELECT {cols} FROM ({queries.oracle_sql()[name]})"
    both = db.execute(f"SELECT (SELECT count(*) FROM ({sql} EXCEPT ALL SELECT {cols} FROM {rows})), (SELECT count(*) FROM (SELECT {cols} FROM {rows} EXCEPT ALL {sql}))").fetchall()[0]
    assert both == (0, 0)
