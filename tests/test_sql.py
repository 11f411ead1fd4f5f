"""Queries of the catalogue, its hand-over and single rules equal their SQL, row by row."""

import duckdb
import pytest

from quillgate.plans import details, handover

TABLES = ["documents", "pages", "conversations", "labels"]
QUERIES, SQL = handover.QUERIES | details.QUERIES, handover.ORACLE_SQL | details.ORACLE_SQL


@pytest.fixture(scope="module")
def views(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows_equal_the_sql(spark, sf, views, name):
    cur = views.execute(SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(map(_plain, r)) for r in cur.fetchall())
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(map(_plain, r)) for r in df.select(*names).collect()) == want
