"""Every query with SQL against DuckDB on the smallest tables; the others run."""

import math

import pytest

from corpusloom.plans import all_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = all_queries()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    from conftest import SMALL

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 5) if math.isfinite(v) else v)
    return repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    rows = df.collect()
    if name not in SQL:
        return
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(norm(r[n]) for n in names) for r in rows) == sorted(tuple(map(norm, r)) for r in cur.fetchall())


def test_plans(spark, small):
    def plan(name):
        return QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()

    assert "TakeOrderedAndProject" in plan("vec_topk")
    assert "WindowGroupLimit" in plan("vec_best_per_label") and "WindowGroupLimit" in plan("last_n_messages")
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan("pricing_summary")
