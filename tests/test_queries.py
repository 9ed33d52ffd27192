"""Every query with SQL is compared with DuckDB's answer on the same tables; the others must run."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def own_queries():
    from lodestone.plans import queries

    return queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame):
    text = lambda x: str(list(x)) if hasattr(x, "__len__") and not isinstance(x, str) else "None" if x is None or x != x else str(x)
    return sorted(tuple(map(text, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(own_queries()[0]))
def test_query(spark, duck, name):
    made, sql = own_queries()
    got = made[name](spark, SF).toPandas()
    if name in sql:
        want = duck.execute(sql[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
