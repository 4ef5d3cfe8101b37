import duckdb
import pytest

from maskwright.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "customer supplier part orders lineitem documents pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    flat = lambda x: round(float(x), 6) if isinstance(x, float) else x
    return sorted((tuple(flat(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    other = duck.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(other.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(other.columns, other.fetchall())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.SQL.keys()))
def test_query_without_sql_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
