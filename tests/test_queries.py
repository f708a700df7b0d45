"""Every query of the engine against its SQL in DuckDB, and the driver's entry."""

import duckdb
import pytest

import __spark_entry__ as driver
from pricewright.plans import workload

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple((False, "") if v is None or v != v else (True, str(v)) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(workload.queries()))
def test_query_agrees_with_sql(spark, data, database, name):
    got, want = workload.queries()[name](spark, data).toPandas(), database.execute(workload.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_whole_tables_reach_the_vendors_products(spark, data, database):
    found = workload.queries()
    assert not any("_partkey % 4 = 1" in q or "_partkey % 5 = 0" in q for q in workload.oracle_sql().values())
    prices = found["aws_products"](spark, data).agg({"n_prices": "sum"}).first()[0]
    assert prices == database.execute("SELECT count(*) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE NOT (l_returnflag = 'R' AND l_linestatus = 'O')").fetchone()[0]


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
