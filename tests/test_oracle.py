"""Every registered query against its DuckDB statement on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as ent
from evalcube.sources.tables import TABLES, table_path
from tools.oracle_check import compare

QUERIES = ent.queries()
SQL = ent.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return c


def test_every_query_has_a_callable():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    res = con.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    assert compare(rows, df.columns, res.fetchall(), dcols) == "ok"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only_query_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.count() >= 0


def test_entry_schema_is_stable(spark):
    a = ent.entry(spark)
    b = ent.entry(spark)
    assert a.schema == b.schema
    assert a.count() >= 0
