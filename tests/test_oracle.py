"""Every registered query against its DuckDB oracle on the smallest tables
(the driver runs the same comparison at sf0.01)."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001
from quarry.plans import catalog, oracle
from quarry.session import TABLES

QUERIES = catalog.QUERIES  # the corpus queries have their own tests
SQL = oracle.oracle_sql()


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else f"{round(v, 6):.6f}"
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    yield c
    c.close()


def test_every_query_has_oracle_or_is_rows_only():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF001).toPandas()
    exp = con.execute(SQL[name]).df()
    assert _rows(got) == _rows(exp)


def test_entry(spark):
    rows = E.entry(spark).collect()
    assert sum(r.n_pairs for r in rows) > 0
