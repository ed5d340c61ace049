"""Every registered core query against its SQL on the smallest data set."""

import os

import duckdb
import pytest

from foliolake import plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted((tuple(map(plain, r)) for r in pdf.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return c


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, data, duck, name):
    got, want = QUERIES[name](spark, data).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["qid", "sec_idx", "score", "rank"]
    assert set(plans.queries()) <= set(entry.queries())
