"""Cases of the findings of round 3."""

import duckdb
import pytest

from foliolake import plans


def folder(tmp_path, **tables):
    """A data folder of small tables, each by SQL."""
    c = duckdb.connect()
    for name, sql in tables.items():
        c.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT PARQUET)")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    return str(tmp_path), c


def same(spark, name, data, c):
    """The query's rows, which are those of its SQL."""
    got, want = plans.queries()[name](spark, data).toPandas(), c.sql(plans.oracle_sql()[name]).df()
    rows = lambda pdf: sorted(map(repr, pdf[sorted(pdf.columns)].astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
    return got


def test_references_without_semicolon(spark, tmp_path):
    page = "'<html><head><title>a &lt;b&gt; &amp;&amp</title></head><body><h1>a &lt;b&gt; &amp;&amp</h1><p>x</p></body></html>'"
    data, c = folder(tmp_path, pages=f"SELECT CAST(1 AS BIGINT) AS page_id, 'u' AS url, {page} AS html")
    assert list(same(spark, "heading_outline", data, c)["title"]) == ["a <b> &&amp"]


TWICE = f"SELECT CAST(i // 2 AS BIGINT) AS l_orderkey, CAST(7 AS BIGINT) AS l_partkey, CAST(3 AS INTEGER) AS l_linenumber, CAST(CASE WHEN i % 2 = 0 THEN 30 ELSE 47 END AS DOUBLE) AS l_quantity, CAST(100 + i AS DOUBLE) AS l_extendedprice, 'A' AS l_returnflag, 'F' AS l_linestatus FROM range(40) t(i) ORDER BY i"


def test_layout_items_of_one_place(spark, tmp_path):
    data, c = folder(tmp_path, lineitem=TWICE)
    c.execute("SET threads = 1")  # its SQL leaves the order of such items open, and one thread keeps that of the table
    assert set(same(spark, "layout_sections", data, c)["level"]) == {3}


def test_rows_of_one_order_line(spark, tmp_path):
    data, c = folder(tmp_path, lineitem=TWICE)
    assert list(same(spark, "table_aggregate_where", data, c)["n_rows"]) == [20]


def test_one_search_builds_no_index(spark, data, monkeypatch):
    from foliolake.operators import index

    def write(*_):
        raise AssertionError("an index of all postings for one search")

    monkeypatch.setattr(index, "write", write)
    monkeypatch.setattr(index, "is_stored", lambda *_: False)
    for name in ("jaccard_search", "rrf_fusion"):
        assert plans.queries()[name](spark, data).count() > 0


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_score_takes_texts_apart_once(spark):
    from pyspark.sql import functions as F

    from foliolake.operators import judge

    assert str(judge.score(F.col("a"), F.col("b"))).count("[0-9][0-9.]*)") <= 10


def test_keywords_of_a_library_search_once(spark, data):
    from foliolake.operators import library

    lib = spark.createDataFrame([("a", "A b", "o", "d", "", "x y")], "doc_id string, title string, owner string, department string, summary string, t string").selectExpr("*", "array('t') AS tags", "transform(split(t, ' '), w -> md5(w)) AS keywords")
    assert plan_of(library.search(lib, "b")).count("md5(") == 1
    assert library.search(lib, "b").count() == 1 and library.search(lib, "z").count() == 0


def test_pages_in_small_batches(spark, data):
    assert "MapInArrow" in plan_of(plans.queries()["html_sections"](spark, data))
