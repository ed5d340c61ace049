"""Table queries, outlines and graphs over the relational tables, whose columns are turned into string cells first."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parsed_number, unit
from ..operators import graph, judge, outline, tables
from .common import table

_KEY = ("doc_id", "section_id", "table_id")


def lineitem_cells(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as tables by return flag and line status, with dollar signs, separators and blanks in the cells.

    A row is told by its place: order, line and part occur more than once.
    """
    rows = table(spark, d, "lineitem").withColumn("row_idx", F.monotonically_increasing_id())
    price = F.when(F.col("l_linenumber") == 7, "N/A").otherwise(F.concat(F.lit("$"), F.round(F.col("l_extendedprice")).cast("long").cast("string")))
    columns = F.array(F.struct(F.lit(0).alias("col_idx"), F.lit("Quantity").alias("header"), F.col("l_quantity").cast("int").cast("string").alias("cell")), F.struct(F.lit(1).alias("col_idx"), F.lit("Extended Price (USD)").alias("header"), price.alias("cell")))
    return rows.select(F.lit("lineitem").alias("doc_id"), F.col("l_returnflag").alias("section_id"), F.col("l_linestatus").alias("table_id"), "row_idx", F.inline(columns))


def customer_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer")
    columns = F.array(
        F.struct(F.lit(0).alias("col_idx"), F.lit("Name").alias("header"), F.col("c_name").alias("cell")),
        F.struct(F.lit(1).alias("col_idx"), F.lit("Market Segment").alias("header"), F.col("c_mktsegment").alias("cell")),
        F.struct(F.lit(2).alias("col_idx"), F.lit("Balance").alias("header"), F.concat(F.round("c_acctbal").cast("long").cast("string"), F.lit(" USD")).alias("cell")),
    )
    return rows.select(F.lit("customer").alias("doc_id"), F.col("c_nationkey").cast("string").alias("section_id"), F.lit("t").alias("table_id"), F.col("c_custkey").alias("row_idx"), F.inline(columns))


def table_aggregate(op: str, spark: SparkSession, d: str) -> DataFrame:
    out = tables.aggregate(lineitem_cells(spark, d), op, "extended price")
    return out.select("section_id", "table_id", "ok", F.round("value", 3).alias("value"), "unit", "n_rows", "skipped")


def table_aggregate_where(spark, d):
    out = tables.aggregate(lineitem_cells(spark, d), "sum", "price", ("quantity", "gt", 30))
    return out.select("section_id", "table_id", "ok", "value", "n_rows")


def table_aggregate_unknown(spark, d):
    """Fails closed: no such column."""
    return tables.aggregate(lineitem_cells(spark, d), "sum", "margin").select("section_id", "table_id", "ok", "value", "n_rows", "reason")


def table_filter(op: str, column: str, value, spark, d):
    return tables.filter_rows(customer_cells(spark, d), column, op, value).select("section_id", "row_idx")


def parse_number_cells(spark, d):
    k = F.col("p_partkey") % 7
    size, price = F.col("p_size").cast("string"), F.round("p_retailprice").cast("long")
    cell = F.when(k == 0, F.concat(F.lit("$ 1,"), F.lpad(size, 3, "0"))).when(k == 1, F.concat(size, F.lit(".5k"))).when(k == 2, F.concat(size, F.lit(" Million"))).when(k == 3, "n/a").when(k == 4, F.concat(F.lit("-"), size, F.lit("%"))).when(k == 5, F.concat(F.lit("12 "), F.lpad(size, 3, "0"))).otherwise(F.concat(price.cast("string"), F.lit("x")))
    return table(spark, d, "part").select("p_partkey", parsed_number(cell).alias("number"), unit(cell).alias("unit"))


_NAMES = [("revenue", "net revenue usd"), ("Annual Total", "annual total"), ("ARR (USD thousands)", "ARR"), ("Region", "regions served"), ("Owner", "EBITDA"), ("Deals Closed", "closed deals count")]


def fuzzy_column_resolve(spark, d):
    """Scores of headers against asked names; the table is a literal one."""
    return spark.createDataFrame(_NAMES, "header string, name string").select("header", "name", F.round(tables.header_score(F.col("header"), F.col("name")), 4).alias("score"))


def nation_outline(spark, d) -> DataFrame:
    """A document per nation: the nation, its market segments (two levels deeper, so a level is skipped), their customers."""
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # a nation table has a fixed size
    seg = F.ascii(F.substring("c_mktsegment", 1, 1)).cast("long") * 10_000_000_000
    one = c.select(F.col("n_name").alias("doc_id"), F.lit(0).cast("long").alias("sec_idx"), F.col("n_name").alias("title"), F.lit(1).alias("level")).distinct()
    two = c.select(F.col("n_name").alias("doc_id"), seg.alias("sec_idx"), F.col("c_mktsegment").alias("title"), F.lit(3).alias("level")).distinct()
    three = c.select(F.col("n_name").alias("doc_id"), (seg + F.col("c_custkey") + 1).alias("sec_idx"), F.col("c_name").alias("title"), F.lit(4).alias("level"))
    return one.unionByName(two).unionByName(three)


def section_ids(spark, d):
    return outline.number(nation_outline(spark, d)).select("doc_id", "title", "id", "parent_id", F.col("depth").cast("long").alias("depth"))


def section_children(spark, d):
    c = outline.children(outline.number(nation_outline(spark, d)))
    return c.select("doc_id", "id", F.size("children").cast("long").alias("n_children"), F.coalesce(F.try_element_at("children", F.lit(-1)), F.lit("")).alias("last_child"))


def world_edges(spark, d) -> DataFrame:
    """Edges of one document: regions and below them their nations."""
    r = table(spark, d, "region").select((F.col("r_regionkey") * 100).alias("sec_idx"), F.lit(1).alias("level"))
    n = table(spark, d, "nation").select((F.col("n_regionkey") * 100 + F.col("n_nationkey") + 1).alias("sec_idx"), F.lit(2).alias("level"))
    return graph.edges(outline.number(r.unionByName(n).withColumn("doc_id", F.lit("world"))))


def graph_edges(spark, d):
    return world_edges(spark, d).select("from_idx", "to_idx", "edge_type", "weight")


def edge_type_counts(spark, d):
    return graph.edge_counts(world_edges(spark, d)).select("edge_type", "n_edges")


def table_render_budget(spark, d):
    rows = table(spark, d, "nation").select(F.lit("world").alias("doc_id"), F.lit("s").alias("section_id"), F.col("n_regionkey").cast("string").alias("table_id"), F.array(F.lit("Key"), F.lit("Nation")).alias("headers"), F.col("n_nationkey").alias("row_idx"), F.array(F.col("n_nationkey").cast("string"), "n_name").alias("row"))
    return tables.render(rows, 50).select("table_id", "text")


def score_report(spark, d):
    """Mean, pass rate and totals of results; events stand for scored questions."""
    e = table(spark, d, "events").select("event_type", F.pmod("event_id", F.lit(11)).alias("score"), (F.col("event_id") % 300).alias("tokens"), (F.col("user_id") % 50).alias("ms"))
    return judge.report(e, ["event_type"]).select("event_type", "n_questions", F.round("avg_score", 6).alias("avg_score"), F.round("pass_rate", 6).alias("pass_rate"), "tokens", F.round("avg_ms", 6).alias("avg_ms"))


def local_judge(spark, d):
    """Each reply judged against the turn that follows it in the conversation, whole texts."""
    c = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.max("text").alias("text"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", judge.score(F.col("text"), F.col("reference")).cast("long").alias("score"))


def quick_totals(spark, d):
    """Questions that ask for an aggregate, answered from the table whose header they name; a question about one segment is not."""
    q = spark.createDataFrame([("t1", "what is the average balance"), ("t2", "what is the highest balance"), ("t3", "total balance of building customers"), ("t4", "who is the owner")], "qid string, question string")
    long = customer_cells(spark, d)
    asked = long.select("doc_id", "section_id").distinct().crossJoin(F.broadcast(q))  # there are four questions
    out = tables.answer_by_table(asked.withColumn("qid", F.concat_ws("-", "qid", "section_id")), long)
    return out.select("qid", "op", "header", F.round("value", 4).alias("value"), "n_rows")


_AGG = "SELECT l_returnflag AS section_id, l_linestatus AS table_id, true AS ok, round(CAST({fold} AS DOUBLE), 3) AS value, '$' AS unit, {n} AS n_rows, {skip} AS skipped FROM (SELECT *, CASE WHEN l_linenumber <> 7 THEN round(l_extendedprice) END AS x FROM lineitem) GROUP BY 1, 2"
_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
SQL = {f"table_aggregate_{op}": _AGG.format(fold="count(*)" if op == "count" else f"{op}(x)", n="count(*)" if op == "count" else "count(x)", skip="CAST(0 AS BIGINT)" if op == "count" else "count(*) - count(x)") for op in tables.OPS}
SQL |= {
    "table_aggregate_where": "SELECT l_returnflag AS section_id, l_linestatus AS table_id, count(CASE WHEN l_linenumber <> 7 AND CAST(l_quantity AS INT) > 30 THEN 1 END) > 0 AS ok, CAST(sum(CASE WHEN l_linenumber <> 7 AND CAST(l_quantity AS INT) > 30 THEN round(l_extendedprice) END) AS DOUBLE) AS value, count(CASE WHEN l_linenumber <> 7 AND CAST(l_quantity AS INT) > 30 THEN 1 END) AS n_rows FROM lineitem GROUP BY 1, 2",
    "table_aggregate_unknown": "SELECT DISTINCT l_returnflag AS section_id, l_linestatus AS table_id, false AS ok, CAST(NULL AS DOUBLE) AS value, CAST(0 AS BIGINT) AS n_rows, 'no column for margin' AS reason FROM lineitem",
    "table_filter_eq": "SELECT CAST(c_nationkey AS VARCHAR) AS section_id, c_custkey AS row_idx FROM customer WHERE lower(c_mktsegment) = 'building'",
    "table_filter_contains": "SELECT CAST(c_nationkey AS VARCHAR) AS section_id, c_custkey AS row_idx FROM customer WHERE contains(lower(c_mktsegment), 'mach')",
    "table_filter_gt": "SELECT CAST(c_nationkey AS VARCHAR) AS section_id, c_custkey AS row_idx FROM customer WHERE round(c_acctbal) > 5000",
    "table_filter_lt": "SELECT CAST(c_nationkey AS VARCHAR) AS section_id, c_custkey AS row_idx FROM customer WHERE round(c_acctbal) < 0",
    "parse_number_cells": """
SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 1000 + p_size WHEN 1 THEN (p_size + 0.5) * 1000 WHEN 2 THEN p_size * 1000000 WHEN 4 THEN -p_size WHEN 5 THEN 12000 + p_size WHEN 6 THEN round(p_retailprice) END::DOUBLE AS number,
       CASE p_partkey % 7 WHEN 0 THEN '$' WHEN 4 THEN '%' WHEN 6 THEN 'x' END AS unit FROM part""",
    "fuzzy_column_resolve": f"""
WITH p(header, name) AS (VALUES {", ".join(f"('{h}', '{n}')" for h, n in _NAMES)}),
n AS (SELECT *, {_NORM.format('header')} AS h, {_NORM.format('name')} AS n FROM p),
s AS (SELECT *, len(list_intersect(list_distinct(string_split(h, ' ')), list_distinct(string_split(n, ' ')))) AS i, len(list_distinct(list_concat(string_split(h, ' '), string_split(n, ' ')))) AS u FROM n)
SELECT header, name, round(CASE WHEN h = n THEN 2.0 WHEN i > 0 AND (contains(h, n) OR contains(n, h)) THEN greatest(i / u, 0.6) WHEN i > 0 THEN i / u WHEN contains(h, n) THEN 0.5 ELSE 0 END, 4)::DOUBLE AS score FROM s""",
}
_OUTLINE = """
WITH c AS (SELECT *, ascii(c_mktsegment) AS a FROM customer JOIN nation ON c_nationkey = n_nationkey),
seg AS (SELECT n_name, c_mktsegment, row_number() OVER (PARTITION BY n_name ORDER BY a) AS s FROM (SELECT DISTINCT n_name, c_mktsegment, a FROM c)),
cust AS (SELECT n_name, c_name, c_custkey, s, row_number() OVER (PARTITION BY n_name, s ORDER BY c_custkey) AS k FROM c JOIN seg USING (n_name, c_mktsegment)),
sec AS (
  SELECT DISTINCT n_name AS doc_id, n_name AS title, '§1' AS id, CAST(NULL AS VARCHAR) AS parent_id, CAST(1 AS BIGINT) AS depth, 0 AS o FROM c
  UNION ALL SELECT n_name, c_mktsegment, '§1.' || s, '§1', 2, s FROM seg
  UNION ALL SELECT n_name, c_name, '§1.' || s || '.' || k, '§1.' || s, 3, k FROM cust
)"""
SQL |= {
    "section_ids": f"{_OUTLINE} SELECT doc_id, title, id, parent_id, depth FROM sec",
    "section_children": f"{_OUTLINE} SELECT p.doc_id, p.id, count(c.id) AS n_children, coalesce(max_by(c.id, c.o), '') AS last_child FROM sec p LEFT JOIN sec c ON c.doc_id = p.doc_id AND c.parent_id = p.id GROUP BY p.doc_id, p.id",
    "graph_edges": """
WITH t AS (SELECT n_regionkey * 100 AS p, n_regionkey * 100 + n_nationkey + 1 AS c FROM nation)
SELECT p AS from_idx, c AS to_idx, 'child' AS edge_type, CAST(1 AS DOUBLE) AS weight FROM t UNION ALL SELECT c, p, 'parent', 1 FROM t UNION ALL SELECT a.c, b.c, 'sibling', 0.8 FROM t a JOIN t b ON a.p = b.p AND a.c <> b.c""",
    "edge_type_counts": """
WITH t AS (SELECT n_regionkey AS p, n_nationkey AS c FROM nation)
SELECT 'child' AS edge_type, count(*) AS n_edges FROM t UNION ALL SELECT 'parent', count(*) FROM t UNION ALL SELECT 'sibling', count(*) FROM t a JOIN t b ON a.p = b.p AND a.c <> b.c""",
    "table_render_budget": """
WITH s AS (SELECT n_regionkey, n_nationkey, n_nationkey || ' | ' || n_name AS line FROM nation),
u AS (SELECT *, sum(len(line) + 1) OVER w + len('Key | Nation') AS used, row_number() OVER w AS n, count(*) OVER (PARTITION BY n_regionkey) AS total FROM s WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)),
k AS (SELECT n_regionkey, string_agg(line, chr(10) ORDER BY n) AS body, any_value(total) - count(*) AS more FROM u WHERE used <= 50 OR n = 1 GROUP BY n_regionkey)
SELECT CAST(n_regionkey AS VARCHAR) AS table_id, 'Table ' || n_regionkey || ':' || chr(10) || 'Key | Nation' || chr(10) || body || CASE WHEN more > 0 THEN chr(10) || '… (+' || more || ' more rows)' ELSE '' END AS text FROM k""",
    "score_report": "SELECT event_type, count(*) AS n_questions, round(avg(event_id % 11), 6) AS avg_score, round(avg(CASE WHEN event_id % 11 >= 7 THEN 1.0 ELSE 0 END), 6) AS pass_rate, CAST(sum(event_id % 300) AS BIGINT) AS tokens, round(avg(user_id % 50), 6) AS avg_ms FROM events GROUP BY event_type",
    "quick_totals": """
SELECT q.qid || '-' || c_nationkey AS qid, q.op, 'Balance' AS header, round(CASE q.op WHEN 'avg' THEN avg(round(c_acctbal)) ELSE max(round(c_acctbal)) END, 4) AS value, count(*) AS n_rows
FROM customer, (VALUES ('t1', 'avg'), ('t2', 'max')) q(qid, op) GROUP BY q.qid, q.op, c_nationkey
UNION ALL SELECT 't3-' || c_nationkey, 'sum', 'Balance', sum(round(c_acctbal)), count(*) FROM customer GROUP BY c_nationkey HAVING sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) = 0""",
}
QUERIES = {f"table_aggregate_{op}": partial(table_aggregate, op) for op in tables.OPS}
QUERIES |= {"table_filter_eq": partial(table_filter, "eq", "segment", "building"), "table_filter_contains": partial(table_filter, "contains", "segment", "Mach"), "table_filter_gt": partial(table_filter, "gt", "balance", "5,000"), "table_filter_lt": partial(table_filter, "lt", "balance", 0)}
QUERIES |= {f.__name__: f for f in (table_aggregate_where, table_aggregate_unknown, parse_number_cells, fuzzy_column_resolve, section_ids, section_children, graph_edges, edge_type_counts, table_render_budget, score_report, local_judge, quick_totals)}
__all__ = ["QUERIES", "SQL"]
