"""Rules on single values and small groups, each on cases that are made from the tables so that SQL knows what comes out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import answer, enrich, judge, library, outline, retrieve, smart, tables
from ..sources import layout, pdf_spans
from .common import QUESTIONS, SQL_QUESTIONS, questions, table
from .search_queries import _library
from .table_queries import customer_cells


def figure_values(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of key figures: magnitudes up to trillions, separators, a final k, and letters that do not scale."""
    k, n = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    value = F.when(k == 0, F.concat(F.lit("$"), n, F.lit(" trillion"))).when(k == 1, F.concat(F.lit("$"), n, F.lit("M"))).when(k == 2, F.concat(F.lit("1,0"), F.lpad(n, 2, "0"))).when(k == 3, F.concat(n, F.lit(".25k"))).when(k == 4, "none").otherwise(F.concat(F.lit("-"), n, F.lit(" Billion")))
    return table(spark, d, "part").select("p_partkey", X.parsed_figure(value).alias("value"))


def column_numbers(spark, d):
    return tables.numeric_column(customer_cells(spark, d), "account balance").select("section_id", "row_idx", "value")


def squared_tables(spark, d):
    """Rows that are shorter or longer than their header."""
    row = F.slice(F.array(F.col("n_name"), F.col("n_nationkey").cast("string"), F.lit("x"), F.lit("y")), F.lit(1), F.pmod("n_nationkey", F.lit(4)).cast("int") + 1)
    t = table(spark, d, "nation").select("n_nationkey", F.array(F.struct(F.lit("t").alias("table_id"), F.lit(None).cast("string").alias("caption"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("headers"), F.array(row).alias("rows"))).alias("tables"))
    return t.select("n_nationkey", F.array_join(F.element_at(F.element_at(outline.squared(F.col("tables")), 1)["rows"], 1), "|").alias("cells"))


def content_sections(spark, d):
    """Sections without those that only list references and the like."""
    lead = F.element_at(F.array(*map(F.lit, ("Results ", "References ", " Index of ", "glossary ", "The index "))), (F.col("p_partkey") % 5 + 1).cast("int"))
    s = table(spark, d, "part").select("p_partkey", F.concat(lead, "p_name").alias("title"))
    return retrieve.without_references(s).select("p_partkey", "title")


def figure_rows(spark, d):
    """Figures of sentences about customers: money, percentages, times, list numbers, years and names with numbers; the first three of each document."""
    c = table(spark, d, "customer")
    b = F.abs(F.round("c_acctbal")).cast("long").cast("string")
    text = F.concat(F.lit("1. Open balance: $"), b, F.lit(" million in 2021\nThe margin of the segment was 12.5% here\n"), F.lit("Model X7 has CODE 99\n**Delay:** "), F.col("c_custkey").cast("string"), F.lit(" ms and 3 days\nOpen balance: $"), b, F.lit(" million again"))
    s = c.select(F.col("c_custkey").cast("string").alias("doc_id"), F.lit(0).alias("sec_idx"), F.lit("§1").alias("id"), text.alias("text"))
    return enrich.key_numbers(s, most=3).select("doc_id", F.col("ord").cast("long").alias("ord"), "label", "value", "unit", "section")


def reply_fields(spark, d):
    """Model replies in JSON with and without fences, lists with too many keywords, and broken ones."""
    key = F.col("n_nationkey").cast("string")
    fact = F.concat(F.lit('{"summary": "About '), "n_name", F.lit('", "insights": ["a", "b"], "key_numbers": [{"label": "Key", "value": "'), key, F.lit('"}, {"label": "", "value": "1"}, {"label": "None"}]}'))
    m = F.col("n_nationkey") % 3
    reply = F.when(m == 0, F.concat(F.lit("Here it is:\n```json\n"), fact, F.lit("\n```\nDone"))).when(m == 1, F.concat(F.lit("Sure. "), fact)).otherwise("no JSON at all")
    words = F.concat(F.lit('so: ["'), F.array_join(F.transform(F.sequence(F.lit(1), (F.col("n_nationkey") % 15 + 1).cast("int")), lambda i: F.concat(F.lit("w"), i.cast("string"))), '", "'), F.lit('"]'))
    n = table(spark, d, "nation").select(F.col("n_name").alias("doc_id"), F.col("n_name").alias("title"), reply.alias("reply"), enrich.reply_keywords(words).alias("k"))
    facts = enrich.facts_of(n)
    shown = F.array_join(F.transform("key_numbers", lambda x: F.concat_ws("=", x["label"], x["value"], x["section"])), ";")
    return facts.join(n.select("doc_id", F.size("k").cast("long").alias("n_keywords")), "doc_id").select("doc_id", "summary", F.size("insights").cast("long").alias("n_insights"), shown.alias("numbers"), "n_keywords")


def guarded_answers(spark, d):
    """Answers that say nothing give way to computed and then to extracted ones."""
    k = F.col("n_nationkey") % 4
    a = F.when(k == 0, F.col("n_name")).when(k == 1, " x ").otherwise("")
    return table(spark, d, "nation").select("n_nationkey", answer.guarded(a, F.when(k == 2, "").otherwise("computed"), F.when(k == 3, F.lit(None)).otherwise("extracted")).alias("answer"))


def spans_outside_tables(spark, d):
    """Spans on a grid, without those whose centre lies in one of the boxes of their page."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("doc_id"), (F.col("c_custkey") % 3).alias("page"), F.col("c_custkey").alias("ord"), (F.col("c_custkey") % 10).cast("double").alias("x0"), (F.col("c_custkey") % 7).cast("double").alias("y0")).withColumns({"x1": F.col("x0") + 1, "y1": F.col("y0") + 1})
    boxes = table(spark, d, "nation").select(F.col("n_nationkey").alias("doc_id"), (F.col("n_nationkey") % 3).alias("page"), F.lit(2.0).alias("x0"), F.lit(1.0).alias("y0"), F.lit(6.5).alias("x1"), F.lit(4.5).alias("y1"))
    return pdf_spans.outside_tables(c, boxes).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("ord").alias("total"))


def layer_shares(spark, d):
    a = table(spark, d, "events").select((F.col("event_id") % 4).cast("int").alias("layer_used"), (F.col("event_id") % 100).alias("tokens_used"))
    return judge.layer_report(a).select(F.col("layer_used").cast("long").alias("layer_used"), "n", F.round("share", 6).alias("share"), "tokens")


def library_entries(spark, d):
    """Catalogue rows of the sources: their documents and the union of their first keywords."""
    t = table(spark, d, "documents")
    meta = F.struct(*(F.lit(None).cast("string").alias(n) for n in ("owner", "department", "version", "last_updated")), F.array().cast("array<string>").alias("tags"), F.array(F.lit("*")).alias("access_roles"))
    docs = t.groupBy(F.col("source").alias("doc_id")).agg(F.count("*").alias("x")).select("doc_id", F.upper("doc_id").alias("title"), F.lit("/").alias("source"), F.lit("md").alias("format"), F.lit("").alias("summary"), meta.alias("meta"))
    s = t.select(F.col("source").alias("doc_id"), F.array(F.col("lang"), F.concat(F.lit("k"), (F.col("doc_id") % 10).cast("string"))).alias("keywords"))
    return library.entries(docs, s).select("doc_id", "title", F.col("section_count").cast("long").alias("n"), F.array_join("keywords", ",").alias("keywords"))


def library_remove(spark, d):
    """All entries but three, and where their files are."""
    left = library.remove(_library(spark, d).withColumn("path", F.when(F.col("doc_id").cast("long") % 2 == 0, F.concat(F.lit("/abs/"), "doc_id")).otherwise(F.concat(F.lit("./rel/"), "doc_id"))), "1", "2", "5")
    return library.resolved(left, "/root/lib/").select("doc_id", "path")


def section_context(spark, d):
    """Titles and texts of a document up to a number of characters."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("doc_id"), F.col("c_custkey").alias("sec_idx"), F.col("c_name").alias("title"), F.repeat(F.col("c_mktsegment"), 60).alias("text"))
    return enrich.document_context(c, 1500).select("doc_id", F.md5("context").alias("digest"))


def embed_choice(spark, d):
    n = table(spark, d, "nation")
    summary = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit(" sum "), "n_name")).when(F.col("n_nationkey") % 3 == 1, "")
    return n.select("n_nationkey", V.embed_text(summary, F.col("n_name"), F.repeat(F.concat("n_name", F.lit(" ")), 60)).alias("text"))


def legacy_vectors(spark, d):
    """Vectors from base64 strings; every fifth is missing and every seventh is no base64."""
    e = table(spark, d, "embeddings")
    dims = len(e.select("embedding").first()[0])
    coded = F.when(F.col("vec_id") % 5 == 0, F.lit(None)).when(F.col("vec_id") % 7 == 0, "???").otherwise(F.base64(V.quantised(F.col("embedding"), "float32")))
    v = e.select("vec_id", V.legacy_vectors(coded, "float32", dims).alias("v"))
    return v.select("vec_id", F.size("v").cast("long").alias("dims"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


def quantised_bytes(spark, d):
    """The int8 and binary forms, and what can be read back from them."""
    e = table(spark, d, "embeddings")
    dims = len(e.select("embedding").first()[0])
    q = e.select("vec_id", V.quantised(F.col("embedding"), "int8").alias("i"), V.quantised(F.col("embedding"), "binary").alias("b"))
    back = lambda c, m: F.aggregate(V.dequantised(c, m, dims), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return q.select("vec_id", F.lower(F.hex("i")).alias("int8"), F.lower(F.hex("b")).alias("binary"), F.round(back(F.col("i"), "int8") * 127).cast("long").alias("int8_sum"), back(F.col("b"), "binary").cast("long").alias("binary_sum"))


def layout_sections(spark, d):
    """Order lines as items of a page layout, in chunks of pages."""
    m = F.col("l_linenumber")
    label = F.when((m == 3) & (F.col("l_quantity") > 10), "section_header").when(m == 2, "table").when(m == 4, "picture").when(m == 6, "page_footer").otherwise("text")
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (m >= 5).cast("int").alias("chunk"), (m * 1_000_000 + F.col("l_partkey")).alias("ord"), label.alias("label"), F.concat(F.lit(" part "), F.col("l_partkey").cast("string")).alias("text"), (F.col("l_quantity") % 9).cast("int").alias("level"))
    return layout.sections(items).select("doc_id", F.col("sec_idx").cast("long").alias("sec_idx"), "title", F.col("level").cast("long").alias("level"), "text", "n_tables", "n_images")


def judged_pairs(spark, d):
    """Scores of answers that have none to all of the words of a reference and its number or another one."""
    words = ("alpha", "beta", "gamma", "delta")
    k = F.col("c_custkey") % 5
    said = F.array_join(F.slice(F.array(*map(F.lit, words)), F.lit(1), k.cast("int")), " ")
    number = (F.col("c_custkey") % 9000 + 1000).cast("string")
    mine = F.when(F.col("c_custkey") % 2 == 0, number).otherwise("77")
    reference = F.concat(F.lit(" ".join(words) + ": "), number)
    return table(spark, d, "customer").select("c_custkey", judge.score(F.concat_ws(" ", said, mine), reference).cast("long").alias("score"))


def key_sentences(spark, d):
    """The five sentences of each document that are nearest to a question."""
    t = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return t.select("doc_id", F.md5(smart.key_sentences(F.col("text"), F.lit(QUESTIONS[1][1]), F.lit(5))).alias("digest"))


def corpus_texts(spark, d):
    """What is indexed of sections with tables."""
    n = table(spark, d, "nation")
    t = F.array(F.struct(F.array(F.lit("Key"), F.lit("Name")).alias("headers"), F.array(F.array(F.col("n_nationkey").cast("string"), F.col("n_name"))).alias("rows")))
    s = n.select("n_nationkey", F.col("n_name").alias("title"), F.when(F.col("n_nationkey") % 2 == 0, "body").otherwise("").alias("text"), t.alias("tables"))
    return s.select("n_nationkey", smart.corpus_text(s).alias("text"))


def _own(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.lit("corpus").alias("doc_id"), F.col("doc_id").alias("sec_idx"), F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), "text")


def bm25_two_queries(spark, d):
    """The larger of two scores: for all words of a question and for its content words."""
    s = _own(spark, d)
    found = smart.search.bm25_two_queries(s.select("doc_id", "sec_idx", smart.clean_words(smart.corpus_text(s)).alias("tokens")), smart.asked_words(questions(spark)))
    best = smart.search.top_k(found, 10)
    return best.select("qid", "sec_idx", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def smart_ranking(spark, d):
    """Three rankings fused and ranked again; BM25 stands for the dense one, as where no embedding model is."""
    return smart.ranking(_own(spark, d), questions(spark)).select("qid", "sec_idx", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


def smart_context(spark, d):
    """No SQL: the context that a model would see; its ranking and its sentences have queries of their own."""
    return smart.smart_context(_own(spark, d), questions(spark)).select("qid", "top_id", "n_tokens", F.md5("context").alias("digest"))


_NAME = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_STOP = "','".join(sorted(X.RETRIEVAL_STOP))
_CLEAN = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9\\-]+')"
_TWO = f"""
{SQL_QUESTIONS},
qw AS (SELECT qid, {_CLEAN.format('question')} AS w FROM question),
qc AS (SELECT qid, w, list_filter(w, lambda x: len(x) > 2 AND x NOT IN ('{_STOP}')) AS c FROM qw),
form AS (SELECT qid, 'w' AS f, unnest(w) AS term FROM qc UNION ALL SELECT qid, 'c', unnest(CASE WHEN len(c) > 0 THEN c ELSE w END) FROM qc),
asked2 AS (SELECT qid, f, term, count(*) AS times FROM form GROUP BY ALL),
body AS (SELECT doc_id AS sec_idx, concat_ws(' ', nullif(source, ''), nullif(source, ''), nullif(source, ''), nullif(text, '')) AS body, source, text FROM documents),
sec2 AS (SELECT sec_idx, {_CLEAN.format('body')} AS tokens FROM body),
tf2 AS (SELECT sec_idx, len, term, count(*) AS tf FROM (SELECT sec_idx, len(tokens) AS len, unnest(tokens) AS term FROM sec2) GROUP BY ALL),
stat2 AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM sec2),
df2 AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf2, stat2 GROUP BY term, n),
eps2 AS (SELECT avg(idf) * CAST(0.25 AS DOUBLE) AS low FROM df2),
raw2 AS (SELECT qid, f, sec_idx, sum(times * CASE WHEN idf < 0 THEN low ELSE idf END * tf * CAST(2.5 AS DOUBLE) / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * len / mean))) AS score FROM asked2 JOIN tf2 USING (term) JOIN df2 USING (term), stat2, eps2 GROUP BY ALL),
two AS (SELECT qid, sec_idx, max(score) AS score FROM raw2 GROUP BY ALL)"""
_GRAMS = "list_concat(t, list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1]))"
_TOKENS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
_SENT = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: len(s) > 15)"
_ASK = QUESTIONS[1][1].replace("'", "''")
SQL = {
    "figure_values": "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size * CAST(1e12 AS DOUBLE) WHEN 1 THEN p_size WHEN 2 THEN 1000 + p_size WHEN 3 THEN (p_size + CAST(0.25 AS DOUBLE)) * 1000 WHEN 5 THEN -p_size * CAST(1e9 AS DOUBLE) END AS value FROM part",
    "column_numbers": "SELECT CAST(c_nationkey AS VARCHAR) AS section_id, c_custkey AS row_idx, round(c_acctbal)::DOUBLE AS value FROM customer",
    "squared_tables": "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN n_name || '||' WHEN 1 THEN n_name || '|' || n_nationkey || '|' ELSE n_name || '|' || n_nationkey || '|x' END AS cells FROM nation",
    "content_sections": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Results ' ELSE 'The index ' END || p_name AS title FROM part WHERE p_partkey % 5 IN (0, 4)",
    "figure_rows": """
WITH c AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS doc_id, CAST(abs(round(c_acctbal)) AS BIGINT) AS b FROM customer)
SELECT doc_id, CAST(1 AS BIGINT) AS ord, 'Open balance' AS label, '$' || b || ' million' AS value, 'USD' AS unit, '§1' AS section FROM c
UNION ALL SELECT doc_id, 2, 'margin segment', '12.5%', '%', '§1' FROM c
UNION ALL SELECT doc_id, 3, 'Delay', c_custkey || ' ms', NULL, '§1' FROM c""",
    "reply_fields": """
SELECT n_name AS doc_id, CASE WHEN n_nationkey % 3 = 2 THEN 'Document: ' || n_name ELSE 'About ' || n_name END AS summary, CAST(CASE WHEN n_nationkey % 3 = 2 THEN 0 ELSE 2 END AS BIGINT) AS n_insights,
       CASE WHEN n_nationkey % 3 = 2 THEN '' ELSE 'Key=' || n_nationkey || '=§1' END AS numbers, CAST(least(n_nationkey % 15 + 1, 10) AS BIGINT) AS n_keywords FROM nation""",
    "guarded_answers": "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN 'computed' WHEN 2 THEN 'extracted' ELSE 'computed' END AS answer FROM nation",
    "spans_outside_tables": """
WITH c AS (SELECT *, c_custkey % 10 + 0.5 AS x, c_custkey % 7 + 0.5 AS y FROM customer)
SELECT c_nationkey AS doc_id, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS total FROM c WHERE NOT (c_custkey % 3 = c_nationkey % 3 AND x BETWEEN 2 AND 6.5 AND y BETWEEN 1 AND 4.5) GROUP BY c_nationkey""",
    "layer_shares": "SELECT event_id % 4 AS layer_used, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM events) AS DOUBLE), 6) AS share, CAST(sum(event_id % 100) AS BIGINT) AS tokens FROM events GROUP BY 1",
    "library_entries": "WITH k AS (SELECT source, unnest([lang, 'k' || (doc_id % 10)]) AS w FROM documents), u AS (SELECT source, string_agg(DISTINCT w, ',' ORDER BY w) AS keywords FROM k GROUP BY source) SELECT source AS doc_id, upper(source) AS title, count(*) AS n, any_value(keywords) AS keywords FROM documents JOIN u USING (source) GROUP BY source",
    "library_remove": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 2 = 0 THEN '/abs/' ELSE '/root/lib/rel/' END || doc_id AS path FROM documents WHERE doc_id NOT IN (1, 2, 5)",
    "section_context": """
WITH l AS (SELECT c_nationkey, c_custkey, '## ' || c_name || chr(10) || left(repeat(c_mktsegment, 60), 500) AS line FROM customer),
u AS (SELECT *, sum(len(line) + 1) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS used FROM l)
SELECT CAST(c_nationkey AS VARCHAR) AS doc_id, md5(string_agg(line, chr(10) ORDER BY c_custkey)) AS digest FROM u WHERE used <= 1500 OR used = len(line) + 1 GROUP BY c_nationkey""",
    "embed_choice": "SELECT n_nationkey, trim(CASE WHEN n_nationkey % 3 = 0 THEN ' sum ' || n_name ELSE n_name || ' ' || left(repeat(n_name || ' ', 60), 300) END) AS text FROM nation",
    "legacy_vectors": "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dims, round(CASE WHEN vec_id % 5 = 0 OR vec_id % 7 = 0 THEN 0 ELSE list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) END, 4)::DOUBLE AS total FROM embeddings",
    "quantised_bytes": """
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS FLOAT)) AS e FROM embeddings),
m AS (SELECT vec_id, e, CAST(127 AS FLOAT) / CAST(CAST(list_max(list_transform(e, lambda x: abs(x))) AS FLOAT) + CAST(1e-8 AS FLOAT) AS FLOAT) AS scale FROM s),
q AS (SELECT vec_id, e, list_transform(e, lambda x: CAST(trunc(least(greatest(CAST(x * CAST(scale AS FLOAT) AS FLOAT), CAST(-127 AS FLOAT)), CAST(127 AS FLOAT))) AS INT)) AS i FROM m)
SELECT vec_id, array_to_string(list_transform(i, lambda x: lpad(lower(to_base(CAST((x + 256) % 256 AS BIGINT), 16)), 2, '0')), '') AS int8,
       array_to_string(list_transform(range(0, (len(e) + 7) // 8), lambda k: lpad(lower(to_base(CAST(list_sum(list_transform(range(0, 8), lambda j: CASE WHEN coalesce(e[k * 8 + j + 1], 0) > 0 THEN CAST(pow(2, 7 - j) AS INT) ELSE 0 END)) AS BIGINT), 16)), 2, '0')), '') AS "binary",
       CAST(list_sum(i) AS BIGINT) AS int8_sum, CAST(list_sum(list_transform(e, lambda x: CASE WHEN x > 0 THEN 1 ELSE -1 END)) AS BIGINT) AS binary_sum FROM q""",
    "layout_sections": """
WITH i AS (SELECT l_orderkey AS doc_id, (l_linenumber >= 5)::INT AS chunk, l_linenumber * 1000000 + l_partkey AS ord, 'part ' || l_partkey AS text, CAST(l_quantity % 9 AS INT) AS level,
             CASE WHEN l_linenumber = 3 AND l_quantity > 10 THEN 'h' WHEN l_linenumber = 2 THEN 't' WHEN l_linenumber = 4 THEN 'p' WHEN l_linenumber = 6 THEN NULL ELSE 'x' END AS kind FROM lineitem),
p AS (SELECT *, sum((kind = 'h')::INT) OVER (PARTITION BY doc_id, chunk ORDER BY ord) AS part FROM i WHERE kind IS NOT NULL),
g AS (SELECT doc_id, chunk, part, min_by(kind, ord) AS k, min_by(text, ord) AS t, min_by(level, ord) AS l, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY ord) FILTER (WHERE kind = 'x'), '') AS text, count(*) FILTER (WHERE kind = 't') AS n_tables, count(*) FILTER (WHERE kind = 'p') AS n_images FROM p GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk, part) - 1 AS sec_idx, CASE k WHEN 'h' THEN t WHEN 'x' THEN 'Introduction' WHEN 't' THEN 'Tables' ELSE 'Figures' END AS title,
       CAST(CASE WHEN k = 'h' THEN greatest(least(CASE WHEN l = 0 THEN 1 ELSE l END, 6), 1) ELSE 1 END AS BIGINT) AS level, text, n_tables, n_images FROM g""",
    "judged_pairs": """
WITH c AS (SELECT c_custkey, c_custkey % 5 AS k, c_custkey % 2 = 0 AS same FROM customer),
r AS (SELECT *, CASE WHEN same THEN 1.0 ELSE 0.0 END AS num, (k + CASE WHEN same THEN 1 ELSE 0 END) / CAST(5 AS DOUBLE) AS kw, CASE WHEN k = 4 THEN 1.0 ELSE 0.0 END AS said FROM c),
s AS (SELECT *, 0.5 * num + CAST(0.3 AS DOUBLE) * kw + 0.2 * said AS x FROM r)
SELECT c_custkey, CAST(CASE WHEN num >= 0.75 AND kw >= 0.45 THEN 10 WHEN x >= 0.7 THEN 10 WHEN x >= 0.55 THEN 9 WHEN x >= 0.4 THEN 8 WHEN x >= 0.28 THEN 7 WHEN x >= 0.18 THEN 6 WHEN x >= 0.1 THEN 5 WHEN x >= 0.04 THEN 3 ELSE 0 END AS BIGINT) AS score FROM s""",
    "key_sentences": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, text, {_SENT} AS s FROM t),
a AS (SELECT doc_id, unnest(list_prepend('{_ASK}', s)) AS s, unnest(range(0, len(s) + 1)) AS i, len(s) + 1 AS n FROM s WHERE len(s) > 5),
g AS (SELECT doc_id, i, n, unnest({_GRAMS}) AS g FROM (SELECT doc_id, i, n, {_TOKENS.format('s')} AS t FROM a)),
f AS (SELECT doc_id, i, n, g, 1 + ln(count(*)) AS tf FROM g GROUP BY ALL),
d AS (SELECT doc_id, g, count(*) AS df FROM f GROUP BY ALL),
w AS (SELECT doc_id, i, g, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM f JOIN d USING (doc_id, g)),
z AS (SELECT doc_id, i, sqrt(sum(w * w)) AS z FROM w GROUP BY ALL),
q AS (SELECT doc_id, g, w AS qw FROM w WHERE i = 0),
x AS (SELECT doc_id, i, sum(w * qw) AS dot FROM w JOIN q USING (doc_id, g) WHERE i > 0 GROUP BY ALL),
c AS (SELECT a.doc_id, a.i, a.s, round(coalesce(dot / (z.z * y.z), 0), 9) AS score FROM a LEFT JOIN x ON x.doc_id = a.doc_id AND x.i = a.i LEFT JOIN z ON z.doc_id = a.doc_id AND z.i = a.i LEFT JOIN z y ON y.doc_id = a.doc_id AND y.i = 0 WHERE a.i > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS r FROM c),
k AS (SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS k FROM r WHERE r <= 5 GROUP BY doc_id)
SELECT doc_id, md5(coalesce(k, text)) AS digest FROM t LEFT JOIN k USING (doc_id)""",
    "corpus_texts": "SELECT n_nationkey, n_name || ' ' || n_name || ' ' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' body' ELSE '' END || ' Key Name ' || n_nationkey || ' ' || n_name AS text FROM nation",
    "bm25_two_queries": f"WITH {_TWO} SELECT qid, sec_idx, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, sec_idx) AS rank FROM two) WHERE rank <= 10",
    "smart_ranking": f"""
WITH {_TWO},
gr AS (SELECT sec_idx, unnest({_GRAMS}) AS term FROM (SELECT sec_idx, {_TOKENS.format('body')} AS t FROM body)),
gtf AS (SELECT sec_idx, term, 1 + ln(count(*)) AS tf FROM gr GROUP BY ALL),
gidf AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM gtf, stat2 GROUP BY term, n HAVING count(*) <= n * CAST(0.95 AS DOUBLE)),
gw AS (SELECT sec_idx, term, tf * idf AS w FROM gtf JOIN gidf USING (term)),
gn AS (SELECT sec_idx, sqrt(sum(w * w)) AS norm FROM gw GROUP BY sec_idx),
gq AS (SELECT qid, term, (1 + ln(count(*))) * any_value(idf) AS qw FROM (SELECT qid, unnest({_GRAMS}) AS term FROM (SELECT qid, {_TOKENS.format('question')} AS t FROM question)) JOIN gidf USING (term) GROUP BY qid, term),
cos AS (SELECT qid, sec_idx, sum(w * qw) / any_value(norm) AS score FROM gw JOIN gq USING (term) JOIN gn USING (sec_idx) GROUP BY qid, sec_idx),
lists AS (
  SELECT qid, sec_idx, CAST(3.5 AS DOUBLE) AS w, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, sec_idx) AS r FROM two
  UNION ALL SELECT qid, sec_idx, 1, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, sec_idx) FROM cos
),
fused AS (SELECT qid, sec_idx, sum(w / (60 + r)) AS score FROM lists WHERE r <= 30 GROUP BY ALL),
kw AS (SELECT qid, unnest(list_distinct(CASE WHEN len(c) > 0 THEN c ELSE w[1:8] END)) AS term FROM qc),
hit AS (SELECT qid, sec_idx, any_value(score) AS score, count(*) FILTER (WHERE list_contains(regexp_extract_all(lower(source), '[a-z0-9\\-]{{2,}}'), term)) AS nt, count(*) FILTER (WHERE list_contains(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\\-]{{2,}}'), term)) AS nb FROM fused JOIN kw USING (qid) JOIN body USING (sec_idx) GROUP BY ALL),
final AS (SELECT qid, sec_idx, 5 * nt + 2 * nb + 10 * score AS score FROM hit)
SELECT qid, sec_idx, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, sec_idx) AS rank FROM final) WHERE rank <= 5""",
}
QUERIES = {f.__name__: f for f in (figure_values, column_numbers, squared_tables, content_sections, figure_rows, reply_fields, guarded_answers, spans_outside_tables, layer_shares, library_entries, library_remove, section_context, embed_choice, legacy_vectors, quantised_bytes, layout_sections, judged_pairs, key_sentences, corpus_texts, bm25_two_queries, smart_ranking, smart_context)}
__all__ = ["QUERIES", "SQL"]
