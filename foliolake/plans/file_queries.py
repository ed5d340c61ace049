"""Parsers and writers: files are made from the relational tables, read by the parsers, and compared with the tables."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.folder import delete, shared_folder
from ..functions.vectors import stride
from ..operators import outline, sinks
from ..sources import files
from .common import table


def _binary(df: DataFrame, path, text) -> DataFrame:
    return df.select(path.alias("path"), text.cast("binary").alias("content"))


def _lines(column: str, key: str):
    """The lines of a group in the order of ``key``, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, column))), lambda x: x[column]), "\n")


def _cells(t):
    """Header and rows of a table as one string."""
    return F.array_join(F.transform(F.concat(F.array(t["headers"]), t["rows"]), lambda r: F.array_join(r, "|")), "/")


def csv_sections(spark: SparkSession, d: str) -> DataFrame:
    """A delimited file for each nation: its customers, with a blank line and empty columns at the end; one file has an unknown format."""
    c = table(spark, d, "customer").withColumn("line", F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment", F.lit(""), F.lit("")))
    made = c.groupBy("c_nationkey").agg(F.concat(F.lit("Key,Name,Segment,,\n ,,,,\n"), _lines("line", "c_custkey")).alias("text"))
    name = F.concat(F.lit("/in/nation_"), F.col("c_nationkey").cast("string"), F.when(F.col("c_nationkey") == 3, ".dat").otherwise(".csv"))
    got = files.sections_of(_binary(made, name, F.col("text")))
    t = F.element_at("tables", 1)
    return got.select("source", "doc_id", "title", F.coalesce(F.col("level"), F.lit(-1)).cast("long").alias("level"), F.md5("text").alias("digest"), F.array_join(t["headers"], "|").alias("headers"), F.coalesce(F.size(t["rows"]), F.lit(-1)).cast("long").alias("n_rows"), "error")


def html_tables(spark, d):
    """A page for each region: a table whose first cell spans all rows and whose names span two columns, and a later section."""
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # both have a fixed size
    grouped = n.groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    first = F.concat(F.lit('<td rowspan="'), F.size("n").cast("string"), F.lit('">'), "r_name", F.lit("</td>"))
    row = lambda x, i: F.concat(F.lit("<tr>"), F.when(i == 0, first).otherwise(""), F.lit("<td>"), x["n_nationkey"].cast("string"), F.lit('</td><td colspan="2">'), x["n_name"], F.lit("</td></tr>"))
    html = F.concat(F.lit("<html><head><title>R "), "r_name", F.lit("</title><style>p {}</style></head><body><h1>"), "r_name", F.lit("</h1><p>Nations &amp; keys</p><table><caption>All</caption><tr><th>Region</th><th>Key</th><th>Name</th><th>Again</th></tr>"), F.array_join(F.transform("n", row), ""), F.lit("</table><script>x()</script><h3>After</h3><p>The end.</p></body></html>"))
    got = files.sections_of(_binary(grouped, F.concat(F.lit("region_"), F.col("r_regionkey").cast("string"), F.lit(".html")), html))
    return got.select("doc_id", "doc_title", F.col("sec_idx").cast("long").alias("sec_idx"), "title", F.col("level").cast("long").alias("level"), "text", F.coalesce(F.array_join(F.transform("tables", _cells), ";"), F.lit("")).alias("cells"))


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _workbook(name: str, rows: list[list]) -> bytes:
    cell = lambda v: f"<c><v>{v}</v></c>" if isinstance(v, int) else f'<c t="inlineStr"><is><t>{v}</t></is></c>'
    body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
    return _zipped({
        "xl/workbook.xml": f'<workbook xmlns="{_SHEET}" xmlns:r="{_RELATION}"><sheets><sheet name="{name}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_SHEET}"><sheetData>{body}</sheetData></worksheet>',
    })


def _document(name: str, rows: list[list]) -> bytes:
    p = lambda text, style="", bold=False: f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r>{"<w:rPr><w:b/></w:rPr>" if bold else ""}<w:t>{text}</w:t></w:r></w:p>'
    grid = "".join(f"<w:tr>{''.join(f'<w:tc>{p(str(v))}</w:tc>' for v in r)}</w:tr>" for r in [["Key", "Nation"], *rows])
    body = p("Before all") + p(f"About {name}", "Heading2") + p("First line") + p("an item", "ListBullet") + p("Nations:") + p("It has these") + f"<w:tbl>{grid}</w:tbl>" + p("Bold words here", bold=True) + p("Last line")
    return _zipped({
        "word/document.xml": f'<w:document xmlns:w="{_WORD}"><w:body>{body}</w:body></w:document>',
        "word/styles.xml": f'<w:styles xmlns:w="{_WORD}"><w:style w:styleId="Heading2"><w:name w:val="heading 2"/></w:style><w:style w:styleId="ListBullet"><w:name w:val="List Bullet"/></w:style></w:styles>',
    })


def _regions(spark, d) -> DataFrame:
    """r_name, nations (key, name, customers) and segments (name, customers)."""
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    nations = c.groupBy("n_regionkey", "n_nationkey", "n_name").agg(F.count("*").alias("n")).groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name", "n"))).alias("nations"))
    segments = c.groupBy("n_regionkey", "c_mktsegment").agg(F.count("*").alias("n")).groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("c_mktsegment", "n"))).alias("segments"))
    r = table(spark, d, "region")
    return r.join(nations, r.r_regionkey == nations.n_regionkey).drop("n_regionkey").join(segments, F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "nations", "segments")


def _made(df: DataFrame, ending: str, make) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pd.DataFrame({"path": [f"Region{n.title().replace(' ', '')}{ending}" for n in b["r_name"]], "content": [make(*row) for row in zip(b["r_name"], b["nations"], b["segments"])]})

    return files.sections_of(df.mapInPandas(run, "path string, content binary"))


def workbook_tables(spark, d):
    """A workbook for each region whose sheet has two tables, told apart by the second header."""

    def make(name, nations, segments):
        rows = [["Key", "Nation", "Customers"], *([int(x["n_nationkey"]), x["n_name"], int(x["n"])] for x in nations), ["Segment", "Customers", "Twice"], *([x["c_mktsegment"], int(x["n"]), 2 * int(x["n"])] for x in segments)]
        return _workbook(name, rows)

    got = _made(_regions(spark, d), ".xlsx", make)
    return got.select("doc_id", "title", F.explode("tables").alias("t"), "text").select("doc_id", "title", "t.table_id", _cells(F.col("t")).alias("cells"), F.md5("text").alias("digest"))


def word_sections(spark, d):
    """A word-processor file for each region: heading styles, what looks like a heading, a list and a table."""
    got = _made(_regions(spark, d), ".docx", lambda name, nations, segments: _document(name, [[int(x["n_nationkey"]), x["n_name"]] for x in nations]))
    return got.select("doc_id", F.col("sec_idx").cast("long").alias("sec_idx"), "title", F.col("level").cast("long").alias("level"), "text", F.array_join(F.transform("tables", _cells), ";").alias("cells"))


def _corpus(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents, sections and key figures: regions with their nations."""
    meta = F.struct(F.lit("o").alias("owner"), F.lit("d").alias("department"), F.array(F.lit("t")).alias("tags"), F.array(F.lit("*")).alias("access_roles"), F.lit("1").alias("version"), F.lit("2024").alias("last_updated"))
    r = table(spark, d, "region")
    docs = r.select(F.col("r_name").alias("doc_id"), F.concat(F.lit("About "), "r_name").alias("title"), F.concat(F.lit("/data/in/"), "r_name", F.lit(".md")).alias("source"), F.lit("md").alias("format"), F.lit("s").alias("summary"), F.array(F.lit("x")).alias("insights"), meta.alias("meta"))
    n = table(spark, d, "nation").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.concat(F.lit("Nation "), "n_name", F.lit(" of "), "r_name")
    s = outline.number(n.select(F.col("r_name").alias("doc_id"), F.col("n_nationkey").alias("sec_idx"), F.col("n_name").alias("title"), F.lit(1).alias("level"), text.alias("text")))
    s = s.join(outline.children(s), ["doc_id", "id"]).withColumns({"tables": F.array().cast("array<struct<table_id:string,caption:string,headers:array<string>,rows:array<array<string>>>>"), "images": F.array().cast("array<string>"), "token_count": F.size(F.split("text", " ")), "summary": F.lit("s"), "keywords": F.array(F.lower("title"))})
    figures = s.select("doc_id", F.col("sec_idx").alias("ord"), F.lit("Key").alias("label"), F.col("sec_idx").cast("string").alias("value"), F.lit("").alias("unit"), F.col("id").alias("section"))
    return docs, s, figures


def archive_roundtrip(spark, d):
    """Archives of all documents, read again: what their manifest, catalogue and contents say. One broken archive is an error."""
    docs, s, figures = _corpus(spark, d)
    made = sinks.archives(docs, s, figures).select(F.col("doc_id").alias("path"), F.col("archive").alias("content"))
    broken = table(spark, d, "region").limit(1).select(F.lit("broken").alias("path"), F.lit("no zip").cast("binary").alias("content"))
    got = sinks.read_archives(made.unionByName(broken))
    m = lambda c, p: F.get_json_object(c, p)
    index = F.from_json(m("catalogue", "$.section_index"), "array<struct<id:string,title:string,parent_id:string,token_count:int,keywords:array<string>>>")
    body = F.from_json("content", "map<string,struct<text:string>>")
    listed = F.array_join(F.transform(index, lambda x: F.concat_ws(":", x["id"], x["title"], x["token_count"].cast("string"), F.array_join(x["keywords"], "+"), F.element_at(body, x["id"])["text"])), "|")
    numbers = F.from_json(m("catalogue", "$.key_numbers"), "array<struct<label:string,value:string,section:string>>")
    return got.select("path", m("manifest", "$.udf_version").alias("version"), F.coalesce(m("manifest", "$.section_count").cast("long"), F.lit(-1)).alias("sections"), F.coalesce(m("manifest", "$.token_count").cast("long"), F.lit(-1)).alias("tokens"), m("catalogue", "$.source").alias("source"), listed.alias("listed"), F.array_join(F.transform(numbers, lambda k: F.concat_ws("@", k["value"], k["section"])), "|").alias("numbers"), F.col("error").isNotNull().alias("failed"))


def table_folder(spark, d):
    """Tables of a corpus written to a folder and read again."""
    docs, s, figures = _corpus(spark, d)
    path = f"{shared_folder(spark)}/table-folder"
    sinks.write_tables(path, documents=docs, sections=s, key_numbers=figures)
    counts = [sinks.read_table(spark, path, n).select(F.lit(n).alias("name"), F.md5(F.to_json(F.struct("doc_id"))).alias("x")).groupBy("name").agg(F.count("*").alias("n_rows"), F.countDistinct("x").alias("n_docs")) for n in ("documents", "sections", "key_numbers")]
    held = spark.createDataFrame(counts[0].unionByName(counts[1]).unionByName(counts[2]).collect(), "name string, n_rows long, n_docs long")  # three rows
    delete(spark, path)
    return held


def section_pages(spark, d):
    """The page of each document, without styles."""
    _, s, _ = _corpus(spark, d)
    return sinks.page(s.drop("images")).select("doc_id", "html")


def embedding_blobs(spark, d):
    """Vectors of each label at a fixed stride; every seventh is missing and becomes zeros."""
    e = table(spark, d, "embeddings").select(F.col("label").cast("string").alias("doc_id"), F.col("vec_id").alias("sec_idx"), F.when(F.col("vec_id") % 7 != 0, F.col("embedding")).alias("embedding"), F.size("embedding").alias("dims"))
    dims = e.agg(F.max("dims")).first()[0] or 0
    blobs = sinks.embedding_blob(e.drop("dims"), "binary", dims)
    return blobs.select("doc_id", F.octet_length("blob").cast("long").alias("n_bytes"), F.lit(stride("binary", dims)).cast("long").alias("stride"), F.md5("blob").alias("digest"))


_NATIONS = "SELECT r_name, n_nationkey, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS i FROM nation JOIN region ON n_regionkey = r_regionkey"
_GROUPED = """
nn AS (SELECT r_name, n_nationkey AS k, n_name AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
ss AS (SELECT r_name, c_mktsegment AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
tn AS (SELECT r_name, string_agg(k || '|' || name || '|' || n, '/' ORDER BY k) AS cells, string_agg(k || ' | ' || name || ' | ' || n, chr(10) ORDER BY k) AS lines FROM nn GROUP BY r_name),
ts AS (SELECT r_name, string_agg(name || '|' || n || '|' || 2 * n, '/' ORDER BY name) AS cells, string_agg(name || ' | ' || n || ' | ' || 2 * n, chr(10) ORDER BY name) AS lines FROM ss GROUP BY r_name)"""
_DOC_ID = "'region-' || array_to_string(list_transform(string_split(lower(r_name), ' '), lambda x: x), '-')"
_BITS = "array_to_string(list_transform(range(0, (len(e) + 7) // 8), lambda i: lpad(to_base(CAST(list_sum(list_transform(range(0, 8), lambda j: CASE WHEN coalesce(e[i * 8 + j + 1], 0) > 0 THEN CAST(pow(2, 7 - j) AS INT) ELSE 0 END)) AS BIGINT), 16), 2, '0')), '')"
SQL = {
    "csv_sections": """
WITH t AS (SELECT c_nationkey AS k, string_agg(c_custkey || ' | ' || c_name || ' | ' || c_mktsegment, chr(10) ORDER BY c_custkey) AS body, count(*) AS n FROM customer GROUP BY c_nationkey)
SELECT '/in/nation_' || k || '.csv' AS source, 'nation-' || k AS doc_id, 'Nation ' || k AS title, CAST(1 AS BIGINT) AS level, md5('File: nation_' || k || chr(10) || 'Columns: Key, Name, Segment' || chr(10) || 'Data:' || chr(10) || body) AS digest, 'Key|Name|Segment' AS headers, n AS n_rows, CAST(NULL AS VARCHAR) AS error FROM t WHERE k <> 3
UNION ALL SELECT '/in/nation_3.dat', 'nation-3', NULL, -1, NULL, NULL, -1, 'no parser takes this format' FROM t WHERE k = 3""",
    "html_tables": f"""
WITH n AS ({_NATIONS}), t AS (SELECT r_name, string_agg(r_name || '|' || n_nationkey || '|' || n_name || '|' || n_name, '/' ORDER BY n_nationkey) AS body FROM n GROUP BY r_name), r AS (SELECT r_regionkey, r_name, body FROM t JOIN region USING (r_name))
SELECT 'region-' || r_regionkey AS doc_id, 'R ' || r_name AS doc_title, CAST(0 AS BIGINT) AS sec_idx, r_name AS title, CAST(1 AS BIGINT) AS level, 'Nations & keys' AS text, 'Region|Key|Name|Again/' || body AS cells FROM r
UNION ALL SELECT 'region-' || r_regionkey, 'R ' || r_name, 1, 'After', 3, 'The end.', '' FROM r""",
    "workbook_tables": f"""
WITH {_GROUPED},
x AS (SELECT r_name, tn.cells AS a, ts.cells AS b, md5('Sheet: ' || r_name || chr(10) || 'Table: tbl_001' || chr(10) || 'Columns: Key, Nation, Customers' || chr(10) || 'Data:' || chr(10) || tn.lines || chr(10) || chr(10) || 'Sheet: ' || r_name || chr(10) || 'Table: tbl_002' || chr(10) || 'Columns: Segment, Customers, Twice' || chr(10) || 'Data:' || chr(10) || ts.lines) AS digest FROM tn JOIN ts USING (r_name))
SELECT {_DOC_ID} AS doc_id, r_name AS title, 'tbl_001' AS table_id, 'Key|Nation|Customers/' || a AS cells, digest FROM x
UNION ALL SELECT {_DOC_ID}, r_name, 'tbl_002', 'Segment|Customers|Twice/' || b, digest FROM x""",
    "word_sections": f"""
WITH n AS ({_NATIONS}), r AS (SELECT r_name, string_agg(n_nationkey || '|' || n_name, '/' ORDER BY n_nationkey) AS body FROM n GROUP BY r_name),
s AS (SELECT r_name, body, unnest([0, 1, 2, 3]) AS i FROM r)
SELECT {_DOC_ID} AS doc_id, CAST(i AS BIGINT) AS sec_idx, ['Introduction', 'About ' || r_name, 'Nations', 'Bold words here'][i + 1] AS title, CAST([1, 2, 1, 1][i + 1] AS BIGINT) AS level,
       ['Before all', 'First line' || chr(10) || chr(10) || '- an item', 'It has these', 'Last line'][i + 1] AS text, CASE WHEN i = 2 THEN 'Key|Nation/' || body ELSE '' END AS cells FROM s""",
    "archive_roundtrip": f"""
WITH n AS ({_NATIONS}), w AS (SELECT *, 'Nation ' || n_name || ' of ' || r_name AS text FROM n)
SELECT r_name AS path, '1.0' AS version, count(*) AS sections, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS tokens, r_name || '.md' AS source,
       string_agg('§' || i || ':' || n_name || ':' || len(string_split(text, ' ')) || ':' || lower(n_name) || ':' || text, '|' ORDER BY i) AS listed,
       string_agg(n_nationkey || '@§' || i, '|' ORDER BY i) AS numbers, false AS failed FROM w GROUP BY r_name
UNION ALL SELECT 'broken', NULL, -1, -1, NULL, NULL, NULL, true""",
    "table_folder": "SELECT 'documents' AS name, count(*) AS n_rows, count(*) AS n_docs FROM region UNION ALL SELECT 'sections', count(*), count(DISTINCT n_regionkey) FROM nation UNION ALL SELECT 'key_numbers', count(*), count(DISTINCT n_regionkey) FROM nation",
    "section_pages": f"""
WITH n AS ({_NATIONS})
SELECT r_name AS doc_id, '<!DOCTYPE html><meta charset="utf-8"><nav>' || string_agg('<a href="#§' || i || '" style="padding-left:12px">§' || i || ' ' || n_name || '</a>', chr(10) ORDER BY i) || '</nav><main>'
  || string_agg('<section id="§' || i || '"><h2>§' || i || ' ' || n_name || '</h2><p class="lead">s</p><p>Nation ' || n_name || ' of ' || r_name || '</p><em>' || lower(n_name) || '</em></section>', chr(10) ORDER BY i) || '</main>' AS html
FROM n GROUP BY r_name""",
    "embedding_blobs": f"""
WITH v AS (SELECT CAST(label AS VARCHAR) AS doc_id, vec_id, len(embedding) AS dims, CASE WHEN vec_id % 7 <> 0 THEN embedding ELSE list_transform(embedding, lambda x: CAST(0 AS FLOAT)) END AS e FROM embeddings)
SELECT doc_id, CAST(sum((dims + 7) // 8) AS BIGINT) AS n_bytes, CAST(max((dims + 7) // 8) AS BIGINT) AS stride, md5(unhex(string_agg({_BITS}, '' ORDER BY vec_id))) AS digest FROM v GROUP BY doc_id""",
}
QUERIES = {f.__name__: f for f in (csv_sections, html_tables, workbook_tables, word_sections, archive_roundtrip, table_folder, section_pages, embedding_blobs)}
__all__ = ["QUERIES", "SQL"]
