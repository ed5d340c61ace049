"""Search, vectors, fusion, answers and the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.folder import kept
from ..functions.text import FILLERS
from ..functions.vectors import dequantised, int8_levels, quantised
from ..operators import answer, enrich, index, library, outline, retrieve, search, sinks, vectors
from .common import SQL_ASKED, SQL_BM25, SQL_QUESTIONS, SQL_SECTIONS, SQL_SENTENCES, lexical, questions, sections, shown, sql_keyword_terms, sql_list, sql_plain, sql_terms, sql_top, sql_words, table, term_questions

K = 10


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return shown(search.top_k(search.bm25(lexical(spark, d), term_questions(spark)), K))


def bm25_okapi_norm(spark, d):
    return shown(search.top_k(search.bm25_okapi(lexical(spark, d), term_questions(spark)), K))


def tfidf_cosine_topk(spark, d):
    return shown(search.top_k(search.tfidf(lexical(spark, d), term_questions(spark)), K))


def jaccard_search(spark, d):
    return shown(search.top_k(search.overlap(lexical(spark, d), term_questions(spark)), K))


def bm25_stemmed(spark, d):
    """No SQL: stems; tests use published examples."""
    from ..functions.stemming import stemmed

    s = sections(spark, d).withColumn("tokens", stemmed(F.col("tokens")))
    return shown(search.top_k(search.bm25(s, term_questions(spark).withColumn("tokens", stemmed(F.col("tokens")))), K))


def window_baseline(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = retrieve.window_baseline(docs, term_questions(spark))
    return out.select("qid", F.col("doc_id").alias("document"), F.col("sec_idx").cast("long").alias("window_idx"), F.round("score", 5).alias("score"))


def _vectors(spark, d):
    """Vectors as sections; their label is the document."""
    return table(spark, d, "embeddings").select(F.col("label").cast("string").alias("doc_id"), F.col("vec_id").cast("int").alias("sec_idx"), "embedding")


def _centroids(spark, d):
    """The mean vector of each label, as queries: their number is that of the labels."""
    return vectors.mean_vector(_vectors(spark, d), ["doc_id"]).select(F.concat(F.lit("v"), "doc_id").alias("qid"), "embedding")


def mean_query_vector(spark, d):
    return _centroids(spark, d).select("qid", F.posexplode("embedding").alias("i", "x")).select("qid", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def vector_topk(spark, d):
    return shown(vectors.nearest(_vectors(spark, d), _centroids(spark, d), K)).withColumn("sec_idx", F.col("sec_idx").cast("long"))


def vector_topk_filtered(spark, d):
    found = vectors.nearest(_vectors(spark, d), _centroids(spark, d), K, where=F.col("doc_id") == "1")
    return shown(found).withColumn("sec_idx", F.col("sec_idx").cast("long"))


def semantic_edges(spark, d):
    """All pairs: labels are the documents, as in the other vector queries, of any size."""
    return vectors.similar_pairs(_vectors(spark, d).withColumn("sec_idx", F.col("sec_idx").cast("long")), 0.3).select("from_idx", "to_idx", F.round("weight", 5).alias("weight"))


def quantise_int8(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(int8_levels(F.col("embedding")), lambda x: x.cast("string")), ",").alias("levels"))


def quantise_roundtrip(spark, d):
    """The cosine between each vector and what its byte forms give back; half floats are within a thousandth."""
    from ..functions.vectors import cosine

    t = table(spark, d, "embeddings")
    near = t.select("vec_id", *[cosine(F.col("embedding"), dequantised(quantised(F.col("embedding"), m), m, 64)).alias(m) for m in ("float16", "int8", "binary")])
    return near.select("vec_id", (F.col("float16") > 0.999).alias("float16"), F.round("int8", 3).alias("int8"), F.round("binary", 4).alias("binary"))


def _tree(spark, d):
    """A heap-shaped outline over the documents: document i has the children 2i + 1 and 2i + 2."""
    return table(spark, d, "documents").select(F.lit("corpus").alias("doc_id"), F.col("doc_id").alias("sec_idx"), F.when(F.col("doc_id") > 0, F.floor((F.col("doc_id") - 1) / 2)).alias("parent_idx"))


def _dense(spark, d):
    """A dense ranking for the questions: question n asks with the centroid of label n."""
    c = _centroids(spark, d).where(F.col("qid").isin("v1", "v2", "v3")).withColumn("qid", F.replace("qid", F.lit("v"), F.lit("q")))
    v = table(spark, d, "embeddings").select(F.lit("corpus").alias("doc_id"), F.col("vec_id").cast("int").alias("sec_idx"), "embedding")
    return vectors.nearest(v, c, 30).select("qid", "doc_id", F.col("sec_idx").cast("long").alias("sec_idx"), "score")


def rrf_fusion(spark, d):
    found = search.bm25(lexical(spark, d), term_questions(spark))
    return shown(search.top_k(retrieve.fuse([(found, 2.0), (_dense(spark, d), 1.5)], 30), K), 6)


def rrf_graph_expand(spark, d):
    found = search.bm25(lexical(spark, d), term_questions(spark))
    return shown(retrieve.retrieve(found, _dense(spark, d), None, K, numbered=_tree(spark, d)), 6)


def rerank_pool(spark, d):
    found = search.top_k(search.bm25(lexical(spark, d), term_questions(spark)), 30)
    own = table(spark, d, "documents").select(F.lit("corpus").alias("doc_id"), F.col("doc_id").alias("sec_idx"), F.concat_ws(" ", "source", "lang").alias("title"), "text")
    return shown(retrieve.rerank(found.select("qid", "doc_id", "sec_idx", "score"), own, term_questions(spark), 15), 4)


def _keyed(spark, d):
    """Documents as sections of their source, with keywords: a catalogue that is written once, as keywords are found when documents come in."""
    return kept(spark, f"{d}/documents.parquet", "catalogue", lambda: _with_keywords(spark, d))


def _with_keywords(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("sec_idx"), F.concat(F.lit("§"), F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("title"), "text", F.lit(None).cast("string").alias("summary"), enrich.keywords(F.col("text"), F.col("lang")).alias("keywords"))


def hybrid_search(spark, d):
    q = spark.createDataFrame([("h1", "en licensed apache license"), ("h2", "the token erth de")], "qid string, question string")
    out = retrieve.hybrid(_keyed(spark, d), q, provider="keyword")
    return out.select("qid", F.col("doc_id").alias("source"), "sec_idx", F.round("score", 5).alias("score"))


def hybrid_vectors(spark, d):
    """Half keywords under BM25, half vectors: those of embeddings with the document's number, zeros where there is none."""
    q = spark.createDataFrame([("h1", "en licensed apache license"), ("h2", "the token erth de")], "qid string, question string")
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    zeros = F.array_repeat(F.lit(0.0), len(e.select("embedding").first()[0]))
    keyed = _keyed(spark, d)
    own = keyed.select("doc_id", "sec_idx").join(e, F.col("sec_idx") == F.col("vec_id"), "left").select("doc_id", "sec_idx", F.coalesce("embedding", zeros).alias("embedding"))
    out = retrieve.hybrid(keyed, q, provider="bm25", vectors=own)
    return out.select("qid", F.col("doc_id").alias("source"), "sec_idx", F.round("score", 5).alias("score"))


def _facts(spark, d):
    """Documents with summaries and insights, and figures, made from nations."""
    n = table(spark, d, "nation")
    docs = n.select(F.col("n_name").alias("doc_id"), F.when(F.col("n_nationkey") % 3 > 0, F.concat(F.lit("Summary of "), "n_name")).alias("summary"), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("first"), "n_name")).alias("insights"))
    c = table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # a nation table has a fixed size
    count = c.groupBy("n_name").agg(F.count("*").alias("n"), F.max(F.round("c_acctbal").cast("long")).alias("m"))
    kn = count.select(F.col("n_name").alias("doc_id"), F.inline(F.array(
        F.struct(F.lit(1).alias("ord"), F.lit("Number of customers").alias("label"), F.col("n").cast("string").alias("value"), F.lit(None).cast("string").alias("unit"), F.lit("§1").alias("section")),
        F.struct(F.lit(2).alias("ord"), F.lit("Largest account balance").alias("label"), F.col("m").cast("string").alias("value"), F.lit("USD").alias("unit"), F.lit("§2").alias("section")),
        F.struct(F.lit(3).alias("ord"), F.lit("Open orders").alias("label"), F.lit("1").alias("value"), F.lit(None).cast("string").alias("unit"), F.lit("§3").alias("section")),
        F.struct(F.lit(4).alias("ord"), F.lit("Total open orders").alias("label"), F.lit("2").alias("value"), F.lit(None).cast("string").alias("unit"), F.lit("§3").alias("section")),
    )))
    q = spark.createDataFrame([("a1", "Give me an overview"), ("a2", "any insights?"), ("a3", "How many customers are there?"), ("a4", "What is the largest account balance"), ("a5", "how many open orders")], "qid string, question string")
    return docs.select("doc_id").crossJoin(F.broadcast(q)), docs, kn  # there are five questions


def precomputed_answers(spark, d):
    return answer.precomputed(*_facts(spark, d))


def layered_answers(spark, d):
    """All deterministic layers together. Sources are the documents."""
    q = table(spark, d, "documents").select(F.col("source").alias("doc_id")).distinct().crossJoin(F.broadcast(questions(spark)))  # there are three questions
    docs = table(spark, d, "documents").groupBy(F.col("source").alias("doc_id")).agg(F.lit(None).cast("string").alias("summary")).withColumn("insights", F.lit(None).cast("array<string>"))
    kn = spark.createDataFrame([], "doc_id string, ord int, label string, value string, unit string, section string")
    out = answer.layered(q, docs, _keyed(spark, d), kn)
    return out.select("qid", "doc_id", "answer", "navigate_to", "layer_used", F.round("confidence", 4).alias("confidence"))


def _library(spark, d):
    t = table(spark, d, "documents")
    one = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("*"))).otherwise(F.array(F.concat(F.lit("role"), (F.col("doc_id") % 5).cast("string"))))
    return t.select(F.col("doc_id").cast("string").alias("doc_id"), F.concat_ws(" ", F.lit("Report"), "source").alias("title"), F.concat(F.lit("owner"), (F.col("doc_id") % 7).cast("string")).alias("owner"), F.upper("lang").alias("department"), F.array(F.lit("corpus"), F.col("source")).alias("tags"), one.alias("access_roles"), F.lit("").alias("summary"), F.slice(enrich.keywords(F.col("text"), F.lit("")), 1, 3).alias("keywords"))


def library_list(spark, d):
    return library.listed(_library(spark, d), "de", "role2").select("doc_id", "title", "department")


def library_search(spark, d):
    out = library.search(_library(spark, d), "Report DE owner3 src4 the", 20)
    return out.select("doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


def library_upsert(spark, d):
    """Entries of one department get another owner."""
    lib = _library(spark, d)
    new = lib.where("department = 'FR'").withColumn("owner", F.lit("changed"))
    return library.upsert(lib, new).groupBy("department", "owner").agg(F.count("*").alias("n"))


def role_filter(spark, d):
    return _library(spark, d).where(library.may_read("role4")).groupBy("department").agg(F.count("*").alias("n"))


def doc_fingerprint(spark, d):
    """As its SQL, over the length and the first 200 characters of each text; incremental_reindex hashes whole texts."""
    s = table(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("sec_idx"), F.concat(F.lit("§"), F.col("doc_id").cast("string")).alias("id"), "text")
    return index.text_fingerprints(s)


def incremental_reindex(spark, d):
    """Sources that changed since the registry was written: there the long French documents had another text."""
    s = table(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("sec_idx"), F.concat(F.lit("§"), F.col("doc_id").cast("string")).alias("id"), "text", "lang")
    before = s.withColumn("text", F.when((F.col("lang") == "fr") & (F.length("text") > 8000), F.lit("before")).otherwise(F.col("text")))
    return index.stale(index.whole_fingerprints(s), index.whole_fingerprints(before)).select("doc_id")


def postings_index(spark, d):
    p = index.postings(sections(spark, d))
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def catalogue_json(spark, d):
    """The catalogue of each document as JSON."""
    docs = table(spark, d, "region").select(F.col("r_name").alias("doc_id"), F.col("r_name").alias("title"), F.concat(F.lit("/data/"), "r_name").alias("source"), F.lit("table").alias("format"), F.lit("").alias("summary"), F.array(F.lit("x")).alias("insights"))
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # both have a fixed size
    s = outline.number(n.select(F.col("r_name").alias("doc_id"), F.col("n_nationkey").alias("sec_idx"), F.col("n_name").alias("title"), F.lit(1).alias("level")))
    s = s.withColumns({"children": F.array().cast("array<string>"), "token_count": F.lit(1), "summary": F.lit(""), "keywords": F.array(F.lower("title"))})
    kn = s.select("doc_id", F.col("sec_idx").alias("ord"), F.lit("Key").alias("label"), F.col("sec_idx").cast("string").alias("value"), F.lit("").alias("unit"), F.col("id").alias("section"))
    return sinks.catalogue(docs, s, kn)


_SQL_KEYWORDS = f"""
kt AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS i FROM (SELECT doc_id, {sql_keyword_terms('text')} AS w FROM documents)),
ks AS (SELECT doc_id, term, min(i) AS first, 1 AS grp, count(*) + len(term) * CAST(0.1 AS DOUBLE) AS s FROM kt GROUP BY doc_id, term),
kh AS (SELECT doc_id, term, first, 0 AS grp, 0.0 AS s FROM (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS first FROM (SELECT doc_id, {sql_keyword_terms('{title}')} AS w FROM documents)) UNION ALL SELECT doc_id, term, first, grp, s FROM ks),
ko AS (SELECT *, row_number() OVER (PARTITION BY doc_id, term ORDER BY grp, first) AS c FROM kh),
kr AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY grp, CASE WHEN grp = 0 THEN 0 ELSE -s END, first) AS r FROM ko WHERE c = 1),
kw AS (SELECT d.doc_id, coalesce(list(term ORDER BY r) FILTER (WHERE r <= {{k}}), []) AS keywords FROM documents d LEFT JOIN kr USING (doc_id) GROUP BY d.doc_id)"""


def _keywords_sql(title: str, k: int) -> str:
    return _SQL_KEYWORDS.replace("{title}", title).replace("{k}", str(k)).replace("{{", "{").replace("}}", "}")


_VEC = "vec AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"
_MEAN = "mean AS (SELECT label, list(x ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(e) AS x, unnest(range(len(e))) AS i FROM vec) GROUP BY label, i) GROUP BY label)"
_COS = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"
_NEAR = f"SELECT 'v' || m.label AS qid, vec_id AS sec_idx, ({_COS.format('e', 'm')} + 1) / 2 AS score FROM vec v, mean m"
_FUSE = f"""
{SQL_ASKED}, {SQL_SECTIONS}, {SQL_BM25}, {_VEC}, {_MEAN},
dense AS (SELECT 'q' || m.label AS qid, vec_id AS sec_idx, ({_COS.format('e', 'm')} + 1) / 2 AS score FROM vec v, mean m WHERE m.label IN (1, 2, 3)),
lists AS (
  SELECT qid, sec_idx, 2.0 AS w, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, sec_idx) AS r FROM scored
  UNION ALL SELECT qid, sec_idx, 1.5, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, sec_idx) FROM dense
),
fused AS (SELECT qid, sec_idx, sum(CAST(w AS DOUBLE) / (60 + r)) AS score FROM lists WHERE r <= 30 GROUP BY qid, sec_idx)"""
_LIB = f"""{_keywords_sql("''", 3)},
lib AS (SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, 'Report ' || source AS title, 'owner' || (d.doc_id % 7) AS owner, upper(lang) AS department, source, d.doc_id % 3 = 0 AS everyone, 'role' || (d.doc_id % 5) AS role, keywords FROM documents d JOIN kw USING (doc_id))"""
#: From ask(qid, q) and s(doc_id, source, k, b) to hk(qid, source, doc_id, score): Okapi inside each source, over the best of the question.
_OKAPI_IN = """
hb AS (SELECT source, doc_id, len(b) AS len, unnest(b) AS term FROM s),
hs AS (SELECT source, count(*) AS n, avg(len(b)) AS mean FROM s GROUP BY source),
hd AS (SELECT source, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM hb JOIN hs USING (source) GROUP BY source, term, n),
he AS (SELECT source, avg(idf) * CAST(0.25 AS DOUBLE) AS low FROM hd GROUP BY source),
hq AS (SELECT qid, unnest(q) AS term FROM ask),
hr AS (SELECT qid, source, doc_id, sum(CASE WHEN idf < 0 THEN low ELSE idf END * CAST(2.5 AS DOUBLE) / (1 + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * len / mean))) AS score FROM hq JOIN hb USING (term) JOIN hd USING (source, term) JOIN hs USING (source) JOIN he USING (source) GROUP BY ALL),
hk AS (SELECT qid, source, doc_id, score / (max(score) OVER (PARTITION BY qid, source) + CAST(1e-8 AS DOUBLE)) AS score FROM hr),
hj AS (SELECT qid, source, doc_id, len(list_intersect(q, list_distinct(k))) AS ik, len(q) AS nq, len(list_distinct(k)) AS nk FROM s, ask)"""
_LAYERED = f"""
WITH {SQL_QUESTIONS}, ask AS (SELECT qid, question, list_distinct({sql_words('question')}) AS q FROM question), {_keywords_sql('lang', 8)},
s AS (SELECT doc_id, source, text, keywords AS k, list_distinct(list_concat(keywords, {sql_words('lang')})) AS b FROM documents JOIN kw USING (doc_id)), {_OKAPI_IN},
h AS (SELECT qid, source, doc_id, CAST(0.6 AS DOUBLE) * coalesce(hk.score, 0) + CAST(0.4 AS DOUBLE) * CASE WHEN ik > 0 THEN ik / CAST(greatest(nq + nk - ik, 1) AS DOUBLE) ELSE 0 END AS score FROM hj LEFT JOIN hk USING (qid, source, doc_id)),
top AS (SELECT * FROM h WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY qid, source ORDER BY round(score, 9) DESC, doc_id) = 1),
good AS (SELECT qid, source, doc_id, score, text, list_distinct(list_filter({sql_plain('question')}, lambda t: len(t) > 2 AND NOT list_contains({sql_list(FILLERS)}, t))) AS q FROM top JOIN s USING (source, doc_id) JOIN question USING (qid) WHERE score >= CAST(0.35 AS DOUBLE)),
p AS (SELECT qid, source, q, unnest(x) AS t, unnest(range(len(x))) AS i FROM (SELECT qid, source, q, {SQL_SENTENCES} AS x FROM good)),
c AS (SELECT *, len(list_intersect(q, list_distinct({sql_plain('t')}))) AS n FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY n DESC, i) AS r FROM c),
x AS (SELECT qid, source, max(n) AS best, string_agg(t, ' ' ORDER BY i) AS found FROM r WHERE r <= 2 GROUP BY ALL),
done AS (SELECT qid, source, found, doc_id, score FROM good JOIN x USING (qid, source) WHERE best > 0 AND found <> '')
SELECT a.qid, d.source AS doc_id, coalesce(found, '') AS answer, '§' || done.doc_id AS navigate_to, CASE WHEN found IS NULL THEN -1 ELSE 1 END AS layer_used, round(CASE WHEN found IS NULL THEN 0 ELSE least(score, 1) END, 4)::DOUBLE AS confidence
FROM ask a, (SELECT DISTINCT source FROM documents) d LEFT JOIN done ON done.qid = a.qid AND done.source = d.source"""
SQL = {
    "bm25_topk": f"WITH {SQL_ASKED}, {SQL_SECTIONS}, {SQL_BM25} {sql_top(K)}",
    "bm25_okapi_norm": f"""
WITH {SQL_ASKED}, {SQL_SECTIONS},
tf AS (SELECT sec_idx, len, term, count(*) AS tf FROM (SELECT sec_idx, len(tokens) AS len, unnest(tokens) AS term FROM sec) GROUP BY ALL),
stat AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM sec),
df AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, stat GROUP BY term, n),
eps AS (SELECT avg(idf) * CAST(0.25 AS DOUBLE) AS low FROM df),
raw AS (SELECT qid, sec_idx, sum(CASE WHEN idf < 0 THEN low ELSE idf END * tf * CAST(2.5 AS DOUBLE) / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * len / mean))) AS score FROM asked JOIN tf USING (term) JOIN df USING (term), stat, eps GROUP BY qid, sec_idx),
scored AS (SELECT qid, sec_idx, score / (max(score) OVER (PARTITION BY qid) + CAST(1e-8 AS DOUBLE)) AS score FROM raw)
{sql_top(K)}""",
    "tfidf_cosine_topk": f"""
WITH {SQL_ASKED}, {SQL_SECTIONS},
tf AS (SELECT sec_idx, term, count(*) AS tf FROM (SELECT sec_idx, unnest(tokens) AS term FROM sec) GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM sec)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
w AS (SELECT sec_idx, term, tf * idf AS w FROM tf JOIN idf USING (term)),
norm AS (SELECT sec_idx, sqrt(sum(w * w)) AS norm FROM w GROUP BY sec_idx),
qn AS (SELECT qid, sqrt(sum(idf * idf)) AS qn FROM asked JOIN idf USING (term) GROUP BY qid),
scored AS (SELECT qid, sec_idx, sum(w * idf) / any_value(norm * qn) AS score FROM asked JOIN idf USING (term) JOIN w USING (term) JOIN norm USING (sec_idx) JOIN qn USING (qid) GROUP BY qid, sec_idx)
{sql_top(K)}""",
    "jaccard_search": f"""
WITH {SQL_ASKED}, {SQL_SECTIONS},
t AS (SELECT DISTINCT sec_idx, unnest(tokens) AS term FROM sec),
n AS (SELECT sec_idx, count(*) AS d FROM t GROUP BY sec_idx),
q AS (SELECT qid, count(*) AS q FROM asked GROUP BY qid),
scored AS (SELECT qid, sec_idx, count(*) / any_value(q + d - 0.0) AS s, count(*) AS i, any_value(q) AS q, any_value(d) AS d FROM asked JOIN t USING (term) JOIN n USING (sec_idx) JOIN q USING (qid) GROUP BY qid, sec_idx),
final AS (SELECT qid, sec_idx, CAST(i AS DOUBLE) / (q + d - i) AS score FROM scored)
{sql_top(K, 'final')}""",
    "window_baseline": f"""
WITH {SQL_ASKED},
w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, i, {sql_terms("array_to_string(w[i * 512 + 1:i * 512 + 512], ' ')")} AS tokens FROM (SELECT doc_id, w, unnest(range(0, (len(w) + 511) // 512)) AS i FROM w)),
sec AS (SELECT doc_id * 100000 + i AS sec_idx, tokens FROM i), {SQL_BM25}
SELECT qid, sec_idx // 100000 AS document, sec_idx % 100000 AS window_idx, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, sec_idx) AS rank FROM scored) WHERE rank <= 5""",
    "mean_query_vector": f"WITH {_VEC}, {_MEAN} SELECT 'v' || label AS qid, CAST(unnest(range(len(m))) AS BIGINT) AS i, round(unnest(m), 6) AS x FROM mean",
    "vector_topk": f"WITH {_VEC}, {_MEAN}, scored AS ({_NEAR}) {sql_top(K)}",
    "vector_topk_filtered": f"WITH {_VEC}, {_MEAN}, scored AS ({_NEAR} WHERE v.label = 1) {sql_top(K)}",
    "semantic_edges": f"WITH {_VEC} SELECT a.vec_id AS from_idx, b.vec_id AS to_idx, round({_COS.format('a.e', 'b.e')}, 5) AS weight FROM vec a JOIN vec b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE {_COS.format('a.e', 'b.e')} >= CAST(0.3 AS DOUBLE)",
    "quantise_int8": f"WITH {_VEC} SELECT vec_id, array_to_string(list_transform(e, lambda x: CAST(trunc(least(greatest(x * (CAST(127 AS DOUBLE) / (list_max(list_transform(e, lambda y: abs(y))) + CAST(1e-8 AS DOUBLE))), -127), 127)) AS INT)), ',') AS levels FROM vec",
    "rrf_fusion": f"WITH {_FUSE} {sql_top(K, 'fused', 6)}",
    "rrf_graph_expand": f"""
WITH {_FUSE},
t AS (SELECT (doc_id - 1) // 2 AS p, doc_id AS c FROM documents WHERE doc_id > 0),
edge AS (SELECT p AS f, c AS t, CAST(0.15 AS DOUBLE) AS g FROM t UNION ALL SELECT a.c, b.c, CAST(0.1 AS DOUBLE) * CAST(0.8 AS DOUBLE) FROM t a JOIN t b ON a.p = b.p AND a.c <> b.c),
passed AS (SELECT qid, sec_idx, score FROM fused UNION ALL SELECT qid, t, g * score FROM fused JOIN edge ON sec_idx = f),
final AS (SELECT qid, sec_idx, sum(score) AS score FROM passed GROUP BY qid, sec_idx)
{sql_top(K, 'final', 6)}""",
    "rerank_pool": f"""
WITH {SQL_ASKED}, {SQL_SECTIONS}, {SQL_BM25},
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, sec_idx) AS r FROM scored) WHERE r <= 30),
own AS (SELECT doc_id AS sec_idx, {sql_terms("source || ' ' || lang")} AS t, {sql_terms('text')} AS b FROM documents),
hit AS (SELECT qid, sec_idx, any_value(score) AS score, count(*) FILTER (WHERE list_contains(t, term)) AS nt, count(*) FILTER (WHERE list_contains(b, term)) AS nb FROM pool JOIN asked USING (qid) JOIN own USING (sec_idx) GROUP BY qid, sec_idx),
final AS (SELECT qid, sec_idx, 5 * nt + 2 * nb + 10 * score AS score FROM hit)
{sql_top(15, 'final', 4)}""",
    "hybrid_search": f"""
WITH question(qid, question) AS (VALUES ('h1', 'en licensed apache license'), ('h2', 'the token erth de')),
ask AS (SELECT qid, list_distinct({sql_words('question')}) AS q FROM question), {_keywords_sql('lang', 8)},
s AS (SELECT doc_id, source, keywords AS k, list_distinct(list_concat(keywords, {sql_words('lang')})) AS b FROM documents JOIN kw USING (doc_id)),
j AS (SELECT qid, source, doc_id, len(list_intersect(q, b)) AS ib, len(q) AS nq, len(b) AS nb, len(list_intersect(q, k)) AS ik, len(k) AS nk FROM s, ask)
SELECT qid, source, doc_id AS sec_idx, round(CAST(0.6 AS DOUBLE) * ib / (nq + nb - ib) + CAST(0.4 AS DOUBLE) * ik / greatest(nq + nk - ik, 1), 5) AS score FROM j WHERE ib > 0 OR ik > 0""",
    "hybrid_vectors": f"""
WITH question(qid, question) AS (VALUES ('h1', 'en licensed apache license'), ('h2', 'the token erth de')),
ask AS (SELECT qid, list_distinct({sql_words('question')}) AS q FROM question), {_keywords_sql('lang', 8)},
s AS (SELECT doc_id, source, keywords AS k, list_distinct(list_concat(keywords, {sql_words('lang')})) AS b FROM documents JOIN kw USING (doc_id)), {_OKAPI_IN},
v AS (SELECT source, doc_id, CASE WHEN embedding IS NULL THEN list_transform(range((SELECT max(len(embedding)) FROM embeddings)), lambda i: CAST(0 AS DOUBLE)) ELSE list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS e FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
u AS (SELECT qid, source, unnest(e) AS x, unnest(range(len(e))) AS i FROM hj JOIN v USING (source, doc_id) WHERE ik > 0),
p AS (SELECT qid, source, list(x ORDER BY i) AS p FROM (SELECT qid, source, i, avg(x) AS x FROM u GROUP BY ALL) GROUP BY ALL),
w AS (SELECT qid, source, doc_id, list_dot_product(e, p) AS d, sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(p, p)) AS z FROM v JOIN p USING (source)),
m AS (SELECT qid, source, doc_id, (CASE WHEN z > 0 THEN d / z ELSE 0 END + 1) / 2 AS sem FROM w UNION ALL SELECT qid, source, doc_id, CAST(ik AS DOUBLE) / greatest(nq + nk - ik, 1) FROM hj ANTI JOIN p USING (qid, source) WHERE ik > 0),
f AS (SELECT qid, source, doc_id, CAST(0.6 AS DOUBLE) * coalesce(hk.score, 0) + CAST(0.4 AS DOUBLE) * coalesce(sem, 0) AS score FROM hk FULL JOIN m USING (qid, source, doc_id))
SELECT qid, source, doc_id AS sec_idx, round(score, 5) AS score FROM f WHERE score > 0""",
    "layered_answers": _LAYERED,
    "quantise_roundtrip": f"""
WITH {_VEC}, q AS (SELECT vec_id, e, list_max(list_transform(e, lambda x: abs(x))) AS top FROM vec),
b AS (SELECT vec_id, e, list_transform(e, lambda x: CAST(trunc(least(greatest(x * (127 / (top + CAST(1e-8 AS DOUBLE))), -127), 127)) AS DOUBLE)) AS i, list_transform(e, lambda x: CASE WHEN x > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END) AS s FROM q)
SELECT vec_id, true AS float16, round({_COS.format('e', 'i')}, 3) AS int8, round({_COS.format('e', 's')}, 4) AS "binary" FROM b""",
    "precomputed_answers": """
WITH c AS (SELECT n_name, count(*) AS n, max(CAST(round(c_acctbal) AS BIGINT)) AS m FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)
SELECT 'a1' AS qid, n_name AS doc_id, 'Summary of ' || n_name AS answer FROM nation WHERE n_nationkey % 3 > 0
UNION ALL SELECT 'a2', n_name, '• first' || chr(10) || '• ' || n_name FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT 'a3', n_name, 'Number of customers: ' || n || ' (source: §1)' FROM c
UNION ALL SELECT 'a4', n_name, 'Largest account balance: ' || m || ' USD (source: §2)' FROM c""",
    "library_list": f"WITH {_LIB} SELECT doc_id, title, department FROM lib WHERE department = 'DE' AND (everyone OR role = 'role2')",
    "library_search": f"""
WITH {_LIB}, b AS (SELECT doc_id, len(list_intersect(['report', 'de', 'owner3', 'src4', 'the'], list_distinct(list_concat(['report', lower(source), owner, lower(department), 'corpus'], keywords)))) / CAST(5 AS DOUBLE) AS score FROM lib)
SELECT doc_id, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b WHERE score > 0) WHERE rank <= 20""",
    "library_upsert": "SELECT upper(lang) AS department, CASE WHEN lang = 'fr' THEN 'changed' ELSE 'owner' || (doc_id % 7) END AS owner, count(*) AS n FROM documents GROUP BY 1, 2",
    "role_filter": "SELECT upper(lang) AS department, count(*) AS n FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 4 GROUP BY 1",
    "doc_fingerprint": "SELECT source AS doc_id, sha256(string_agg('§' || doc_id || '|' || len(coalesce(text, '')) || '|' || left(coalesce(text, ''), 200), chr(10) ORDER BY doc_id)) AS hash FROM documents GROUP BY source",
    "incremental_reindex": "SELECT DISTINCT source AS doc_id FROM documents WHERE lang = 'fr' AND len(text) > 8000",
    "catalogue_json": """
WITH n AS (SELECT r_name, n_nationkey, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS i FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT r_name AS doc_id, '{"doc_id":"' || r_name || '","title":"' || r_name || '","source":"' || r_name || '","summary":"","insights":["x"],"key_numbers":['
  || string_agg('{"label":"Key","value":"' || n_nationkey || '","unit":"","section":"§' || i || '"}', ',' ORDER BY i) || '],"section_index":['
  || string_agg('{"id":"§' || i || '","title":"' || n_name || '","level":1,"children":[],"token_count":1,"summary":"","keywords":["' || lower(n_name) || '"]}', ',' ORDER BY i) || '],"language":"en"}' AS catalogue
FROM n GROUP BY r_name""",
    "postings_index": f"WITH {SQL_SECTIONS} SELECT term, count(DISTINCT sec_idx) AS df, count(*) AS tf FROM (SELECT sec_idx, unnest(tokens) AS term FROM sec) GROUP BY term",
}
QUERIES = {f.__name__: f for f in (bm25_topk, bm25_okapi_norm, tfidf_cosine_topk, jaccard_search, bm25_stemmed, window_baseline, mean_query_vector, vector_topk, vector_topk_filtered, semantic_edges, quantise_int8, quantise_roundtrip, rrf_fusion, rrf_graph_expand, rerank_pool, hybrid_search, hybrid_vectors, precomputed_answers, layered_answers, library_list, library_search, library_upsert, role_filter, doc_fingerprint, incremental_reindex, postings_index, catalogue_json)}
__all__ = ["QUERIES", "SQL"]
