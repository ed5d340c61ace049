"""The fused question pipeline: four rankings of whole sections with their tables, a re-rank, and the key sentences of the best."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folder import held
from ..functions.small import small
from ..functions.text import RETRIEVAL_STOP, let, words
from . import retrieve, search

_WORD = re.compile(r"\w\w+")


def clean_words(c: Column) -> Column:
    """Words of letters, digits and hyphens of ASCII, of any length and with repetitions."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[a-z0-9\-]+"), F.lit(0))


def content_words(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: (F.length(w) > 2) & ~w.isin(RETRIEVAL_STOP))


def corpus_text(sections: DataFrame) -> Column:
    """What is indexed of a section: the title three times, the text, and all headers and cells of its tables."""
    title = F.nullif("title", F.lit(""))
    parts = [title, title, title, F.nullif("text", F.lit(""))]
    if "tables" in sections.columns:
        row = lambda r: F.array_join(r, " ")
        lines = F.flatten(F.transform("tables", lambda t: F.concat(F.array(row(t["headers"])), F.transform(t["rows"], row))))
        parts.append(F.array_join(F.filter(lines, lambda x: x != ""), " "))
    return F.concat_ws(" ", *parts)


def grams(c: Column) -> Column:
    """Words of two signs and more, and pairs of neighbouring ones."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    pairs = lambda t: F.concat(t, F.when(F.size(t) > 1, F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda i: F.concat(F.element_at(t, i), F.lit(" "), F.element_at(t, i + 1)))).otherwise(F.array().cast("array<string>")))
    return let(tokens, pairs)


def _key_sentences(text: str | None, question: str | None, n: int) -> str:
    if not text:
        return ""
    parts = [s for s in map(str.strip, re.split(r"(?<=[.!?])\s+", text)) if len(s) > 15]
    if len(parts) <= n:
        return text
    bags = []
    for s in (question or "", *parts):
        t = _WORD.findall(s.lower())
        bags.append(Counter([*t, *(f"{a} {b}" for a, b in zip(t, t[1:]))]))
    df = Counter(g for b in bags for g in b)
    weigh = lambda b: {g: (1 + math.log(k)) * (math.log((1 + len(bags)) / (1 + df[g])) + 1) for g, k in b.items()}
    asked, *own = map(weigh, bags)
    size = lambda w: math.sqrt(sum(x * x for x in w.values())) or 1.0
    score = [round(sum(x * asked.get(g, 0.0) for g, x in w.items()) / (size(w) * size(asked)), 9) for w in own]
    best = set(sorted(range(len(own)), key=lambda i: (-score[i], i))[:n])
    return " ".join(s for i, s in enumerate(parts) if i in best)


def key_sentences(text: Column, question: Column, n: Column) -> Column:
    """The ``n`` sentences nearest to the question, in order, by the cosine of tf-idf over words and pairs within the text.

    A text of ``n`` sentences or fewer is returned whole. Each row is worked on by itself, so nothing is shuffled.
    """

    def run(t: pd.Series, q: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([_key_sentences(*row) for row in zip(t, q, k)], index=t.index, dtype=object)

    run.__annotations__ = {"t": pd.Series, "q": pd.Series, "k": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(text, question, n.cast("int"))


def sentence_count(text: Column, least: int = 5) -> Column:
    """More sentences of longer texts."""
    size = F.length(F.coalesce(text, F.lit("")))
    steps = F.when(size > 50_000, 80).when(size > 30_000, 60).when(size > 20_000, 40).when(size > 10_000, 25).when(size > 5_000, 15).otherwise(least)
    return F.greatest(steps, F.lit(least))


def asked_words(questions: DataFrame) -> DataFrame:
    """qid, tokens, content of (qid, question): all words, and those of weight."""
    return questions.select("qid", clean_words(F.col("question")).alias("tokens")).withColumn("content", content_words(F.col("tokens")))


def tables_text(most: int) -> Column:
    """All tables of a section; those of more than 30 rows are cut to ``most``."""

    def one(t: Column) -> Column:
        rows = F.when(F.size(t["rows"]) <= 30, t["rows"]).otherwise(F.slice(t["rows"], 1, most))
        lines = F.transform(F.concat(F.array(t["headers"]), rows), lambda r: F.array_join(r, " | "))
        return F.concat(F.lit("\n\nTable ("), F.coalesce(F.nullif(t["caption"], F.lit("")), F.col("title")), F.lit("):\n"), F.array_join(lines, "\n"))

    return F.array_join(F.transform(F.coalesce("tables", F.slice("tables", 1, 0)), one), "")


def bm25_context(sections: DataFrame, questions: DataFrame) -> DataFrame:
    """qid, doc_id, top_id, context, n_tokens: the best sections of each document by :func:`search.bm25_two_queries`.

    Documents of 100 sections and more give five sections, of 30 and more four, else three; texts are cut to 700
    characters in documents of more than 80 sections, else to 1200. Sections are (doc_id, sec_idx, id, title, text[, tables]).
    """
    scored = search.bm25_two_queries(sections.select("doc_id", "sec_idx", clean_words(corpus_text(sections)).alias("tokens")), asked_words(questions))
    sizes = sections.groupBy("doc_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("qid", "doc_id").orderBy(F.round("score", 9).desc(), "sec_idx")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where("rank <= 5").join(sizes, "doc_id").where(F.col("rank") <= F.when(F.col("n") >= 100, 5).when(F.col("n") >= 30, 4).otherwise(3))
    own = ranked.join(sections, ["doc_id", "sec_idx"])
    cut = F.substring(F.coalesce("text", F.lit("")), F.lit(1), F.when(F.col("n") > 80, 700).otherwise(1200))
    return _contexts(own, cut, tables_text(6) if "tables" in sections.columns else F.lit(""))


def ranking(sections: DataFrame, questions: DataFrame, *, vectors: DataFrame | None = None, k: int = 5, pool: int = 30) -> DataFrame:
    """qid, doc_id, sec_idx, score, rank of the ``k`` best sections of all.

    Reciprocal ranks of BM25 (2), tf-idf of words and pairs (1) and of the dense ranking ``vectors`` (1.5; BM25 again
    without one) make a pool, which is ranked again by question words in titles, texts and table headers.
    Lists of references, notes and the like are left out.
    """
    used = retrieve.without_references(sections)
    body = corpus_text(used)
    asked = asked_words(questions)
    bm25 = search.bm25_two_queries(used.select("doc_id", "sec_idx", clean_words(body).alias("tokens")), asked, per_document=False)
    pairs = search.tfidf(used.select("doc_id", "sec_idx", grams(body).alias("tokens")), questions.select("qid", grams(F.col("question")).alias("tokens")), sublinear=True, most=0.95)
    # where BM25 stands for the dense ranking its ranks count for both, and it is ranked once
    fused = retrieve.fuse([(bm25, 3.5), (pairs, 1.0)] if vectors is None else [(bm25, 2.0), (pairs, 1.0), (vectors, 1.5)], pool)
    wanted = asked.select("qid", F.when(F.size("content") > 0, F.array_distinct("content")).otherwise(F.array_distinct(F.slice("tokens", 1, 8))).alias("tokens"))
    return search.top_k(retrieve.rerank(fused, used, wanted, 15).drop("rank"), k)


def smart_context(sections: DataFrame, questions: DataFrame, *, vectors: DataFrame | None = None, k: int = 5, sentences: int = 5, table_rows: int = 10) -> DataFrame:
    """qid, top_id, context, n_tokens: key sentences and tables of the sections of :func:`ranking`."""
    best = small(held(ranking(sections, questions, vectors=vectors, k=k), "best")).join(sections, ["doc_id", "sec_idx"]).join(questions.select("qid", "question"), "qid")
    picked = best.withColumn("key", key_sentences(F.col("text"), F.col("question"), sentence_count(F.col("text"), sentences)))
    return _contexts(picked.withColumn("doc_id", F.lit("all")), F.col("key"), tables_text(table_rows) if "tables" in sections.columns else F.lit("")).drop("doc_id")


def _contexts(ranked: DataFrame, text: Column, tables: Column) -> DataFrame:
    chunk = F.concat(F.lit("["), "id", F.lit(" — "), F.coalesce("title", F.lit("")), F.lit("]\n"), text, tables)
    grouped = ranked.groupBy("qid", "doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", chunk.alias("chunk")))).alias("parts"))
    context = F.array_join(F.transform("parts", lambda p: p["chunk"]), "\n\n---\n\n")
    return grouped.select("qid", "doc_id", F.element_at("parts", 1)["id"].alias("top_id"), context.alias("context"), F.size(words(context)).cast("long").alias("n_tokens"))
