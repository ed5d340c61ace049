"""Fused rankings: reciprocal ranks with graph expansion, the hybrid of keywords and vectors, and a re-rank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folder import held
from ..functions.small import small
from ..functions.text import plain_tokens, terms, words
from . import graph, search
from .vectors import mean_vector

RRF_K = 60


def fuse(rankings: list[tuple[DataFrame, float]], pool: int, *, per_document: bool = False) -> DataFrame:
    """qid, doc_id, sec_idx, score: the sum of weight / (60 + rank) over rankings of at most ``pool`` rows."""
    by = ["qid", "doc_id"] if per_document else ["qid"]
    parts = [search.top_k(r, pool, by).select("qid", "doc_id", "sec_idx", (F.lit(float(w)) / (F.col("rank") + RRF_K)).alias("score")) for r, w in rankings]
    return reduce(DataFrame.unionByName, parts).groupBy("qid", "doc_id", "sec_idx").agg(F.sum("score").alias("score"))


def retrieve(lexical: DataFrame, dense: DataFrame, edge_table: DataFrame | None, k: int = 8, pool: int | None = None, *, per_document: bool = True, numbered: DataFrame | None = None) -> DataFrame:
    """The ``k`` best sections for each question (and document): lexical ranks weigh 2, dense ones 1.5, then one hop.

    The hop follows ``edge_table``, or with ``numbered`` the outline itself (and the table's edges, if both are given).
    """
    seeds = fuse([(lexical, 2.0), (dense, 1.5)], pool or 3 * k, per_document=per_document)
    if numbered is not None or edge_table is not None:
        seeds = small(held(seeds, "seeds"))  # the best of each ranking, which the hop reads several times
    if numbered is not None:
        scored = graph.expand_outline(seeds, numbered, edge_table)
    else:
        scored = seeds if edge_table is None else graph.expand(seeds, edge_table)
    return search.top_k(scored, k, ["qid", "doc_id"] if per_document else ["qid"])


def hybrid(sections: DataFrame, questions: DataFrame, *, provider: str = "bm25", vectors: DataFrame | None = None) -> DataFrame:
    """qid, doc_id, sec_idx, score > 0: 0.6 of the keyword score plus 0.4 of the semantic one.

    ``sections`` are (doc_id, sec_idx, title, keywords), ``questions`` (qid, question). The semantic score
    is the cosine, mapped to [0, 1], to the mean vector of the sections whose keywords a question names; in
    documents where it names none, or without vectors, the Jaccard similarity of keywords and words.
    """
    from ..functions.vectors import cosine

    asked = questions.select("qid", F.array_distinct(words(F.col("question"))).alias("tokens"))
    keys = F.coalesce("keywords", F.array().cast("array<string>"))
    bag = sections.select("doc_id", "sec_idx", F.array_distinct(F.concat(keys, words(F.col("title")))).alias("tokens"))
    kw = search.provider(provider)(bag, asked)
    terms_of = small(asked.select("qid", F.explode("tokens").alias("term")))
    keyed = sections.select("doc_id", "sec_idx", F.array_distinct(keys).alias("k"))
    shared = keyed.select("doc_id", "sec_idx", "k", F.explode("k").alias("term")).withColumn("d", F.size("k")).join(terms_of, "term").groupBy("qid", "doc_id", "sec_idx", "d").agg(F.count("*").alias("s"))
    sizes = small(asked.select("qid", F.size("tokens").alias("q")))
    sem = shared.join(sizes, "qid").select("qid", "doc_id", "sec_idx", (F.col("s") / F.greatest(F.col("q") + F.col("d") - F.col("s"), F.lit(1))).alias("sem"))
    if vectors is not None:
        named = shared.select("qid", "doc_id", "sec_idx").join(vectors, ["doc_id", "sec_idx"])
        proxy = mean_vector(named, ["qid", "doc_id"]).withColumnRenamed("embedding", "proxy")
        near = vectors.join(proxy, "doc_id").select("qid", "doc_id", "sec_idx", ((cosine(F.col("embedding"), F.col("proxy")) + 1) / 2).alias("sem"))
        sem = near.unionByName(sem.join(proxy, ["qid", "doc_id"], "left_anti"))
    score = 0.6 * F.coalesce("score", F.lit(0.0)) + 0.4 * F.coalesce("sem", F.lit(0.0))
    return kw.join(sem, ["qid", "doc_id", "sec_idx"], "full").select("qid", "doc_id", "sec_idx", score.alias("score")).where("score > 0")


def rerank(pool: DataFrame, sections: DataFrame, questions: DataFrame, most: int = 15) -> DataFrame:
    """The pool by 5 for every question term in the title, 2 in the text, 3 in a table header, and 10 times its score."""
    none = F.array().cast("array<array<string>>")
    heads = F.coalesce(F.transform("tables", lambda t: t["headers"]), none) if "tables" in sections.columns else none
    asked = questions.select("qid", F.array_distinct("tokens").alias("asked"))
    pool = small(held(pool.select("qid", "doc_id", "sec_idx", "score"), "pool"))
    # texts are taken apart after the join, which leaves those of the pool
    kept = sections.join(small(pool.select("doc_id", "sec_idx").distinct()), ["doc_id", "sec_idx"], "left_semi")
    own = kept.select("doc_id", "sec_idx", F.array_distinct(terms(F.col("title"))).alias("in_title"), F.array_distinct(terms(F.col("text"))).alias("in_text"), F.transform(heads, lambda h: F.array_distinct(plain_tokens(F.array_join(h, " ")))).alias("in_heads"))
    joined = pool.join(small(asked), "qid").join(own, ["doc_id", "sec_idx"])
    both = lambda c: F.size(F.array_intersect("asked", c))
    heads = F.aggregate(F.transform("in_heads", lambda h: F.size(F.array_intersect("asked", h))), F.lit(0), lambda a, x: a + x)
    scored = joined.select("qid", "doc_id", "sec_idx", (5 * both("in_title") + 2 * both("in_text") + 3 * heads + 10 * F.col("score")).alias("score"))
    return search.top_k(scored, most)


def without_references(sections: DataFrame) -> DataFrame:
    """Sections whose title does not begin like a list of references, notes or an index."""
    return sections.where(~F.lower(F.trim(F.coalesce("title", F.lit("")))).rlike("^(reference|endnote|footnote|bibliograph|index|glossary|acknowledg|table of contents)"))


def window_baseline(texts: DataFrame, questions: DataFrame, size: int = 512, k: int = 5) -> DataFrame:
    """The plain baseline: fixed word windows under BM25, the ``k`` best for each question, with their words."""
    from .chunks import word_windows

    windows_of = lambda t: t.select("doc_id", F.posexplode(word_windows(F.col("text"), size)).alias("sec_idx", "chunk"))
    windows = windows_of(texts)
    best = search.top_k(search.bm25(windows.select("doc_id", "sec_idx", terms(F.col("chunk")).alias("tokens")), questions), k)
    best = small(held(best, "best"))
    # only texts with a best window are cut again
    return best.join(windows_of(texts.join(best.select("doc_id").distinct(), "doc_id", "left_semi")), ["doc_id", "sec_idx"])


__all__ = ["fuse", "hybrid", "rerank", "retrieve", "window_baseline", "without_references"]
