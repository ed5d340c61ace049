"""Layered answers: what was computed before, then the best section, then (if given) a language model.

Every layer is a plan over all questions and documents; a question that a layer
answered leaves the later ones by an anti-join, so costly layers see few rows.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.small import small
from ..functions.text import FILLERS, MODIFIERS, plain_tokens, sentences, singular_tokens, words
from . import retrieve

SUMMARY_SIGNS = ("summary", "summarize", "summarise", "overview", "about", "tldr", "tl;dr")
INSIGHT_SIGNS = ("insight", "takeaway", "key point", "highlight", "main finding")
FOUND, WORTH_ASKING = 0.35, 0.15
_KEYS = ["qid", "doc_id"]


def best_sentences(text: Column, question: Column, n: int = 2) -> Column:
    """The ``n`` sentences that share most content words with the question, in order; empty if the best one shares none.

    Ties keep the earlier sentence, and a sentence that shares nothing may fill the last place.
    """
    asked = F.array_distinct(F.filter(plain_tokens(question), lambda t: (F.length(t) > 2) & ~t.isin(FILLERS)))
    scored = F.transform(sentences(text), lambda s, i: F.struct((-F.size(F.array_intersect(asked, plain_tokens(s)))).alias("score"), i.alias("i"), s.alias("s")))
    top = F.slice(F.array_sort(scored), 1, n)
    found = F.array_join(F.transform(F.array_sort(F.transform(top, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")))), lambda x: x["s"]), " ")
    return F.when((F.size(top) > 0) & (F.coalesce(F.try_element_at(top, F.lit(1))["score"], F.lit(0)) < 0), found).otherwise("")


def _any(text: Column, signs: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in signs:
        out = out | text.contains(s)
    return out


def match_figures(questions: DataFrame, figures: DataFrame) -> DataFrame:
    """qid, doc_id, label, value, unit, section of the figure that a question names.

    All core words of the label must be in the question; the labels with most core words win, and if
    these have different values nothing is returned. Of equal ones the first stays.
    """
    keep = F.filter(singular_tokens(F.col("label")), lambda t: ~t.isin(FILLERS))
    core = F.filter(keep, lambda t: ~t.isin(MODIFIERS))
    labels = figures.withColumn("core", F.when(F.size(core) > 0, core).otherwise(keep)).where(F.size("core") > 0)
    asked = questions.select("qid", "doc_id", singular_tokens(F.col("question")).alias("q"))
    hit = small(asked).join(labels, "doc_id").where(F.size(F.array_except("core", "q")) == 0).withColumn("weight", F.size("core"))
    best = hit.groupBy(*_KEYS).agg(F.max("weight").alias("weight"))
    top = hit.join(best, [*_KEYS, "weight"])
    return top.groupBy(*_KEYS).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.min_by(F.struct("label", "value", "unit", "section"), "ord").alias("f")).where("lo = hi").select(*_KEYS, "f.*")


def precomputed(questions: DataFrame, documents: DataFrame, figures: DataFrame) -> DataFrame:
    """qid, doc_id, answer of layer 0. A question for the summary ends here even where there is none."""
    rows = small(questions).join(documents.select("doc_id", "summary", "insights"), "doc_id").withColumn("low", F.lower("question"))
    about = _any(F.col("low"), SUMMARY_SIGNS)
    points = _any(F.col("low"), INSIGHT_SIGNS) & (F.coalesce(F.size("insights"), F.lit(0)) > 0)
    found = match_figures(questions, figures)
    line = F.concat("label", F.lit(": "), "value", F.coalesce(F.concat(F.lit(" "), "unit"), F.lit("")), F.lit(" (source: "), F.coalesce("section", F.lit("")), F.lit(")"))
    out = rows.join(found, _KEYS, "left")
    answer = F.when(about, F.nullif("summary", F.lit(""))).when(points, F.concat(F.lit("• "), F.array_join("insights", "\n• "))).otherwise(F.when(F.col("label").isNotNull(), line))
    return out.select(*_KEYS, answer.alias("answer")).where("answer IS NOT NULL")


def _render(tables: Column, budget: int) -> Column:
    """Tables of a section as text, each up to ``budget`` characters: the header, at least one row, and how many are left out."""

    def one(t: Column) -> Column:
        head = F.array_join(t["headers"], " | ")
        lines = F.transform(t["rows"], lambda r: F.array_join(r, " | "))
        # rows are taken while they fit; the state is (characters used, rows taken, whether one did not fit)
        start = F.struct(F.length(head).alias("used"), F.lit(0).alias("n"), F.lit(False).alias("full"))
        step = lambda s, line: F.when(s["full"] | (s["used"] + F.length(line) + 1 > budget) & (s["n"] >= 1), F.struct(s["used"].alias("used"), s["n"].alias("n"), F.lit(True).alias("full"))).otherwise(F.struct((s["used"] + F.length(line) + 1).alias("used"), (s["n"] + 1).alias("n"), F.lit(False).alias("full")))
        taken = F.aggregate(lines, start, step)["n"]
        more = F.size(lines) - taken
        body = F.array_join(F.concat(F.array(head), F.slice(lines, F.lit(1), taken)), "\n")
        return F.concat(F.lit("Table "), F.coalesce(t["table_id"], F.lit("")), F.lit(":\n"), body, F.when(more > 0, F.concat(F.lit("\n… (+"), more.cast("string"), F.lit(" more rows)"))).otherwise(""))

    return F.array_join(F.transform(tables, one), "\n\n")


def section_text(sections: DataFrame, prose: int | None = None, budget: int = 1500) -> Column:
    """A section's prose, cut to ``prose`` characters, and its tables within their budget; blank without either."""
    text = F.coalesce("text", F.lit(""))
    text = text if prose is None else F.substring(text, 1, prose)
    if "tables" not in sections.columns:
        return F.trim(text)
    rendered = F.when(F.coalesce(F.size("tables"), F.lit(0)) > 0, F.concat(F.lit("\n\n"), _render(F.col("tables"), budget))).otherwise("")
    return F.regexp_replace(F.concat(text, rendered), r"^\s+|\s+$", "")


def layered(questions: DataFrame, documents: DataFrame, sections: DataFrame, figures: DataFrame, *, vectors: DataFrame | None = None, provider: str = "bm25", complete: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """One answer for each (qid, doc_id) of the questions (qid, doc_id, question).

    Sections are (doc_id, sec_idx, id, title, text, summary, keywords[, tables]). Layers: 0 computed before, 1 the
    best section's summary or sentences, 2 to 4 the model on one section, three sections or the document,
    -1 nothing without a model. Ranking and answers computed before are joined to the questions once, and
    each row then takes the first layer that has an answer.
    """
    nothing = F.array().cast("array<string>")
    zero = precomputed(questions, documents, figures).withColumnRenamed("answer", "zero")
    scored = retrieve.hybrid(sections, questions.select("qid", "question").distinct(), provider=provider, vectors=vectors)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*_KEYS).orderBy(F.desc(F.round("score", 9)), "sec_idx"))).where("rank <= 3")
    own = sections.select("doc_id", "sec_idx", "id", "title", "text", "summary", section_text(sections, 2000).alias("one"), section_text(sections, 600, 800).alias("several"))
    best = F.struct("rank", "score", "id", "title", "summary", F.when(F.col("rank") == 1, F.col("text")).alias("text"), F.when(F.col("rank") == 1, F.col("one")).alias("one"), "several")
    # three rows for each question and document at most
    tops = ranked.join(own, ["doc_id", "sec_idx"]).groupBy(*_KEYS).agg(F.array_sort(F.collect_list(best)).alias("tops"))
    rows = questions.join(zero, _KEYS, "left").join(tops, _KEYS, "left").withColumn("top", F.try_element_at("tops", F.lit(1)))
    extract = F.coalesce(F.nullif("top.summary", F.lit("")), F.nullif(best_sentences(F.col("top.text"), F.col("question")), F.lit("")))
    rows = rows.withColumn("found", F.when(F.col("zero").isNull() & (F.col("top.score") >= FOUND), extract))
    usable = F.filter("tops", lambda t: t["several"] != "")
    layer = F.when(F.col("zero").isNotNull(), 0).when(F.col("found").isNotNull(), 1)
    if complete is None:
        rows = rows.withColumn("layer_used", layer.otherwise(-1)).withColumns({"reply": F.lit(None).cast("string"), "prompt": F.lit(None).cast("string"), "used": usable})
    else:
        layer = layer.when((F.col("top.score") >= WORTH_ASKING) & (F.col("top.one") != ""), 2).when(F.coalesce(F.size(usable), F.lit(0)) >= 2, 3)
        rows = rows.withColumns({"layer_used": layer.otherwise(4), "used": usable})
        whole = full_text(sections.join(questions.select("doc_id").distinct(), "doc_id", "left_semi"))
        single = F.concat_ws("\n", F.col("top.title"), F.col("top.one"))
        parts = F.array_join(F.transform("used", lambda p: F.concat_ws("\n", F.concat_ws(" ", p["id"], p["title"]), p["several"])), "\n\n")
        context = F.when(F.col("layer_used") == 2, single).when(F.col("layer_used") == 3, parts).when(F.col("layer_used") == 4, F.substring(F.coalesce("full_text", F.lit("")), 1, 6000))
        # the model sees all prompts of the layers 2 to 4 in one pass
        rows = rows.join(whole, "doc_id", "left").withColumn("prompt", prompt(F.col("question"), context)).withColumn("reply", _asker(complete)("prompt"))
    at = F.col("layer_used")
    answer = F.when(at == 0, F.col("zero")).when(at == 1, F.col("found")).when(at == -1, F.lit("")).otherwise(F.col("reply"))
    one = at.isin(1, 2)
    cited = F.when(one, F.array("top.id")).when(at == 3, F.transform("used", lambda p: p["id"])).otherwise(nothing)
    sure = F.when(at == 0, 1.0).when(at == 1, F.least("top.score", F.lit(1.0))).when(at == 2, F.least(F.col("top.score") + 0.1, F.lit(1.0))).when(at == 3, 0.6).when(at == 4, 0.4).otherwise(0.0)
    return rows.select(*_KEYS, answer.alias("answer"), cited.alias("citations"), F.when(one, F.col("top.id")).alias("navigate_to"), at.alias("layer_used"), F.when(at >= 2, _spent()).otherwise(0).alias("tokens_used"), sure.cast("double").alias("confidence"))


def prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Answer from the context only.\n\nContext:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))


def _spent() -> Column:
    return F.size(words(F.col("prompt"))) + F.size(words(F.col("reply")))


def _asker(complete):
    """A batch function for prompts; an error becomes a reply in brackets."""

    def run(s: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(s), index=s.index, dtype=object)
        asked = s[s.notna()]  # rows of layers without a model have no prompt
        if len(asked):
            try:
                out[asked.index] = complete(asked.tolist())
            except Exception as e:  # a provider may raise anything, and one bad batch must not end the job
                out[asked.index] = f"[model error: {e}]"
        return out

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")


def full_text(sections: DataFrame) -> DataFrame:
    """doc_id, full_text: headings, texts and rendered tables in reading order; sections without text are left out."""
    body = section_text(sections)
    line = F.when(body != "", F.concat(F.lit("## "), F.coalesce("title", F.lit("")), F.lit("\n"), body))
    return sections.select("doc_id", "sec_idx", line.alias("line")).where("line IS NOT NULL").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sec_idx", "line"))), lambda x: x["line"]), "\n\n").alias("full_text"))


def guarded(answer: Column, computed: Column, extracted: Column) -> Column:
    """An answer of three characters or more, else a table's aggregate, else extracted sentences."""
    return F.coalesce(F.when(F.length(F.trim(answer)) >= 3, answer), F.nullif(computed, F.lit("")), F.nullif(extracted, F.lit("")), answer)
