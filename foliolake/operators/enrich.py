"""Keywords, key figures and summaries of sections."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import json_block, keyword_terms, let, token_estimate

_FIGURE = re.compile(
    r"(?P<money>\$\s?[0-9][0-9,]*(?:\.[0-9]+)?\s?(?:trillion|billion|million|[KMBk])?)"
    r"|(?P<percent>[0-9]+(?:\.[0-9]+)?\s?%)"
    r"|(?P<span>[0-9]+(?:\.[0-9]+)?\s?(?:ms|(?:sec|second|min|minute|hr|hour|day|week|month|year)s?)\b)"
    r"|(?P<times>[0-9]+(?:\.[0-9]+)?\s?[×x]\b)"
    r"|(?P<plain>\b[0-9][0-9,]*(?:\.[0-9]+)?\b)"
)
_ITEM = re.compile(r"\s*[0-9]+[).]\s")
_NAMED = re.compile(r"([a-zA-Z][-a-zA-Z0-9/& ]{1,40}?)\s*:[\s*]*$")
_FILLER = frozenset("a after all an and are at by down for from in is it its now of on our that the then this to up was we with".split())
MOST_FIGURES = 64


def _label(head: str) -> str:
    """What a figure is about: the nearest name with a colon before it, else the last words of weight."""
    named = _NAMED.search(head.rstrip())
    if named:
        return named[1].strip(" *(")
    return " ".join([w for w in re.findall("[a-zA-Z][-a-zA-Z/&]+", head) if w.lower() not in _FILLER][-4:])


def figures(text: str | None) -> list[tuple[str, str, str | None]]:
    """(label, value, unit) of the figures of a text, without list numbers, years, and numbers inside names."""
    out: dict[tuple[str, str], tuple[str, str, str | None]] = {}
    for line in (text or "").splitlines():
        item = _ITEM.match(line)
        for m in _FIGURE.finditer(line):
            head, raw = line[: m.start()], m[0].strip()
            if item and m.start() < item.end() or re.search(r"[A-Za-z]-?$", head):
                continue
            before = head.split()
            if before and re.fullmatch("[A-Z][A-Z]+", before[-1].strip(",.")):
                continue
            if m["plain"] and "." not in raw and 1900 <= int(raw.replace(",", "") or 0) <= 2099:
                continue
            label = _label(head)
            if label:
                unit = "%" if m["percent"] else "USD" if raw.startswith("$") else None
                out.setdefault((label.lower(), raw), (label, raw, unit))
    return list(out.values())


def key_numbers(sections: DataFrame, most: int | None = MOST_FIGURES) -> DataFrame:
    """doc_id, ord, label, value, unit, section: the first ``most`` figures of each document (all for None)."""
    schema = "doc_id string, sec_idx int, pos int, label string, value string, unit string, section string"

    def run(batches):
        for b in batches:
            rows = [(d, i, p, *f, s) for d, i, s, t in zip(b["doc_id"], b["sec_idx"], b["id"], b["text"]) for p, f in enumerate(figures(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "sec_idx", "pos", "label", "value", "unit", "section"])

    found = sections.select(F.col("doc_id").cast("string").alias("doc_id"), "sec_idx", "id", "text").mapInPandas(run, schema)
    ranked = found.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("sec_idx", "pos")))
    return (ranked if most is None else ranked.where(F.col("ord") <= most)).select("doc_id", "ord", "label", "value", "unit", "section")


def keywords(text: Column, title: Column, k: int = 8) -> Column:
    """Up to ``k`` terms: those of the title in order, then by frequency plus a tenth of the length, ties by first place.

    Counting is inside the row, on its sorted terms, so no shuffle is needed.
    """
    numbered = F.sort_array(F.transform(keyword_terms(text), lambda t, i: F.struct(t.alias("t"), i.alias("i"))))

    def score(s: Column) -> Column:
        """Runs of equal terms in the sorted array, as (minus score, first place, term)."""
        heads = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1)["t"] != x["t"]), i)), lambda i: i.isNotNull())

        def runs(h: Column) -> Column:
            n = lambda at, j: F.coalesce(F.get(h, j + 1), F.size(s)) - at
            return F.transform(h, lambda at, j: F.struct((-(n(at, j) + F.length(F.get(s, at)["t"]) * F.lit(0.1))).alias("score"), F.get(s, at)["i"].alias("first"), F.get(s, at)["t"].alias("term")))

        return let(heads, runs)

    ordered = F.transform(F.sort_array(let(numbered, score)), lambda s: s["term"])
    return F.slice(F.array_distinct(F.concat(keyword_terms(title), ordered)), 1, k)


def with_keywords(sections: DataFrame, k: int = 8) -> DataFrame:
    """Fills keywords where a section has none."""
    if "keywords" not in sections.columns:
        sections = sections.withColumn("keywords", F.lit(None).cast("array<string>"))
    return sections.withColumn("keywords", F.when(F.coalesce(F.size("keywords"), F.lit(0)) > 0, F.col("keywords")).otherwise(keywords(F.col("text"), F.col("title"), k)))


def with_summaries(sections: DataFrame, complete: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """Adds summaries. Short sections get their title; others the model's reply to a prompt, or null without a model.

    ``complete`` takes a batch of prompts and returns as many replies; it runs in Python workers.
    """
    short = F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+")) < 20
    if complete is None:
        return sections.withColumn("summary", F.when(short, F.col("title")))
    prompt = F.concat(F.lit("Summarise this section in one sentence.\n\n"), F.col("title"), F.lit("\n"), F.substring("text", 1, 2000))

    def ask(s: pd.Series) -> pd.Series:
        wanted = s[s.notna()]
        out = pd.Series([None] * len(s), index=s.index, dtype=object)
        if len(wanted):
            out[wanted.index] = complete(wanted.tolist())
        return out

    ask.__annotations__ = {"s": pd.Series, "return": pd.Series}
    reply = F.pandas_udf(ask, "string")(F.when(~short, prompt))
    return sections.withColumn("summary", F.when(short, F.col("title")).otherwise(F.substring(F.trim(reply), 1, 200)))


def reply_keywords(reply: Column, k: int = 10) -> Column:
    """Keywords from a model's reply that holds a JSON list."""
    return F.slice(F.from_json(json_block(reply), "array<string>"), 1, k)


_REPLY = "struct<summary:string,insights:array<string>,key_numbers:array<struct<label:string,value:string,unit:string,section:string>>>"


def document_facts(documents: DataFrame, complete: Callable[[list[str]], list[str]]) -> DataFrame:
    """doc_id, summary, insights, key_numbers of (doc_id, title, context) by a model's reply in JSON.

    Figures without a label or a value are left out; a reply that is no JSON leaves the title as the summary.
    """

    def ask(s: pd.Series) -> pd.Series:
        try:
            return pd.Series(complete(s.tolist()), index=s.index)
        except Exception:  # a provider may raise anything, and one bad batch must not end the job
            return pd.Series([None] * len(s), index=s.index, dtype=object)

    ask.__annotations__ = {"s": pd.Series, "return": pd.Series}
    prompt = F.concat(F.lit('Return a JSON object with "summary", "insights" and "key_numbers" (label, value, unit, section) of this document.\n\n'), "context")
    return facts_of(documents.withColumn("reply", F.pandas_udf(ask, "string")(prompt)))


def facts_of(replies: DataFrame) -> DataFrame:
    """doc_id, summary, insights, key_numbers of (doc_id, title, reply)."""
    parsed = replies.withColumn("r", F.from_json(json_block(F.col("reply")), _REPLY))
    good = F.col("r.summary").isNotNull() | F.col("r.insights").isNotNull() | F.col("r.key_numbers").isNotNull()
    named = F.transform(F.filter("r.key_numbers", lambda k: (F.coalesce(k["label"], F.lit("")) != "") & (F.coalesce(k["value"], F.lit("")) != "")), lambda k: F.struct(k["label"].alias("label"), k["value"].alias("value"), k["unit"].alias("unit"), F.coalesce(k["section"], F.lit("§1")).alias("section")))
    none = F.array()
    return parsed.select("doc_id", F.when(good, F.coalesce("r.summary", F.lit(""))).otherwise(F.concat(F.lit("Document: "), "title")).alias("summary"), F.coalesce("r.insights", none.cast("array<string>")).alias("insights"), F.coalesce(named, none.cast("array<struct<label:string,value:string,unit:string,section:string>>")).alias("key_numbers"))


def document_context(sections: DataFrame, budget: int = 8000) -> DataFrame:
    """doc_id, context: titles and texts in order, as many as fit into ``budget`` characters, at least the first."""
    line = F.concat(F.lit("## "), "title", F.lit("\n"), F.substring(F.coalesce("text", F.lit("")), 1, 500))
    order = Window.partitionBy("doc_id").orderBy("sec_idx")
    sized = sections.withColumn("line", line).withColumn("used", F.sum(F.length("line") + 1).over(order))
    kept = sized.where((F.col("used") <= budget) | (F.col("used") == F.length("line") + 1))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sec_idx", "line"))), lambda x: x["line"]), "\n").alias("context"))


def token_totals(sections: DataFrame) -> DataFrame:
    """doc_id, n_sections, n_tokens."""
    return sections.groupBy("doc_id").agg(F.count("*").alias("n_sections"), F.sum(token_estimate(F.col("text"))).alias("n_tokens"))


__all__ = ["document_context", "document_facts", "facts_of", "figures", "key_numbers", "keywords", "reply_keywords", "token_totals", "with_keywords", "with_summaries"]
