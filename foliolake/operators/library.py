"""The catalogue of documents: upsert, remove, list under access rules, and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words


def upsert(library: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries replace those with their doc_id."""
    return library.join(entries.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(entries, allowMissingColumns=True)


def remove(library: DataFrame, *doc_ids: str) -> DataFrame:
    return library.where(~F.col("doc_id").isin(*doc_ids))


def get(library: DataFrame, doc_id: str) -> DataFrame:
    return library.where(F.col("doc_id") == doc_id)


def resolved(library: DataFrame, root: str) -> DataFrame:
    """``library`` with absolute paths: relative ones are below ``root``."""
    full = F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace("path", r"^(?:\./)+", ""))
    return library.withColumn("path", F.when(F.col("path").rlike("^(/|[A-Za-z]:|[a-z0-9]+://)"), F.col("path")).otherwise(full))


def may_read(role: str) -> Column:
    """Whether a role passes; "*" passes everywhere and an entry for "*" lets everyone in."""
    roles = F.coalesce("access_roles", F.array(F.lit("*")))
    return F.lit(role == "*") | F.array_contains(roles, "*") | F.array_contains(roles, role)


def listed(library: DataFrame, department: str = "", role: str = "*") -> DataFrame:
    out = library.where(may_read(role))
    return out.where(F.lower("department") == department.lower()) if department else out


def search(library: DataFrame, query: str, k: int = 10) -> DataFrame:
    """The ``k`` entries that have the largest share of the query's words, with score and rank; access roles play no part.

    Tags and keywords count as whole strings, so those of several words match no single word.
    """
    asked = F.array_distinct(words(F.lit(query)))
    empty = F.array().cast("array<string>")
    lower = lambda c: F.transform(F.coalesce(c, empty), lambda x: F.lower(x))
    bag = F.array_distinct(F.concat(*[words(F.col(c)) for c in ("title", "owner", "department", "summary")], lower(F.col("tags")), lower(F.col("keywords"))))
    scored = library.withColumn("score", F.size(F.array_intersect(asked, bag)) / F.greatest(F.size(asked), F.lit(1)))
    # entries without a word are dropped after the limit: a filter before it would compute score and keywords twice
    return scored.orderBy(F.desc("score"), "doc_id").limit(k).where("score > 0").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))  # at most k rows are ranked


def entries(documents: DataFrame, sections: DataFrame) -> DataFrame:
    """Catalogue rows of documents: their metadata, number of sections and sorted union of keywords."""
    per = sections.groupBy("doc_id").agg(F.count("*").cast("int").alias("section_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("keywords", F.array().cast("array<string>")))))).alias("keywords"))
    return documents.join(per, "doc_id", "left").select("doc_id", "title", F.col("source").alias("path"), F.col("format").alias("source_format"), "meta.owner", "meta.department", "meta.tags", "meta.access_roles", "meta.version", "meta.last_updated", "summary", F.coalesce("section_count", F.lit(0)).alias("section_count"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("added_at"), "keywords")
