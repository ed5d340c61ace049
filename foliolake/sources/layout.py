"""Sections from labelled page items, as a plan: what a layout model or an OCR engine finds is grouped by its labels.

Models need software that is not shipped; they give items (doc_id, chunk, ord, label,
text, level) - or, for scans, texts of page images - and what follows is relational.
A document may be read in chunks of pages; the sections of its chunks follow each other.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADINGS = ("section_header", "title")
IGNORED = ("page_header", "page_footer")
TEXTS = ("text", "list_item", "paragraph", "caption", "footnote", "formula", "code")
#: A page with a shorter text layer is taken for a scan.
LEAST_TEXT = 20


def sections(items: DataFrame) -> DataFrame:
    """doc_id, sec_idx, title, level, text, n_tables, n_images; chunks of a document keep their order.

    A heading begins a section. What comes before the first one of a chunk is a section of level 1 that is
    called by its first item: Introduction, Tables or Figures. Items of one ``ord`` stay in the order in which they are read.
    """
    label = F.lower("label")
    # the place is given where the items are read, so that a shuffle decides nothing
    known = items.withColumn("pos", F.monotonically_increasing_id()).where(~label.isin(*IGNORED)).withColumn("kind", F.when(label.isin(*HEADINGS), "heading").when(label.isin(*TEXTS), "text").when(label == "table", "table").when(label == "picture", "picture"))
    seen = known.where("kind IS NOT NULL AND (kind <> 'text' OR trim(coalesce(text, '')) <> '')").withColumn("text", F.trim(F.coalesce("text", F.lit(""))))
    order = Window.partitionBy("doc_id", "chunk").orderBy("ord")
    placed = seen.withColumn("part", F.sum((F.col("kind") == "heading").cast("int")).over(order))
    first = F.min_by(F.struct("kind", "text", "level"), F.struct("ord", "pos"))
    body = F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("ord", "pos", "text"))))
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).alias(f"n_{kind}s")
    grouped = placed.groupBy("doc_id", "chunk", "part").agg(first.alias("f"), body.alias("body"), count("table"), count("picture"))
    opening = F.when(F.col("f.kind") == "text", "Introduction").when(F.col("f.kind") == "table", "Tables").otherwise("Figures")
    title = F.when(F.col("f.kind") == "heading", F.coalesce(F.nullif("f.text", F.lit("")), F.lit("Section"))).otherwise(opening)
    level = F.when(F.col("f.kind") == "heading", F.greatest(F.least(F.coalesce(F.nullif("f.level", F.lit(0)), F.lit(1)), F.lit(6)), F.lit(1))).otherwise(1)
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk", "part")) - 1
    return grouped.select("doc_id", index.cast("int").alias("sec_idx"), title.alias("title"), level.cast("int").alias("level"), F.array_join(F.transform("body", lambda x: x["text"]), "\n\n").alias("text"), F.col("n_tables"), F.col("n_pictures").alias("n_images"))


def or_flat(structured: DataFrame, flat: DataFrame) -> DataFrame:
    """Sections of ``structured``, or those of ``flat`` for documents that have no text there, as scans of whole pages."""
    some = structured.where("text <> ''").select("doc_id").distinct()
    return structured.join(some, "doc_id", "left_semi").unionByName(flat.join(some, "doc_id", "left_anti")).unionByName(structured.join(some, "doc_id", "left_anti").join(flat.select("doc_id").distinct(), "doc_id", "left_anti"))


def no_text(images: list[bytes]) -> list[str]:
    """The recogniser that finds nothing, where no engine is installed."""
    return [""] * len(images)


def page_texts(pages: DataFrame, recognise: Callable[[list[bytes]], list[str]] = no_text, least: int = LEAST_TEXT) -> DataFrame:
    """``pages`` (…, text, image) with the text of their image where their own has under ``least`` characters; a failing engine gives none."""

    def run(s: pd.Series) -> pd.Series:
        out = pd.Series([""] * len(s), index=s.index, dtype=object)
        wanted = s[s.notna()]
        if len(wanted):
            try:
                out[wanted.index] = recognise([bytes(x) for x in wanted])
            except Exception:  # an engine may raise anything on a bad image
                pass
        return out

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    own: Column = F.trim(F.coalesce("text", F.lit("")))
    found = F.trim(F.pandas_udf(run, "string")(F.when(F.length(own) < least, F.col("image"))))
    return pages.withColumn("text", F.when(found != "", F.concat_ws("\n", F.nullif(own, F.lit("")), found)).otherwise(own))
