"""Headings of page layouts by font size, as a plan over extracted spans.

Extraction needs a PDF library and is supplied by the user (see ``files.register``);
what follows is relational: spans (doc_id, ord, text, size, bold) become sections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sections(spans: DataFrame, threshold: float = 1.15) -> DataFrame:
    """doc_id, sec_idx, title, level, text. Sizes of headings rank as levels 1 to 6, larger first.

    The median is the upper one of the document's span sizes. Windows and arrays
    are per document.
    """
    sizes = F.sort_array(F.collect_list("size"))
    median = spans.groupBy("doc_id").agg(F.element_at(sizes, F.floor(F.size(sizes) / 2).cast("int") + 1).alias("median"))
    seen = spans.where(F.trim("text") != "").join(median, "doc_id").withColumn("text", F.trim("text"))
    large = F.col("size") >= F.col("median") * threshold
    bold = F.col("bold") & (F.col("size") >= F.col("median") * 1.05) & (F.length("text") < 100)
    seen = seen.withColumns({"large": large, "heading": large | bold})
    by_size = Window.partitionBy("doc_id").orderBy(F.col("large").desc(), F.col("size").desc())
    order = Window.partitionBy("doc_id").orderBy("ord")
    seen = seen.withColumn("level", F.when(F.col("large"), F.least(F.dense_rank().over(by_size), F.lit(6))).otherwise(1)).withColumn("sec_idx", F.sum(F.col("heading").cast("int")).over(order))
    lines = F.array_sort(F.collect_list(F.when(~F.col("heading"), F.struct("ord", "text"))))
    grouped = seen.groupBy("doc_id", "sec_idx").agg(F.max(F.when(F.col("heading"), F.col("text"))).alias("title"), F.max(F.when(F.col("heading"), F.col("level"))).alias("level"), lines.alias("lines"))
    return grouped.select("doc_id", "sec_idx", F.coalesce("title", F.lit("Introduction")).alias("title"), F.coalesce("level", F.lit(1)).alias("level"), F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text"))


def outside_tables(spans: DataFrame, boxes: DataFrame) -> DataFrame:
    """Spans whose centre lies in no table box of their page: (doc_id, page, x0, y0, x1, y1) on both sides."""
    s, b = spans.alias("s"), boxes.alias("b")
    x, y = (F.col("s.x0") + F.col("s.x1")) / 2, (F.col("s.y0") + F.col("s.y1")) / 2
    inside = (F.col("s.doc_id") == F.col("b.doc_id")) & (F.col("s.page") == F.col("b.page")) & x.between(F.col("b.x0"), F.col("b.x1")) & y.between(F.col("b.y0"), F.col("b.y1"))
    return s.join(b, inside, "left_anti")
