"""Markdown: ATX headings outside fences cut a file into sections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Parsed, identifier, stem_of

_ATX = re.compile(r"(#{1,6})\s+(\S.*?)\s*\Z")


def parse(data: bytes, path: str) -> Parsed:
    out = Parsed(stem_of(path))
    lines, fenced, titled = [], False, False
    head: tuple[str, int] | None = None

    def close():
        text = str.strip("\n".join(lines))
        if head:
            out.add(*head, text)
        elif text:
            out.add(" ".join(identifier(path).split("-")).title(), 1, text)

    for line in data.decode("utf-8", "replace").splitlines():
        if line.strip().startswith(("```", "~~~")):
            fenced = not fenced
        found = None if fenced else _ATX.match(line)
        if not found:
            lines.append(line)
            continue
        close()
        head, lines = (found[2], len(found[1])), []
        if head[1] == 1 and not titled:
            out.title, titled = head[0], True
    close()
    if not head and out.sections:
        out.sections[0]["title"] = out.title
    if not out.sections:
        out.add(out.title, 1, "")
    return out


def sections(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The same cut as a plan without Python: doc_id, sec_idx, title (null before the first heading), level, text.

    Windows run inside one document, so their size is that of a document.
    """
    lines = docs.select(F.col(ident).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\r\n|\n|\r")).alias("at", "line"))
    order = Window.partitionBy("doc_id").orderBy("at")
    is_fence: Column = F.ltrim("line").rlike("^(```|~~~)")
    marked = lines.withColumn("fenced", F.sum(is_fence.cast("int")).over(order) % 2 == 1)
    heading = ~F.col("fenced") & F.col("line").rlike(r"^#{1,6}\s+\S")
    marked = marked.withColumn("heading", heading).withColumn("sec_idx", F.sum(F.col("heading").cast("int")).over(order))
    body = F.array_sort(F.collect_list(F.when(~F.col("heading"), F.struct("at", "line"))))
    grouped = marked.groupBy("doc_id", "sec_idx").agg(F.max(F.when(F.col("heading"), F.col("line"))).alias("head"), body.alias("body"))
    text_ = F.regexp_replace(F.array_join(F.transform("body", lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")
    out = grouped.select("doc_id", "sec_idx", F.regexp_extract("head", r"^#{1,6}\s+(.+?)\s*$", 1).alias("title"), F.length(F.regexp_extract("head", "^(#{1,6})", 1)).alias("level"), text_.alias("text"))
    return out.where("sec_idx > 0 OR text <> ''").withColumns({"title": F.when(F.col("sec_idx") > 0, F.col("title")), "level": F.when(F.col("sec_idx") > 0, F.col("level")).otherwise(1)})
