"""Writing documents: table folders, zipped archives, HTML pages and the catalogue views inside them."""

from __future__ import annotations

import io
import json
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import escaped
from ..functions.vectors import MODES, from_bytes, stride, to_bytes

VERSION = "1.0"
TABLES = ("documents", "sections", "key_numbers", "postings", "embeddings", "graph_edges", "registry", "library")


def write_tables(path: str, mode: str = "overwrite", **tables: DataFrame) -> None:
    """One Parquet table per name below ``path``."""
    unknown = set(tables) - set(TABLES)
    if unknown:
        raise ValueError(f"unknown tables {sorted(unknown)}; choose from {TABLES}")
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def clean_source(source: Column, keep: bool = False) -> Column:
    """A path's last part, so that archives do not tell about folders; addresses stay."""
    if keep:
        return source
    last = F.regexp_extract(source, r"([^/\\]+)[/\\]*$", 1)
    return F.when((source == "") | source.contains("://"), source).otherwise(F.when(last != "", last).otherwise(source))


def manifest(documents: DataFrame, sections: DataFrame, quantisation: str = "float16", dims: int = 0) -> DataFrame:
    """doc_id, manifest: what an archive says about itself, as JSON."""
    per = sections.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))
    fields = F.struct(F.lit(VERSION).alias("udf_version"), "doc_id", "title", "format", F.col("n").alias("section_count"), F.col("tokens").alias("token_count"), F.lit(quantisation).alias("quantization"), F.lit(dims).alias("embedding_dims"), F.lit(True).alias("intelligence"), "meta.owner", "meta.department", "meta.tags", "meta.access_roles", "meta.version", "meta.last_updated", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at"))
    return documents.join(per, "doc_id", "left").select("doc_id", F.to_json(fields).alias("manifest"))


def catalogue(documents: DataFrame, sections: DataFrame, figures: DataFrame, keep_source: bool = False) -> DataFrame:
    """doc_id, catalogue: titles, summaries and key figures without section texts, as JSON."""
    entry = F.struct("sec_idx", F.struct("id", "title", "level", "parent_id", "children", "token_count", "summary", "keywords").alias("s"))
    index = sections.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["s"]).alias("section_index"))
    numbers = figures.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct("label", "value", "unit", "section").alias("k")))), lambda x: x["k"]).alias("key_numbers"))
    fields = F.struct("doc_id", "title", clean_source(F.col("source"), keep_source).alias("source"), "summary", "insights", "key_numbers", "section_index", F.lit("en").alias("language"))
    return documents.join(index, "doc_id", "left").join(numbers, "doc_id", "left").select("doc_id", F.to_json(fields).alias("catalogue"))


def content(sections: DataFrame) -> DataFrame:
    """doc_id, content: texts, tables and images by section id, as JSON."""
    body = F.struct("id", F.struct("text", "tables", "images").alias("v"))
    return sections.groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.collect_list(body))).alias("content"))


def embedding_blob(sections: DataFrame, mode: str, dims: int) -> DataFrame:
    """doc_id, blob: the vectors of a document in order at a fixed stride; missing ones are zeros."""
    stride(mode, dims)
    held = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sec_idx", "embedding"))).alias("v"))

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "blob": [b"".join(to_bytes(np.zeros(dims) if x["embedding"] is None else x["embedding"], mode) for x in v) for v in b["v"]]})

    return held.mapInPandas(run, "doc_id string, blob binary")


def blob_vectors(blob: bytes, mode: str, dims: int) -> list[np.ndarray]:
    """The vectors of a blob; its length must be whole strides."""
    size = stride(mode, dims)
    if mode not in MODES or size == 0 or len(blob) % size:
        raise ValueError("the blob does not fit its dimensions")
    return [from_bytes(blob[i : i + size], mode, dims) for i in range(0, len(blob), size)]


def archives(documents: DataFrame, sections: DataFrame, figures: DataFrame, mode: str = "float16", dims: int = 0) -> DataFrame:
    """doc_id, archive: a zip for each document with manifest, catalogue, content and vectors; JSON is packed hard, vectors fast."""
    parts = manifest(documents, sections, mode, dims).join(catalogue(documents, sections, figures), "doc_id").join(content(sections), "doc_id", "left")
    parts = parts.join(embedding_blob(sections, mode, dims), "doc_id", "left") if dims else parts.withColumn("blob", F.lit(None).cast("binary"))

    def run(batches):
        for b in batches:
            out = []
            for m, c, t, e in zip(b["manifest"], b["catalogue"], b["content"], b["blob"]):
                file = io.BytesIO()
                with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
                    for name, text in (("manifest.json", m), ("catalogue.json", c), ("content.json", t or "{}")):
                        z.writestr(name, json.dumps(json.loads(text), separators=(",", ":"), ensure_ascii=False), compresslevel=9)
                    if e is not None:
                        z.writestr("embeddings.bin", bytes(e), compresslevel=1)
                out.append(file.getvalue())
            yield pd.DataFrame({"doc_id": b["doc_id"], "archive": out})

    return parts.mapInPandas(run, "doc_id string, archive binary")


def write_archives(made: DataFrame, folder: str) -> DataFrame:
    """Writes each archive to ``folder``/doc_id.udf from the executors; (doc_id, path). The folder must be shared."""

    def run(batches):
        import os

        os.makedirs(folder, exist_ok=True)
        for b in batches:
            paths = []
            for name, data in zip(b["doc_id"], b["archive"]):
                path = os.path.join(folder, f"{name}.udf")
                with open(f"{path}.part", "wb") as f:
                    f.write(data)
                os.replace(f"{path}.part", path)  # a task that is run again leaves whole files
                paths.append(path)
            yield pd.DataFrame({"doc_id": b["doc_id"], "path": paths})

    return made.mapInPandas(run, "doc_id string, path string")


def read_archives(files: DataFrame) -> DataFrame:
    """path, manifest, catalogue, content, error of zipped archives (path, content); other versions and broken files are errors."""

    def run(batches):
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                        texts = [z.read(f"{n}.json").decode() if f"{n}.json" in z.namelist() else None for n in ("manifest", "catalogue", "content")]
                    if texts[0] is None:
                        raise ValueError("no manifest")
                    if json.loads(texts[0]).get("udf_version") != VERSION:
                        raise ValueError("unknown version")
                    rows.append((path, *texts, None))
                except (ValueError, zipfile.BadZipFile) as e:
                    rows.append((path, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "manifest", "catalogue", "content", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, manifest string, catalogue string, content string, error string")


def page(sections: DataFrame) -> DataFrame:
    """doc_id, html: a self-contained page with an outline beside the numbered sections."""
    title = escaped(F.coalesce("title", F.lit("")))
    sid = escaped(F.col("id"))
    entry = F.concat(F.lit('<a href="#'), sid, F.lit('" style="padding-left:'), ((F.col("level") - 1) * 14 + 12).cast("string"), F.lit('px">'), sid, F.lit(" "), title, F.lit("</a>"))
    tag = F.concat(F.lit("h"), F.least(F.col("level") + 1, F.lit(6)).cast("string"))
    cell = lambda name: lambda c: F.concat(F.lit(f"<{name}>"), escaped(c), F.lit(f"</{name}>"))
    row = lambda name: lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, cell(name)), ""), F.lit("</tr>"))
    grid = lambda t: F.concat(F.lit("<table><caption>"), escaped(F.coalesce(t["caption"], t["table_id"], F.lit(""))), F.lit("</caption><thead>"), row("th")(t["headers"]), F.lit("</thead><tbody>"), F.array_join(F.transform(t["rows"], row("td")), ""), F.lit("</tbody></table>"))
    text = F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.concat(F.lit("<p>"), F.replace(escaped(F.trim("text")), F.lit("\n"), F.lit("<br>")), F.lit("</p>"))).otherwise("")
    tables = F.array_join(F.transform(F.coalesce("tables", F.slice(F.col("tables"), 1, 0)), grid), "") if "tables" in sections.columns else F.lit("")
    marks = F.array_join(F.transform("keywords", cell("em")), " ") if "keywords" in sections.columns else F.lit("")
    lead = F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit('<p class="lead">'), escaped(F.col("summary")), F.lit("</p>"))).otherwise("") if "summary" in sections.columns else F.lit("")
    body = F.concat(F.lit('<section id="'), sid, F.lit('"><'), tag, F.lit(">"), sid, F.lit(" "), title, F.lit("</"), tag, F.lit(">"), lead, text, F.coalesce(tables, F.lit("")), F.coalesce(marks, F.lit("")), F.lit("</section>"))
    held = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sec_idx", entry.alias("entry"), body.alias("body")))).alias("s"))
    join = lambda name: F.array_join(F.transform("s", lambda x: x[name]), "\n")
    return held.select("doc_id", F.concat(F.lit('<!DOCTYPE html><meta charset="utf-8"><nav>'), join("entry"), F.lit("</nav><main>"), join("body"), F.lit("</main>")).alias("html"))
