"""Command line: ``python -m foliolake convert|query|inspect|stats|view|library``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model
from .functions.folder import exists
from .operators import answer, enrich, library, outline, sinks
from .sources import files


def session() -> SparkSession:
    spark = SparkSession.builder.appName("foliolake").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def convert(spark: SparkSession, source: str, out: str, glob: str | None = None) -> tuple[int, int]:
    """Reads a file or folder and writes its tables below ``out``; (documents, files that failed)."""
    raw = files.read_folder(spark, source, glob).persist()
    numbered = outline.normalise(raw)
    full = enrich.with_summaries(enrich.with_keywords(numbered)).join(outline.children(numbered), ["doc_id", "id"])
    sections = full.withColumn("embedding", F.lit(None).cast("array<float>")).select(*model.SECTIONS.names)
    meta = F.lit(None).cast(model.META)
    good = raw.where("error IS NULL")
    documents = good.groupBy("doc_id").agg(F.first("doc_title").alias("title"), F.first("source").alias("source"), F.first("format").alias("format"))
    documents = documents.select("doc_id", "title", sinks.clean_source(F.col("source")).alias("source"), "format", F.lit(None).cast("string").alias("summary"), F.lit(None).cast("array<string>").alias("insights"), meta.alias("meta"))
    sinks.write_tables(out, documents=documents, sections=sections, key_numbers=enrich.key_numbers(numbered.select("doc_id", "sec_idx", "id", "text")))
    counts = documents.count(), raw.where("error IS NOT NULL").count()
    raw.unpersist()
    return counts


def ask(spark: SparkSession, folder: str, question: str, doc_id: str | None = None) -> DataFrame:
    """Answers of all documents below ``folder``, or of one."""
    docs, sections, figures = (sinks.read_table(spark, folder, n) for n in ("documents", "sections", "key_numbers"))
    if doc_id:
        docs = docs.where(F.col("doc_id") == doc_id)
    asked = docs.select(F.lit("q").alias("qid"), "doc_id", F.lit(question).alias("question"))
    own = sections.join(docs.select("doc_id"), "doc_id", "left_semi")
    return answer.layered(asked, docs, own, figures).orderBy(F.desc("confidence"), "doc_id")


def _show(rows: DataFrame, columns: list[str]) -> None:
    for r in rows.select(*columns).toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in r))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="foliolake", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("convert", help="files or folders to tables")
    one.add_argument("source")
    one.add_argument("-o", "--output", required=True)
    one.add_argument("--glob")
    one = sub.add_parser("query", help="answers from what was converted")
    one.add_argument("folder")
    one.add_argument("question")
    one.add_argument("--doc")
    for name, text in (("inspect", "documents and their outlines"), ("stats", "counts of each document"), ("view", "an HTML page for each document")):
        one = sub.add_parser(name, help=text)
        one.add_argument("folder")
        if name == "view":
            one.add_argument("-o", "--output", required=True)
    one = sub.add_parser("library", help="a catalogue of converted folders")
    one.add_argument("action", choices=("add", "list", "search", "remove"))
    one.add_argument("root")
    one.add_argument("what", nargs="?", default="", help="a converted folder, a query, or a document")
    one.add_argument("--department", default="")
    one.add_argument("--role", default="*")
    a = p.parse_args(argv)
    spark = session()
    if a.command == "convert":
        done, failed = convert(spark, a.source, a.output, a.glob)
        print(json.dumps({"documents": done, "failed": failed}))
        return 0 if done else 1
    if a.command == "query":
        rows = ask(spark, a.folder, a.question, a.doc).collect()  # one row for each document
        for r in rows:
            print(json.dumps({"doc_id": r.doc_id, "answer": r.answer, "section": r.navigate_to, "layer": r.layer_used, "confidence": round(r.confidence, 4)}, ensure_ascii=False))
        return 0 if any(r.layer_used >= 0 for r in rows) else 1
    if a.command == "inspect":
        _show(sinks.read_table(spark, a.folder, "sections").orderBy("doc_id", "sec_idx").withColumn("line", F.concat(F.repeat(F.lit("  "), F.col("level") - 1), "id", F.lit(" "), "title")), ["doc_id", "line", "token_count"])
    elif a.command == "stats":
        totals = enrich.token_totals(sinks.read_table(spark, a.folder, "sections"))
        figures = sinks.read_table(spark, a.folder, "key_numbers").groupBy("doc_id").agg(F.count("*").alias("n_figures"))
        _show(totals.join(figures, "doc_id", "left").na.fill(0).orderBy("doc_id"), ["doc_id", "n_sections", "n_tokens", "n_figures"])
    elif a.command == "view":
        sinks.page(sinks.read_table(spark, a.folder, "sections")).write.mode("overwrite").parquet(a.output)
    else:
        path = os.path.join(a.root, "library")
        held = spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], model.LIBRARY)
        if a.action in ("add", "remove"):
            if a.action == "add":
                docs, sections = (sinks.read_table(spark, a.what, n) for n in ("documents", "sections"))
                new = library.entries(docs, sections).withColumn("path", F.lit(os.path.abspath(a.what)))
                held = library.upsert(held, new.select(*model.LIBRARY.names))
            else:
                held = library.remove(held, a.what)
            rows = held.collect()  # a catalogue has one row for each document and is replaced as a whole
            spark.createDataFrame(rows, model.LIBRARY).write.mode("overwrite").parquet(path)
            print(len(rows))
        elif a.action == "list":
            _show(library.listed(held, a.department, a.role).orderBy("doc_id"), ["doc_id", "title", "path"])
        else:
            _show(library.search(held, a.what), ["doc_id", "score", "title"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
