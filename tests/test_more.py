"""Stored index, broken files, layouts, embedders, question pipeline, command line."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliolake.functions import text as X
from foliolake.functions import vectors as V
from foliolake.operators import answer, graph, index, judge, outline, search, smart, vectors
from foliolake.sources import connectors, files, layout
from foliolake.sources.common import Parsed


def test_any_failure_is_an_error_row(spark):
    word = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"/>'
    m, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="a" r:id="x"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="x" Target="s.xml"/></R>')
        z.writestr("xl/s.xml", f'<worksheet xmlns="{m}"><row><c t="s"><v>7</v></c></row></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{m}"/>')
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("word/document.xml", word)
    deep = ("<div>" * 3000 + "<h1>Deep</h1>text" + "</div>" * 3000).encode()
    rows = [("a.docx", body.getvalue()), ("b.xlsx", book.getvalue()), ("c.html", deep), ("d.unknown", b"x"), ("e.md", b"# T\nbody")]
    got = {r.source: r for r in files.sections_of(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.docx"].error.startswith("TypeError") and got["b.xlsx"].error.startswith("IndexError")
    assert got["d.unknown"].error == "no parser takes this format" and got["d.unknown"].format is None
    assert got["c.html"].title == "Deep" and got["c.html"].text == "text" and got["e.md"].title == "T"
    assert outline.normalise(files.sections_of(spark.createDataFrame(rows, "path string, content binary"))).count() == 2


def test_preferred_parser(spark):
    files.register("other", (".md",), lambda data, path: Parsed("other"), position=99)
    try:
        assert files.find("x.md")[0] == "md"
        files.prefer("other")
        assert files.find("x.md")[0] == "other"
        with pytest.raises(ValueError):
            files.prefer("absent")
    finally:
        assert files.unregister("other")


def test_fetching_in_workers(spark):
    c = connectors.github("t", "a/b", fetch=lambda settings, name: f"# {settings['repo']} {name}".encode(), names=lambda settings: ["x.md", "y.md"])
    got = files.sections_of(c.files(spark)).orderBy("source").collect()
    assert [r.title for r in got] == ["a/b x.md", "a/b y.md"]
    with pytest.raises(connectors.ConnectorError):
        connectors.github("t", "nothing").files(spark)


def test_flat_texts_stand_in_for_scans(spark):
    s = spark.createDataFrame([("a", 0, ""), ("b", 0, "words"), ("c", 0, "")], "doc_id string, sec_idx int, text string")
    flat = spark.createDataFrame([("a", 0, "read"), ("b", 0, "no")], "doc_id string, sec_idx int, text string")
    assert {(r.doc_id, r.text) for r in layout.or_flat(s, flat).collect()} == {("a", "read"), ("b", "words"), ("c", "")}


def test_page_texts(spark):
    pages = spark.createDataFrame([(1, "short", b"i"), (2, "a text layer that is long enough", b"j"), (3, None, None)], "page int, text string, image binary")
    got = {r.page: r.text for r in layout.page_texts(pages, lambda images: ["seen"] * len(images)).collect()}
    assert got == {1: "short\nseen", 2: "a text layer that is long enough", 3: ""}

    def fails(images):
        raise RuntimeError("no engine")

    assert {r.page: r.text for r in layout.page_texts(pages, fails).collect()}[1] == "short"
    assert {r.page: r.text for r in layout.page_texts(pages).collect()}[1] == "short"


def test_embedding_in_batches(spark):
    df = spark.createDataFrame([(i, None if i == 3 else "x" * i) for i in range(10)], "i int, t string").coalesce(1)
    for size in (1, 4, 0):
        got = df.select("i", V.embedded(F.col("t"), lambda texts, size=size: np.array([[len(t), len(texts) <= (size or 99)] for t in texts]), size).alias("v")).collect()
        assert {r.i: r.v for r in got} == {i: None if i == 3 else [float(i), 1.0] for i in range(10)}


def test_matrix_forms_equal_single_ones(spark):
    rng = np.random.default_rng(1)
    rows = [(i, None if i == 2 else rng.normal(size=8 if i % 5 else 3).astype(np.float32).tolist()) for i in range(20)]
    df = spark.createDataFrame([*rows, (20, [0.0] * 8)], "i int, v array<float>")
    for mode in V.MODES:
        got = df.select("i", V.quantised(F.col("v"), mode).alias("q")).withColumn("back", V.dequantised(F.col("q"), mode, 8)).collect()
        for r, (_, v) in zip(sorted(got), rows):
            assert (r.q is None) == (v is None)
            if v is not None:
                assert bytes(r.q) == V.to_bytes(np.array(v, np.float32), mode)
                same = len(r.q) == V.stride(mode, 8)
                assert (r.back is None) == (not same)
                if same:
                    assert np.allclose(r.back, V.from_bytes(bytes(r.q), mode, 8))


def test_more_queries_than_are_sent_to_workers(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(f"d{i % 3}", i, rng.normal(size=5).tolist()) for i in range(60)], "doc_id string, sec_idx int, embedding array<double>")
    q = spark.createDataFrame([(f"q{i}", rng.normal(size=5).tolist()) for i in range(25)] + [("zero", [0.0] * 5), ("none", None)], "qid string, embedding array<double>")
    plain = lambda df: sorted((r.qid, r.rank, r.doc_id, r.sec_idx, round(r.score, 9)) for r in df.collect())
    assert plain(vectors.nearest(rows, q, 4)) == plain(vectors.nearest(rows, q, 4, most=6))


def test_stored_index_equals_live_search(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(f"d{i % 3}", i, [f"w{x}" for x in rng.zipf(1.5, rng.integers(0, 30)) if x < 40]) for i in range(60)]
    s = spark.createDataFrame(rows, "doc_id string, sec_idx int, tokens array<string>")
    q = spark.createDataFrame([("a", ["w1", "w3", "w39"]), ("b", ["w2", "none"]), ("c", [])], "qid string, tokens array<string>")
    folder = f"file://{tmp_path}/index"
    assert not index.is_stored(spark, folder)
    index.write(s, folder)
    assert index.is_stored(spark, folder)
    held = index.stored(spark, folder)
    plain = lambda df: sorted((r.qid, r.doc_id, r.sec_idx, round(r.score, 9)) for r in df.collect())
    for score in (search.bm25, search.bm25_okapi, search.tfidf):
        for own in (True, False):
            assert plain(score(s, q, per_document=own)) == plain(score(held, q, per_document=own)) != []
    assert plain(search.overlap(s, q)) == plain(search.overlap(held, q))
    index.invalidate(spark, folder)
    assert not index.is_stored(spark, folder)


def test_index_follows_its_source(spark, tmp_path):
    source, built = f"{tmp_path}/s.parquet", []

    def sections():
        built.append(1)
        return spark.read.parquet(source).select("doc_id", "sec_idx", X.terms(F.col("text")).alias("tokens"))

    q = spark.createDataFrame([("q", ["bird"])], "qid string, tokens array<string>")
    spark.createDataFrame([("d", 0, "one bird")], "doc_id string, sec_idx int, text string").coalesce(1).write.parquet(source)
    for _ in range(2):
        assert search.bm25(index.kept(spark, source, sections, "t"), q).count() == 1
    assert built == [1]
    spark.createDataFrame([("d", 0, "no such"), ("d", 1, "bird"), ("d", 2, "a bird")], "doc_id string, sec_idx int, text string").coalesce(1).write.mode("overwrite").parquet(source)
    assert search.bm25(index.kept(spark, source, sections, "t"), q).count() == 2 and built == [1, 1]


def test_expansion_by_outline_equals_the_edge_table(spark):
    rng = np.random.default_rng(7)
    rows = [("d", i, None if i < 2 else int(rng.integers(0, i))) for i in range(60)] + [("e", i, None if i == 0 else 0) for i in range(20)]
    s = spark.createDataFrame(rows, "doc_id string, sec_idx int, parent_idx int")
    seeds = spark.createDataFrame([(q, d, int(i), float(rng.random())) for q in ("a", "b") for d, n in (("d", 60), ("e", 20)) for i in rng.choice(n, 9, replace=False)], "qid string, doc_id string, sec_idx int, score double")
    plain = lambda df: sorted((r.qid, r.doc_id, r.sec_idx, round(r.score, 9)) for r in df.collect())
    assert plain(graph.expand_outline(seeds, s)) == plain(graph.expand(seeds, graph.edges(s)))
    more = spark.createDataFrame([("d", 3, 50, "semantic", 0.9)], "doc_id string, from_idx int, to_idx int, edge_type string, weight double")
    assert plain(graph.expand_outline(seeds, s, more)) == plain(graph.expand(seeds, graph.edges(s).unionByName(more)))


def test_contexts(spark):
    table = ("t", None, ["Month", "Total"], [[f"m{i}", str(i)] for i in range(35)])
    rows = [("d", i, f"§{i}", t, text, [table] if i == 1 else []) for i, (t, text) in enumerate([("Fiscal pressure", "Spending rose. " * 3), ("Totals by month", "See below."), ("References", "Fiscal pressure is cited here."), ("Other", "Nothing.")])]
    s = spark.createDataFrame(rows, "doc_id string, sec_idx int, id string, title string, text string, tables array<struct<table_id:string,caption:string,headers:array<string>,rows:array<array<string>>>>")
    q = spark.createDataFrame([("q", "What was the fiscal pressure?"), ("t", "total of month m3")], "qid string, question string")
    got = {r.qid: r for r in smart.smart_context(s, q, k=1).collect()}
    assert got["q"].top_id == "§0" and got["q"].context.startswith("[§0 — Fiscal pressure]\nSpending rose.")
    assert got["t"].top_id == "§1" and "Table (Totals by month):\nMonth | Total\nm0 | 0" in got["t"].context and "m9 | 9" in got["t"].context and "m10" not in got["t"].context
    plain = {r.qid: r for r in smart.bm25_context(s, q).collect()}
    assert plain["t"].top_id == "§1" and "m5 | 5" in plain["t"].context and "m6 |" not in plain["t"].context and plain["q"].n_tokens == len(plain["q"].context.split())


def test_sentence_counts(spark):
    sizes = [0, 5001, 10001, 20001, 30001, 50001]
    df = spark.createDataFrame([("x" * n,) for n in sizes], "t string")
    assert [r[0] for r in df.select(smart.sentence_count(F.col("t"))).collect()] == [5, 15, 25, 40, 60, 80]


def test_prompts_hold_tables(spark):
    seen = []
    s = spark.createDataFrame([("d", 0, "§1", "Rates of pay", "Some prose.", None, ["rates"], [("t", None, ["Grade", "Pay"], [["a", "10"], ["b", "20"]])])], "doc_id string, sec_idx int, id string, title string, text string, summary string, keywords array<string>, tables array<struct<table_id:string,caption:string,headers:array<string>,rows:array<array<string>>>>")
    docs = spark.createDataFrame([("d", None, None)], "doc_id string, summary string, insights array<string>")
    kn = spark.createDataFrame([], "doc_id string, ord int, label string, value string, unit string, section string")
    q = spark.createDataFrame([("q", "d", "rates zzz yyy xxx www vvv uuu")], "qid string, doc_id string, question string")
    got = answer.layered(q, docs, s, kn, provider="keyword", complete=lambda prompts: [p for p in prompts]).first()
    assert got.layer_used in (2, 4) and "Table t:\nGrade | Pay\na | 10\nb | 20" in got.answer
    assert seen == []


def test_report_files(spark, tmp_path):
    e = spark.createDataFrame([("a", 8, 10, 1.0), ("a", 5, 10, 3.0)], "doc string, score int, tokens int, ms double")
    r = judge.report(e, ["doc"])
    judge.write_reports(spark, f"{tmp_path}/out", byDoc=r)
    text = "\n".join(x.value for x in spark.read.text(f"{tmp_path}/out/byDoc.md").collect())
    assert "| a | 2 | 6.500 | 0.500 | 20 | 2.000 |" in text and spark.read.json(f"{tmp_path}/out/byDoc").count() == 1


def test_command_line(spark, tmp_path, capsys):
    from foliolake import __main__ as cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "report.md").write_text("# Annual report\nIntro words.\n\n## Revenue of regions\nRevenue: $12 million was the total revenue of all regions in the year.\n")
    (tmp_path / "in" / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "in" / "skip.xyz").write_text("x")
    cli_session, cli.session = cli.session, lambda: spark
    try:
        assert cli.main(["convert", str(tmp_path / "in"), "-o", str(tmp_path / "out")]) == 0
        assert json.loads(capsys.readouterr().out) == {"documents": 1, "failed": 1}
        assert cli.main(["query", str(tmp_path / "out"), "what is the revenue"]) == 0
        got = json.loads(capsys.readouterr().out)
        assert got["layer"] == 0 and "$12 million" in got["answer"]
        cli.main(["inspect", str(tmp_path / "out")])
        assert "§1.1 Revenue of regions" in capsys.readouterr().out
        cli.main(["stats", str(tmp_path / "out")])
        assert capsys.readouterr().out.split("\t")[:2] == ["report", "2"]
        cli.main(["view", str(tmp_path / "out"), "-o", str(tmp_path / "pages")])
        assert "Revenue" in spark.read.parquet(str(tmp_path / "pages")).first().html
        for args in (["add", str(tmp_path), str(tmp_path / "out")], ["list", str(tmp_path)], ["search", str(tmp_path), "annual"], ["remove", str(tmp_path), "report"]):
            assert cli.main(["library", *args]) == 0
        out = capsys.readouterr().out.splitlines()
        assert out[0] == "1" and out[1].startswith("report\t") and out[2].startswith("report\t1.0") and out[3] == "0"
    finally:
        cli.session = cli_session
