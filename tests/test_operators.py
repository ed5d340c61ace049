import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliolake.functions import stemming, vectors as V
from foliolake.functions import text as X
from foliolake.operators import answer, chunks, enrich, graph, index, judge, library, outline, search, sinks, tables, vectors


def column(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(f(F.col("v"))).collect()]


@pytest.mark.parametrize("cell, want", [("-12.5", -12.5), ("12 550", 12550), ("9.31 billion", 9.31e9), ("38.7k", 38700), ("$4,050", 4050), (" 142ms", 142), ("5.8x", 5.8), ("7,654.32", 7654.32), ("99.97%", 99.97), ("210 million", 2.1e8), ("23,400", 23400), ("3 thousand 2", 3000), ("", None), ("  ", None), ("N/A", None), ("—", None), ("-", None), ("TBD", None), ("hello", None), (None, None)])
def test_parsed_number(spark, cell, want):
    got = column(spark, [cell], X.parsed_number)[0]
    assert got == want if want is None else got == pytest.approx(want)


def test_tokens(spark):
    assert column(spark, ["The Café-9 is  ab_c!"], X.terms)[0] == ["the", "caf", "-9", "is", "ab"]
    assert column(spark, ["Boss runs cars gas"], X.singular_tokens)[0] == ["boss", "run", "car", "gas"]
    assert column(spark, ["", None], X.words) == [[], []]
    assert column(spark, ["One sentence here now. Short. Another longer sentence!  "], X.sentences)[0] == ["One sentence here now.", "Another longer sentence!"]
    assert column(spark, ["ok ```json\n[1]\n``` x", 'say {"a": 1} now', " none "], X.json_block) == ["[1]", '{"a": 1}', "none"]
    assert column(spark, ["foo_bar2baz"], X.file_title)[0] == "Foo Bar2Baz"


@pytest.mark.parametrize("levels, want", [([1, 1, 1], "§1 §2 §3"), ([1, 2, 2, 1, 2], "§1 §1.1 §1.2 §2 §2.1"), ([1, 2, 3, 4, 5, 6], "§1 §1.1 §1.1.1 §1.1.1.1 §1.1.1.1.1 §1.1.1.1.1.1"), ([1, 3], "§1 §1.1"), ([1, 6], "§1 §1.1"), ([1, 4, 2], "§1 §1.1 §1.2"), ([1, 3, 2, 3], "§1 §1.1 §1.2 §1.2.1"), ([1, 5, 3], "§1 §1.1 §1.2"), ([1, 3, 3], "§1 §1.1 §1.2")])
def test_section_ids(spark, levels, want):
    df = spark.createDataFrame([("d", i, n) for i, n in enumerate(levels)], "doc_id string, sec_idx int, level int")
    assert " ".join(r.id for r in outline.number(df).orderBy("sec_idx").collect()) == want


def test_section_ids_against_a_stack(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for d in range(60):
        stack, used = [], {}
        for i in range(rng.randint(1, 25)):
            level = rng.randint(1, 6)
            while stack and stack[-1][0] >= level:
                stack.pop()
            up = stack[-1][1] if stack else ""
            used[up] = used.get(up, 0) + 1
            path = f"{up}.{used[up]}" if up else str(used[up])
            stack.append((level, path))
            rows.append((str(d), i, level))
            want[str(d), i] = "§" + path
    df = spark.createDataFrame(rows, "doc_id string, sec_idx int, level int")
    assert {(r.doc_id, r.sec_idx): r.id for r in outline.number(df).collect()} == want


TEXT = "## Numbers\n* Avg response time 142ms (from 310ms)\n* **Uptime:** 99.97% (target: 99.9%)\n* 14 of 14 moved\n* **Cost savings:** $4,050 a month\n"


def test_figures():
    found = {(a.lower(), b): c for a, b, c in enrich.figures(TEXT)}
    assert ("uptime", "99.97%") in found and found["uptime", "99.97%"] == "%"
    assert found["cost savings", "$4,050"] == "USD"
    assert any(v == "142ms" for _, v in found)
    assert enrich.figures("1. First point\n2) Second\nISO 27001 and AZ-204 in 2025") == []
    assert enrich.figures(None) == []


def test_key_numbers_are_cut_in_order(spark):
    s = spark.createDataFrame([("d", i, f"§{i}", "Total sales: 5 then 6 then 7") for i in range(40)], "doc_id string, sec_idx int, id string, text string")
    got = enrich.key_numbers(s).orderBy("ord").collect()
    assert len(got) == 64 and got[0].section == "§0" and got[-1].ord == 64


def test_keywords(spark):
    df = spark.createDataFrame([("alpha beta beta gamma-ray the alpha beta", "Beta plan")], "text string, title string")
    got = df.select(enrich.keywords(F.col("text"), F.col("title"), 4)).first()[0]
    assert got[:2] == ["beta", "plan"] and set(got[2:]) == {"alpha", "gamma-ray"} and got[2] == "alpha"


@given(st.text(alphabet=st.sampled_from("ab .!?\n"), max_size=400), st.integers(1, 60), st.integers(0, 40))
@settings(max_examples=150, deadline=None)
def test_passages_fit_and_keep_everything(text, size, overlap):
    out = chunks.passages(text, size, overlap)
    assert all(0 < len(p) <= size for p in out)
    if overlap == 0:
        assert "".join("".join(out).split()) == "".join(text.split())


def test_passages():
    assert chunks.passages("", 10) == [] and chunks.passages(None) == []
    assert len(chunks.passages("x" * 5000, 1000, 0)) == 5


REVENUE = (["Product", "Q1", "Annual Total"], [["A", "4200", "23,400"], ["B", "3100", "12,550"], ["C", "1800", "7,600"], ["D", "2500", "9,000"], ["E", "950", "4,000"]])
ACCOUNTS = (["Client", "Tier", "ARR (USD thousands)", "Region"], [["a", "Enterprise", "2400", "North America"], ["b", "Enterprise", "2200", "Europe"], ["c", "Growth", "1200", "South America"], ["d", "Enterprise", "3000", "Asia"], ["e", "Start", "300", "Europe"]])


def cells(spark, headers, rows):
    data = [("d", "s", "t", i, j, h, r[j] if j < len(r) else "") for i, r in enumerate(rows) for j, h in enumerate(headers)]
    return spark.createDataFrame(data, "doc_id string, section_id string, table_id string, row_idx int, col_idx int, header string, cell string")


@pytest.mark.parametrize("table, args, value, n", [
    (REVENUE, ("sum", "Q1"), 12550, 5), (REVENUE, ("max", "annual total"), 23400, 5), (REVENUE, ("COUNT", "Q1"), 5, 5), (REVENUE, ("avg", "Q1"), 2510, 5),
    (ACCOUNTS, ("sum", "ARR", ("Tier", "eq", "Enterprise")), 7600, 3), (ACCOUNTS, ("count", "ARR", ("Region", "contains", "America")), 2, 2), (ACCOUNTS, ("sum", "ARR", ("ARR", "gt", 2300)), 5400, 2),
])
def test_aggregate(spark, table, args, value, n):
    r = tables.aggregate(cells(spark, *table), *args).first()
    assert (r.ok, r.value, r.n_rows) == (True, value, n)


def test_aggregate_fails_closed(spark):
    long = cells(spark, ["V"], [["pending"], ["20"], ["10"], ["n/a"]])
    r = tables.aggregate(long, "sum", "V").first()
    assert (r.value, r.n_rows, r.skipped) == (30, 2, 2)
    for args in (("median", "V"), ("sum", "EBITDA"), ("sum", "V", ("Nope", "eq", "x")), ("sum", "V", ("V", "eq", "nothing"))):
        assert not tables.aggregate(long, *args).first().ok
    ragged = tables.aggregate(cells(spark, ["A", "B"], [["3"], ["1", "2"]]), "sum", "A").first()
    assert ragged.value == 4
    assert tables.aggregate(long, "count", "V", ("V", "eq", "nothing")).first().value == 0


def test_cells_of_sections(spark):
    from foliolake import model

    row = ("d", "T", "p", "md", 0, "t", 1, "x", [("t1", None, ["A", "B"], [["1"], ["2", "3"]])], [], None)
    s = outline.normalise(spark.createDataFrame([row], model.RAW_SECTIONS))
    assert [(r.row_idx, r.header, r.cell) for r in tables.cells(s).orderBy("row_idx", "col_idx").collect()] == [(0, "A", "1"), (0, "B", ""), (1, "A", "2"), (1, "B", "3")]


def test_quantiser():
    v = np.array([0.5, -1.0, 0.25, 0.0, 2.0, -0.1, 0.3, 0.9, 1.0], np.float32)
    for mode, size in (("float32", 36), ("float16", 18), ("int8", 9), ("binary", 2)):
        data = V.to_bytes(v, mode)
        assert len(data) == size == V.stride(mode, 9)
        back = V.from_bytes(data, mode, 9)
        assert len(back) == 9 and np.dot(back, v) / np.linalg.norm(back) / np.linalg.norm(v) > (0.7 if mode == "binary" else 0.99)
    assert np.array_equal(V.from_bytes(V.to_bytes(v, "binary"), "binary", 9) > 0, v > 0)
    with pytest.raises(ValueError):
        V.to_bytes(v, "int4")


def test_nearest_and_zero_vectors(spark):
    rows = spark.createDataFrame([("d", 0, [1.0, 0.0]), ("d", 1, [0.0, 1.0]), ("d", 2, [0.0, 0.0]), ("d", 3, None)], "doc_id string, sec_idx int, embedding array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("z", [0.0, 0.0])], "qid string, embedding array<float>")
    assert [(r.qid, r.sec_idx, round(r.score, 6)) for r in vectors.nearest(rows, q, 3).orderBy("rank").collect()] == [("q", 0, 1.0), ("q", 1, 0.5), ("q", 2, 0.5)]


def brute_pairs(rows, threshold):
    """Ordered pairs of one document with their cosine."""
    return {(d, i, j): c for d, i, x in rows for e, j, y in rows if d == e and i != j and (c := np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)) >= threshold}


def test_similar_pairs_cross_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(d, i, rng.normal(size=6).astype(np.float32).tolist()) for d, n in (("a", 90), ("b", 7), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame([*rows, ("a", 900, [0.0] * 6), ("a", 901, None)], "doc_id string, sec_idx long, embedding array<float>")
    want = brute_pairs(rows, 0.3)
    for block in (10, 40, 1000):
        got = vectors.similar_pairs(df, 0.3, most=None, block=block).collect()
        assert len(got) == len(want) and all(r.weight == pytest.approx(want[r.doc_id, r.from_idx, r.to_idx]) for r in got)


def test_large_documents_keep_semantic_edges(spark):
    levels = spark.createDataFrame([("d", 0, None)], "doc_id string, sec_idx int, parent_idx int")
    v = spark.createDataFrame([("d", i, [1.0, 0.0] if i in (3, 1000) else [0.0, (-1.0) ** i]) for i in range(1001)], "doc_id string, sec_idx int, embedding array<float>")
    got = graph.edges(levels, v).where("from_idx IN (3, 1000)").collect()
    assert sorted((r.from_idx, r.to_idx, r.edge_type, r.weight) for r in got) == [(3, 1000, "semantic", 1.0), (1000, 3, "semantic", 1.0)]
    assert graph.edges(levels, v, most=1000).count() == 0


def test_semantic_edges_by_label_cross_identifiers(spark, data):
    from foliolake import plans

    t = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    got = plans.queries()["semantic_edges"](spark, data).collect()
    assert {(r.from_idx, r.to_idx) for r in got} == {k[1:] for k in brute_pairs([(r.label, r.vec_id, r.embedding) for r in t], 0.3)}
    assert any(r.from_idx // 100 != r.to_idx // 100 for r in got)


def test_bm25_prefers_rare_terms(spark):
    s = spark.createDataFrame([("d", i, t.split()) for i, t in enumerate(["cat dog", "cat cat", "cat bird", "cat fish"])], "doc_id string, sec_idx int, tokens array<string>")
    q = spark.createDataFrame([("q", ["cat", "bird"])], "qid string, tokens array<string>")
    for f in (search.bm25, search.bm25_okapi, search.tfidf, search.overlap):
        assert search.top_k(f(s, q), 1).first().sec_idx == 2
    assert search.bm25(s, spark.createDataFrame([("q", ["zebra"])], "qid string, tokens array<string>")).count() == 0
    with pytest.raises(ValueError):
        search.provider("other")


def test_graph(spark):
    levels = spark.createDataFrame([("d", i, n) for i, n in enumerate([1, 2, 2, 1])], "doc_id string, sec_idx int, level int")
    e = graph.edges(outline.number(levels)).cache()
    assert sorted((r.from_idx, r.to_idx, r.edge_type, r.weight) for r in e.collect()) == sorted([(0, 1, "child", 1.0), (0, 2, "child", 1.0), (1, 0, "parent", 1.0), (2, 0, "parent", 1.0), (1, 2, "sibling", 0.8), (2, 1, "sibling", 0.8)])
    seeds = spark.createDataFrame([("q", "d", 1, 1.0), ("q", "d", 0, 2.0)], "qid string, doc_id string, sec_idx int, score double")
    assert {r.sec_idx: round(r.score, 6) for r in graph.expand(seeds, e).collect()} == {0: 2.0, 1: 1.3, 2: 0.38}


def test_best_sentences(spark):
    t = "Nothing useful is here. About 87% of critical user journeys were covered. The rest was moved to spring."
    f = lambda q, n=1: spark.createDataFrame([(t, q)], "t string, q string").select(answer.best_sentences(F.col("t"), F.col("q"), n)).first()[0]
    assert "87%" in f("how many critical journeys") and f("zebra quantum") == "" and f("") == ""


def layered(spark, **kw):
    sections = spark.createDataFrame([("d", 0, "§1", "Budget", "The budget of the project rose sharply in May. More text follows here.", None, ["budget"]), ("d", 1, "§2", "Team", "The team has nine members in two towns.", "Nine members.", ["team"]), ("d", 2, "§3", "Dates", "Everything starts in March.", None, ["dates"]), ("d", 3, "§4", "Risks", "Rain may delay the work.", None, ["risks"])], "doc_id string, sec_idx int, id string, title string, text string, summary string, keywords array<string>")
    docs = spark.createDataFrame([("d", "A project.", ["one", "two"])], "doc_id string, summary string, insights array<string>")
    kn = spark.createDataFrame([("d", 1, "Head count", "9", None, "§2"), ("d", 2, "Price", "1", None, "§1"), ("d", 3, "Price", "2", None, "§1")], "doc_id string, ord int, label string, value string, unit string, section string")
    q = spark.createDataFrame([(f"q{i}", "d", t) for i, t in enumerate(["what is this about", "key insights?", "what is the head count", "what is the price", "how did the budget change", "who is in the team", "zebra"])], "qid string, doc_id string, question string")
    return {r.qid: r for r in answer.layered(q, docs, sections, kn, **kw).collect()}


def test_layers(spark):
    got = layered(spark)
    assert len(got) == 7
    assert (got["q0"].layer_used, got["q0"].answer) == (0, "A project.")
    assert got["q1"].answer == "• one\n• two"
    assert got["q2"].answer == "Head count: 9 (source: §2)"
    assert got["q3"].layer_used == -1  # two prices: nothing is guessed
    assert (got["q4"].layer_used, got["q4"].citations) == (1, ["§1"]) and "budget" in got["q4"].answer
    assert got["q5"].answer == "Nine members."
    assert got["q6"].layer_used == -1 and got["q6"].answer == ""


def test_layers_with_a_model(spark):
    got = layered(spark, complete=lambda prompts: [f"reply {len(p) > 0}" for p in prompts])
    assert got["q6"].layer_used == 4 and got["q6"].answer == "reply True" and got["q6"].tokens_used > 5

    def fails(prompts):
        raise RuntimeError("down")

    assert layered(spark, complete=fails)["q6"].answer == "[model error: down]"


@pytest.mark.parametrize("cand, ref, want", [("The total is 12,550.", "4200 + 3100 = 12550 total", 9), ("Not found in context", "12", 0), ("Paris is the capital", "the capital is Paris", 10), ("banana", "the capital is Paris", 0), ("about 100 units sold", "103 units sold", 10)])
def test_judge(spark, cand, ref, want):
    assert spark.createDataFrame([(cand, ref)], "c string, r string").select(judge.score(F.col("c"), F.col("r"))).first()[0] == want


def test_library(spark):
    schema = "doc_id string, title string, owner string, department string, tags array<string>, access_roles array<string>, summary string, keywords array<string>"
    lib = spark.createDataFrame([("a", "Cost report", "Ann", "Sales", ["two words"], ["*"], "", ["cost"]), ("b", "Plan", "Bob", "Ops", [], ["hr"], "cost plan", None)], schema)
    assert [r.doc_id for r in library.listed(lib, role="it").collect()] == ["a"]
    assert [(r.doc_id, r.score) for r in library.search(lib, "cost report two").orderBy("rank").collect()] == [("a", pytest.approx(2 / 3)), ("b", pytest.approx(1 / 3))]
    new = lib.where("doc_id = 'a'").withColumn("title", F.lit("New"))
    assert sorted((r.doc_id, r.title) for r in library.upsert(lib, new).collect()) == [("a", "New"), ("b", "Plan")]
    assert library.remove(lib, "a").count() == 1 and library.get(lib, "b").first().owner == "Bob"


def test_fingerprints(spark):
    f = lambda text: index.fingerprints(spark.createDataFrame([("d", 0, "§1", text)], "doc_id string, sec_idx int, id string, text string"))
    a, same, other = (f(t).first().hash for t in ("x" * 300, "x" * 299 + "y", "y" * 300))
    assert a == same != other  # only the length counts beyond 200 characters
    assert index.stale(f("new"), f("old")).count() == 1 and index.stale(f("x"), f("x")).count() == 0


def test_changes_behind_the_head_are_stale(spark):
    f = lambda text: index.whole_fingerprints(spark.createDataFrame([("d", 0, "§1", text), ("e", 0, "§1", None)], "doc_id string, sec_idx int, id string, text string"))
    assert [r.doc_id for r in index.stale(f("x" * 300), f("x" * 299 + "y")).collect()] == ["d"]
    assert index.stale(f("x" * 300), f("x" * 300)).count() == 0


def test_archives_round_trip(spark, tmp_path):
    import json

    docs = spark.createDataFrame([("d", "T", "/home/me/d.md", "md", "sum", ["i"], None)], "doc_id string, title string, source string, format string, summary string, insights array<string>, meta struct<owner:string,department:string,tags:array<string>,access_roles:array<string>,version:string,last_updated:string>")
    s = spark.createDataFrame([("d", 0, "§1", "A & B", 1, None, [], 2, "s", ["k"], "line <1>\nline 2", [("t", "cap", ["h"], [["c"]])], [], [1.0, 0.0])], "doc_id string, sec_idx int, id string, title string, level int, parent_id string, children array<string>, token_count int, summary string, keywords array<string>, text string, tables array<struct<table_id:string,caption:string,headers:array<string>,rows:array<array<string>>>>, images array<struct<image_id:string,alt:string,asset_path:string>>, embedding array<float>")
    kn = spark.createDataFrame([("d", 1, "Count", "42", None, "§1")], "doc_id string, ord int, label string, value string, unit string, section string")
    made = sinks.archives(docs, s, kn, "float16", 2)
    paths = sinks.write_archives(made, str(tmp_path / "out")).collect()
    back = sinks.read_archives(spark.read.format("binaryFile").load(paths[0].path)).first()
    assert back.error is None and json.loads(back.manifest)["section_count"] == 1
    cat = json.loads(back.catalogue)
    assert cat["source"] == "d.md" and cat["key_numbers"][0]["value"] == "42" and "text" not in cat["section_index"][0]
    assert json.loads(back.content)["§1"]["tables"][0]["rows"] == [["c"]]
    broken = spark.createDataFrame([("x", b"no zip")], "path string, content binary")
    assert sinks.read_archives(broken).first().error
    page = sinks.page(s).first().html
    assert "A &amp; B" in page and "line &lt;1&gt;<br>line 2" in page and "padding-left:12px" in page
    blob = sinks.embedding_blob(s, "float16", 2).first().blob
    assert [v.tolist() for v in sinks.blob_vectors(blob, "float16", 2)] == [[1.0, 0.0]]


def test_clean_source(spark):
    assert column(spark, ["/a/b.md", "C:\\x\\y.md", "https://e.org/p", "", "///"], sinks.clean_source) == ["b.md", "y.md", "https://e.org/p", "", "///"]


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sized", "size"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("rational", "ration"), ("digitizer", "digit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopeful", "hope"), ("revival", "reviv"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"), ("sky", "sky")])
def test_stem(word, stem):
    assert stemming.stem(word) == stem


def test_summaries(spark):
    s = spark.createDataFrame([("Short", "few words"), ("Long", "word " * 30)], "title string, text string")
    assert [r.summary for r in enrich.with_summaries(s).collect()] == ["Short", None]
    assert [r.summary for r in enrich.with_summaries(s, lambda ps: ["made"] * len(ps)).collect()] == ["Short", "made"]


def test_streaming(spark, tmp_path):
    from foliolake.streaming.ingest import follow, latest

    (tmp_path / "in").mkdir()
    run = lambda: follow(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    (tmp_path / "in" / "a.md").write_text("# A\nx")
    run()
    (tmp_path / "in" / "b.md").write_text("# B\nx\n## C\ny")
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.id) for r in latest(got).collect()) == [("a", "§1"), ("b", "§1"), ("b", "§1.1")]
