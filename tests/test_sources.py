import io
import zipfile

import pytest

from foliolake.operators import outline
from foliolake.sources import connectors, delimited, files, html, markdown, pdf_spans, word, workbook
from foliolake.sources.common import SourceError, identifier, title_of


def test_names():
    assert identifier("/a/QuarterlyReport2024 final.md") == "quarterly-report-2024-final"
    assert title_of("/a/quarterly_report-q1.csv") == "Quarterly Report Q1"
    assert title_of("/a/AnnualReport2024.pdf", camel=True) == "Annual Report 2024"


MD = "lead\n\n# One\ntext a\n```\n# not a heading\n```\n## Two ##\n\nb\n# Three\n"


def test_markdown():
    p = markdown.parse(MD.encode(), "/x/my-file.md")
    assert p.title == "One"
    assert [(s["title"], s["level"]) for s in p.sections] == [("My File", 1), ("One", 1), ("Two ##", 2), ("Three", 1)]
    assert p.sections[1]["text"] == "text a\n```\n# not a heading\n```"
    assert [(s["title"], s["text"]) for s in markdown.parse(b"", "/x/e.md").sections] == [("e", "")]
    assert [s["title"] for s in markdown.parse(b"only text", "/x/e.md").sections] == ["e"]


def test_markdown_plan_equals_parser(spark):
    df = spark.createDataFrame([("d", MD), ("e", None)], "doc_id string, text string")
    rows = sorted((r.sec_idx, r.title, r.level, r.text) for r in markdown.sections(df).collect())
    want = [(i, None if i == 0 else s["title"], s["level"], s["text"]) for i, s in enumerate(markdown.parse(MD.encode(), "/x/d.md").sections)]
    assert rows == want


def test_html_spans_and_siblings():
    page = b"""<html><head><title>T</title><script>var x = "</p>";</script></head><body><p>dropped</p><h1>A <b>b</b></h1>loose<!-- no --><p>one<p>two
    <table><caption>C</caption><tr><th>Group</th><th colspan=2>Item</th></tr><tr><td rowspan="2">Nord</td><td>ink</td><td>1</td></tr><tr><td>pen</td><td>20</td></tr><tr><td></td><td> </td><td></td></tr></table>
    <h2>B</h2><ul><li>i<li>j</ul></body></html>"""
    p = html.parse(page, "f.html")
    assert p.title == "T"
    assert [(s["title"], s["level"], s["text"]) for s in p.sections] == [("A b", 1, "loose one two"), ("B", 2, "i j")]
    t = p.sections[0]["tables"][0]
    assert t["headers"] == ["Group", "Item", "Item"] and t["caption"] == "C"
    assert t["rows"] == [["Nord", "ink", "1"], ["Nord", "pen", "20"]]
    assert html.parse(b"<p>plain</p>", "f.html").sections[0]["title"] == "Document"


def test_delimited():
    p = delimited.parse("\ufeffName;Qty;\nä;1;\n\n;;\nb;2;3\nc;4;\n".encode(), "/x/stock.csv")
    t = p.sections[0]["tables"][0]
    assert (t["headers"], t["rows"]) == (["Name", "Qty"], [["ä", "1"], ["b", "2"], ["c", "4"]])
    assert p.sections[0]["text"].startswith("File: stock\nColumns: Name, Qty\nData:\nä | 1")
    with pytest.raises(SourceError):
        delimited.parse(b" \n", "e.csv")


def test_split_tables():
    rows = [["Report", "", ""], ["Region", "Q1", "Q2"], ["South", "80", "9.5"], ["Team", "Lead", "Since"], ["A", "Bo", "1990"]]
    assert [h for h, _ in workbook.split_tables(rows)] == [["Region", "Q1", "Q2"], ["Team", "Lead", "Since"]]
    text = [["Name", "Town"], ["Alice", "NYC"], ["Bob", "LA"]]
    assert len(workbook.split_tables(text)) == 1




def book():
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S1" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>Name</t></si><si><t>Qty</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {m}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {m}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>When</t></is></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>ink</t></is></c><c r="B2"><v>2.5</v></c><c r="C2" t="b"><v>1</v></c><c r="D2" s="1"><v>45292</v></c></row></sheetData></worksheet>')
    return f.getvalue()


def doc():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, style="", bold="": f'<w:p><w:pPr>{f"<w:pStyle w:val={style!r}/>" if style else ""}</w:pPr><w:r><w:rPr>{bold}</w:rPr><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t, extra="": f"<w:tc><w:tcPr>{extra}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    span, top, down = '<w:gridSpan w:val="2"/>', '<w:vMerge w:val="restart"/>', "<w:vMerge/>"
    table = f"<w:tbl><w:tr>{cell('G')}{cell('Sales', span)}</w:tr><w:tr>{cell('Acme', top)}{cell('10')}{cell('10')}</w:tr><w:tr>{cell('', down)}{cell('3')}{cell('4')}</w:tr></w:tbl>"
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="L"><w:name w:val="List Bullet"/></w:style></w:styles>')
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('before')}{p('Top', 'H1')}{p('body')}{p('item', 'L')}{p('DETAILS')}{table}{p('Bold line', '', '<w:b/>')}{p('x')}</w:body></w:document>")
    return f.getvalue()


def test_workbook():
    t = workbook.parse(book(), "/x/b.xlsx").sections[0]["tables"][0]
    assert t["headers"] == ["Name", "Qty", "", "When"]
    assert t["rows"] == [["ink", "2.5", "True", "2024-01-01 00:00:00"]]
    for data, name in ((b"", "a.xls"), (b"zip?", "a.xlsx")):
        with pytest.raises(SourceError):
            workbook.parse(data, name)


def test_word():
    p = word.parse(doc(), "/x/d.docx")
    assert p.title == "Top"
    assert [(s["title"], s["level"], s["text"]) for s in p.sections] == [("Introduction", 1, "before"), ("Top", 1, "body\n\n- item"), ("DETAILS", 1, ""), ("Bold line", 1, "x")]
    t = p.sections[2]["tables"][0]
    assert (t["headers"], t["rows"]) == (["G", "Sales", "Sales"], [["Acme", "10", "10"], ["Acme", "3", "4"]])


def test_folder_to_numbered_sections(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("# A\nx\n#### B\ny")
    (tmp_path / "in" / "deep" / "b.csv").write_text("k,v\na,1\n")
    (tmp_path / "in" / "c.docx").write_bytes(b"broken")
    (tmp_path / "in" / "d.bin").write_bytes(b"?")
    raw = files.read_folder(spark, str(tmp_path / "in")).cache()
    assert [(r.doc_id, r.error is not None) for r in raw.where("error IS NOT NULL").collect()] == [("c", True)]
    got = sorted((r.doc_id, r.id, r.title) for r in outline.normalise(raw).collect())
    assert got == [("a", "§1", "A"), ("a", "§1.1", "B"), ("b", "§1", "B")]


def test_registry():
    files.register("txt", (".txt",), lambda data, path: markdown.parse(data, path))
    assert files.find("A.TXT")[0] == "txt" and ".txt" in files.supported()
    assert files.unregister("txt") and not files.unregister("txt") and files.find("a.txt") is None


def test_spans_outside_tables(spark):
    s = spark.createDataFrame([("d", 1, 0.0, 0.0, 2.0, 2.0, "in"), ("d", 1, 8.0, 8.0, 9.0, 9.0, "out")], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string")
    b = spark.createDataFrame([("d", 1, 0.0, 0.0, 5.0, 5.0)], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double")
    assert [r.text for r in pdf_spans.outside_tables(s, b).collect()] == ["out"]


def test_connectors(spark):
    assert not connectors.github("t", "norepo").validate() and connectors.github("t", "o/r").validate()
    with pytest.raises(connectors.ConnectorError):
        connectors.notion("t", "p").files(spark)
    rows = connectors.jira("u", "t", "k", fetch=lambda s: [("a.md", b"# X")]).files(spark)
    assert [r.title for r in files.sections_of(rows).collect()] == ["X"]
