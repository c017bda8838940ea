"""Spreadsheets, documents, archives, résumé texts and the classifier on made input."""

import io
import zipfile

import numpy as np
from pyspark.sql import functions as F

from lodestar.functions import resume
from lodestar.operators import classifier
from lodestar.sources import files


def packed(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def test_sheets_and_documents(spark):
    sheet = '<worksheet xmlns="m"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1"><v>4.5</v></c></row><row r="3"><c r="B3" t="inlineStr"><is><t>in</t></is></c><c r="C3"/></row></sheetData></worksheet>'
    book = packed(xl__sharedStrings_xml='<sst xmlns="m"><si><r><t>sha</t></r><r><t>red</t></r></si></sst>', xl__worksheets__sheet1_xml=sheet, xl__worksheets__sheet10_xml='<worksheet xmlns="m"><c r="A1"><v>9</v></c></worksheet>')
    word = packed(word__document_xml='<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>')
    df = spark.createDataFrame([("a", bytearray(book)), ("b", bytearray(b"no zip")), ("c", None)], "path string, content binary")
    got = sorted((r.path, r.table, r.row, r.col, r.value) for r in files.cells_of(df, "path", "content", files.sheet_cells).collect())
    assert got == [("a", 0, 0, 0, "shared"), ("a", 0, 0, 27, "4.5"), ("a", 0, 2, 1, "in"), ("a", 1, 0, 0, "9")]
    docs = spark.createDataFrame([("a", bytearray(word)), ("b", bytearray(b"")), ("c", bytearray(book))], "path string, content binary")
    assert {r.path: r.text for r in files.texts_of(docs, "path", "content").collect()} == {"a": "one\ttwo\nthree", "b": None, "c": None}


def test_tables_of_pages():
    page = "<table><tr><th>a<th colspan=2> b  c <tr><td>1<br>2</td><td></td></table>x<table><tr><td>z"
    assert list(files.html_cells(page)) == [(0, 0, 0, "a"), (0, 0, 1, "b c"), (0, 0, 2, "b c"), (0, 1, 0, "1\n2"), (0, 1, 1, ""), (1, 0, 0, "z")]


def grid(page, table=0):
    cells = {(r, c): v for t, r, c, v in files.html_cells(page) if t == table}
    return [[cells.get((r, c)) for c in range(1 + max(c for _, c in cells))] for r in range(1 + max(r for r, _ in cells))]


def test_cells_that_span_rows():
    assert grid("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == [["a", "b"], ["a", "c"]]
    assert grid("<table><tr><td>p<td rowspan=2 colspan=2>q<td>r<tr><td>s<td>t<tr><td>u</table>") == [["p", "q", "q", "r"], ["s", "q", "q", "t"], ["u", None, None, None]]
    # A span ends with the table; 0 is for all rows that follow; what is no number counts as 1.
    assert grid("<table><tr><td rowspan=9>a<td rowspan=0>z<td colspan=x>b<tr><td colspan=0>c</table>") == [["a", "z", "b"], ["a", "z", "c"]]
    # Rows that end early, and a row that has nothing of its own.
    assert grid("<table><tr><td>a<td rowspan=3>b<td>c<tr><tr><td>d<td>e</table>") == [["a", "b", "c"], [None, "b", None], ["d", "b", "e"]]
    # A cell that would lie over one from above keeps its own place free of it: the upper one's value stays.
    assert grid("<table><tr><td>a<td>b<td rowspan=2>c<tr><td colspan=3>d</table>") == [["a", "b", "c"], ["d", "d", "c"]]


def test_tables_within_cells():
    page = "<table><tr><td>out<table><tr><td rowspan=2>in 1<td>in 2<tr><td>in 3</table>side<td>next<tr><td>last</table>"
    assert grid(page) == [["outside", "next"], ["last", None]] and grid(page, 1) == [["in 1", "in 2"], ["in 1", "in 3"]]
    assert len(list(files.html_cells("<table><tr><td rowspan=65534 colspan=1000>x</table>"))) == 1000


def test_merged_cells_and_dates_of_sheets():
    rows = '<row r="1"><c r="A1" t="inlineStr"><is><t>m</t></is></c><c r="C1" s="1"><v>45383</v></c><c r="D1" s="2"><v>45383.5</v></c><c r="E1" s="3"><v>0.25</v></c><c r="F1" s="4"><v>45383</v></c></row><row r="4"><c r="B4" s="0"><v>45383</v></c><c r="C4" t="b"><v>1</v></c></row>'
    sheet = f'<worksheet xmlns="m"><sheetData>{rows}</sheetData><mergeCells><mergeCell ref="A1:B2"/><mergeCell ref="D1:D1048576"/><mergeCell ref="G7:H8"/></mergeCells></worksheet>'
    styles = '<styleSheet xmlns="m"><numFmts><numFmt numFmtId="164" formatCode="yyyy&quot;年&quot;m&quot;月&quot;"/><numFmt numFmtId="165" formatCode="[Red]0&quot;days&quot;"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="20"/><xf numFmtId="165"/></cellXfs></styleSheet>'
    cells = {(r, c): v for _, r, c, v in files.sheet_cells(packed(xl__worksheets__sheet1_xml=sheet, xl__styles_xml=styles))}
    assert [cells.get((r, c)) for r in range(3) for c in (0, 1)] == ["m", "m", "m", "m", None, None]
    assert [cells[0, c] for c in range(2, 6)] == ["2024-04-01", "2024-04-01 12:00:00", "06:00:00", "45383"]
    assert [cells[r, 3] for r in (1, 2, 3)] == ["2024-04-01 12:00:00"] * 3 and cells[3, 1] == "45383" and max(r for r, _ in cells) == 3
    later = packed(xl__worksheets__sheet1_xml=sheet, xl__styles_xml=styles, xl__workbook_xml='<workbook xmlns="m"><workbookPr date1904="1"/></workbook>')
    assert (0, 0, 2, "2028-04-02") in list(files.sheet_cells(later))


def test_resume_values(spark):
    text = "氏名: A.B（２９歳）\n最寄駅：ＪＲ山手線 渋谷駅 徒歩5分\n雇用 個人事業主\n許可 派１３－３１８０６４ と 派13-318064\n国籍：中国（永住）"
    one = spark.createDataFrame([(1, text)], "id int, t string")
    x = F.col("t")
    got = one.select(resume.age(x), resume.station(x), resume.employment(x), resume.licences(x), resume.nationality(x), resume.company(F.lit("株式会社 北 御中")), resume.company(F.lit("a@b.c")), resume.style_tag(F.lit("週3リモート、出社2日"))).first()
    assert tuple(got) == (29, "渋谷", "フリーランス", ["派13-318064"], "中国", "株式会社 北", None, "併用")
    mails = spark.createDataFrame([(1, "hello\n■氏名：A\nx\n■氏名：B\ny"), (2, "none"), (3, "【氏名】C")], "id int, text string")
    assert sorted((r.id, r.block, r.text.splitlines()[0]) for r in resume.blocks(mails).collect()) == [(1, 0, "hello"), (1, 1, "■氏名：A"), (1, 2, "■氏名：B"), (2, 0, "none"), (3, 1, "【氏名】C")]


def test_classifier(spark):
    r = np.random.default_rng(1)
    rows = [(i, float(a), float(b), int(a + 0.3 * b > 0)) for i, (a, b) in enumerate(r.normal(size=(600, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    model = classifier.fitted(df.where(classifier.learns(F.col("id"))), ["a", "b"], "y")
    held = classifier.scored(model, df.where(~classifier.learns(F.col("id"))))
    sweep = {round(x.threshold, 1): x for x in classifier.threshold_sweep(held, "y", [0.0, 0.5, 1.1]).collect()}
    assert sweep[0.5].f1 > 0.9 and sweep[0.0].recall == 1 and sweep[1.1].precision == sweep[1.1].recall == sweep[1.1].f1 == 0
    doubts = classifier.least_certain(held, "id", 5).collect()
    assert len(doubts) == 5 and max(abs(x.p - 0.5) for x in doubts) < 0.2
    votes = spark.createDataFrame([(1, 1, None, 1), (2, 1, None, None), (3, -1, None, None), (4, 1, 1, -1)], "id int, a int, b int, c int")
    assert [x[0] for x in votes.orderBy("id").select(classifier.votes([F.col(c) for c in "abc"])).collect()] == [1, None, 0, None]
