"""Workbooks and paged documents written by the tests."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import paged, workbook

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def book(sheet, names="", hidden=False, **more):
    state = ' state="hidden"' if hidden else ""
    parts = {
        "[Content_Types].xml": "<Types/>", "_rels/.rels": "<Relationships/>",
        "xl/workbook.xml": f'<workbook {NS}><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Two"{state} sheetId="2" r:id="r2"/></sheets><definedNames>{names}</definedNames></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships><Relationship Id="r1" Type="{REL}/worksheet" Target="worksheets/s1.xml"/><Relationship Id="r2" Type="{REL}/worksheet" Target="/xl/worksheets/s2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {NS}><si><t>Head</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {NS}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="10"/></cellXfs></styleSheet>',
        "xl/worksheets/s1.xml": f"<worksheet {NS}>{sheet}</worksheet>",
        "xl/worksheets/s2.xml": f'<worksheet {NS}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>two</t></is></c></row></sheetData></worksheet>',
        "xl/worksheets/_rels/s1.xml.rels": f'<Relationships><Relationship Id="c" Type="{REL}/comments" Target="../comments1.xml"/></Relationships>',
        "xl/comments1.xml": f'<comments {NS}><commentList><comment ref="B4"><text><t>note</t></text></comment></commentList></comments>',
    } | more
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            if text is not None:
                z.writestr(name, text)
    return out.getvalue()


SHEET = """<sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row>
<row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3" s="1"><v>45000</v></c><c r="C3" s="2"><v>0.5</v></c></row>
<row r="4"><c r="A4"><f>A3*2</f><v>4</v></c><c r="B4"/><c r="AA4" t="b"><v>1</v></c></row></sheetData>
<mergeCells><mergeCell ref="A1:B1"/></mergeCells>
<dataValidations><dataValidation type="list" sqref="A6" promptTitle="P"><formula1>"x, y"</formula1></dataValidation><dataValidation type="whole" sqref="B6"/></dataValidations>"""
NAMES = "<definedName name='Area'>One!$A$3:$B$3</definedName><definedName name='Gone'>One!$Z$9</definedName><definedName name='Ext'>[1]One!$A$1</definedName><definedName name='_xlnm.Print_Area'>One!$A$1</definedName>"


def parsed(spark, *blobs):
    rows = [(f"s{k}", bytearray(b) if b is not None else None) for k, b in enumerate(blobs)]
    return workbook.parse(spark.createDataFrame(rows, "source_id string, content binary"))


def test_regions(spark):
    got = workbook.regions(parsed(spark, book(SHEET, NAMES, hidden=True))).orderBy("first_row").collect()
    assert [r["cell_range"] for r in got] == ["A1:A1", "A3:AA4", "A6:B6"]
    assert got[1]["content"].split("\n") == [
        "Sheet: One", "Heading: Head", "A3: ab | B3: 2023-03-15T00:00:00 | Expected format: yyyy\\-mm\\-dd | C3: 0.5 | Expected format: 0.00%",
        "A4: =A3*2 | B4: [blank cell] | Comment: note | AA4: TRUE"]
    assert got[1]["warnings"] == ["HIDDEN_SHEET_SKIPPED", "FORMULA_WITHOUT_CACHED_VALUE"] and got[1]["title_path"] == ["One", "Head"]
    assert got[2]["content"].split("\n")[1:] == ["Heading: Head", "A6: [blank input] | Prompt title: P; Allowed values: x, y | B6: [blank input] | Validation present (details not expanded)"]
    assert "DATA_VALIDATION_PARTIAL" in got[2]["warnings"]


def test_names_and_sheets(spark):
    p = parsed(spark, book(SHEET, NAMES))
    got = {r["section"]: r["content"] for r in workbook.named_ranges(p).collect()}
    assert set(got) == {"Named range: Area", "Named range: Gone"}
    assert got["Named range: Area"].split("\n")[2:] == ["Range: A3:B3", "A3: ab | B3: 2023-03-15T00:00:00 | Expected format: yyyy\\-mm\\-dd"]
    assert got["Named range: Gone"].endswith("[named range contains no visible cell values]")
    assert {r["sheet"] for r in workbook.regions(p).collect()} == {"One", "Two"}


@pytest.mark.parametrize("blob,code", [
    (None, "WORKBOOK_NO_ZIP_SIGNATURE"), (b"", "WORKBOOK_NO_ZIP_SIGNATURE"), (b"<html>", "WORKBOOK_IS_HTML"), (b"PK\x03\x04xx", "WORKBOOK_BAD_ZIP"),
    (book(SHEET, **{"_rels/.rels": None}), "WORKBOOK_MISSING_MEMBERS"), (book(SHEET, **{"../x": "y"}), "WORKBOOK_UNSAFE_MEMBER"),
    (book(SHEET, **{"xl/workbook.xml": "<!DOCTYPE x><workbook/>"}), "WORKBOOK_UNSAFE_XML"), (book("<row>"), "WORKBOOK_UNSAFE_XML"),
])
def test_rejected(blob, code):
    assert workbook.read(blob)[0] == code


def test_rejected_rows(spark):
    p = parsed(spark, b"<html>", book(SHEET))
    assert [tuple(r) for r in workbook.issues(p).collect()] == [("s0", "WORKBOOK_IS_HTML", "error")]
    assert workbook.regions(parsed(spark)).count() == 0 and {r["source_id"] for r in workbook.regions(p).collect()} == {"s1"}


def test_letters(spark):
    for n in (1, 26, 27, 52, 53, 702, 703, 16384, 18278):
        assert workbook.column_number(workbook.column_letters(n)) == n
    df = spark.range(1, 18279).select("id", workbook.letters(F.col("id")).alias("s")).collect()
    assert all(r["s"] == workbook.column_letters(r["id"]) for r in df)


def test_headings(spark):
    lines = ["1. Scope", "1.2 Rates of tax", "GENERAL RULES", "Income Tax Guide", "this is prose", "It ends here.", "", "X" * 200]
    df = spark.createDataFrame(list(enumerate(lines)), "k int, t string").orderBy("k")
    got = [r[0] for r in df.select(paged.heading(F.col("t"))).collect()]
    assert [g and g["depth"] for g in got] == [1, 2, 1, 1, None, None, None, None]


def test_heading_paths(spark):
    rows = [("a", 1, "1 First\n1.1 Inner\ntext"), ("a", 2, "text only."), ("a", 3, "1.2 Other\n"), ("a", 4, "2 Second"), ("b", 1, "2.1.1 Deep\n2.2 Next"), ("b", 2, None)]
    df = paged.heading_paths(spark.createDataFrame(rows, "source_id string, page int, text string"))
    got = {(r["source_id"], r["page"]): r["title_path"] for r in df.collect()}
    assert got == {("a", 1): ["1 First", "1.1 Inner"], ("a", 2): ["1 First", "1.1 Inner"], ("a", 3): ["1 First", "1.2 Other"], ("a", 4): ["2 Second"],
                   ("b", 1): ["2.1.1 Deep", "2.2 Next"], ("b", 2): ["2.1.1 Deep", "2.2 Next"]}


def test_page_records(spark):
    long = "word " * 40
    rows = [("a", 1, long, None), ("a", 2, "", ""), ("a", 3, "few words that are native", long), ("a", 4, "1 Head\na b c d e f g h i j k l m n o p q r s", "x")]
    got = {r["page"]: r for r in paged.page_records(spark.createDataFrame(rows, "source_id string, page int, text string, ocr_text string")).collect()}
    assert set(got) == {1, 3, 4} and got[3]["extraction_method"] == "pdf_ocr" and got[3]["warnings"] == ["OCR_USED"]
    assert got[4]["warnings"] == ["OCR_WEAKER_THAN_NATIVE"] and got[4]["section"] == "1 Head" and got[1]["section"] is None
    counts = spark.createDataFrame([("a", 4)], "source_id string, page_count int")
    need = paged.ocr_required(counts, spark.createDataFrame([("a", 1, long), ("a", 3, "x")], "source_id string, page int, content string"))
    assert sorted(r["page"] for r in need.collect()) == [2, 3, 4]
