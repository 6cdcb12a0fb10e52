"""Workbooks read and written."""

import datetime
import io
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from loomstone.sources import workbooks

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def foreign(path, rows):
    """A workbook as spreadsheet programs write them: shared strings, styles, formulas, gaps, another sheet first."""
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets><sheet name="other" sheetId="1" r:id="rId2"/><sheet name="my &amp; data" sheetId="2" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="/xl/worksheets/a.xml"/><Relationship Id="rId2" Target="worksheets/b.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}"><si><t>name</t></si><si><r><t>two </t></r><r><t>runs</t></r><rPh><t>hint</t></rPh></si><si><t>day</t></si><si><t xml:space="preserve"> a_x000D_&lt;b </t></si></sst>')
        book.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/><numFmt numFmtId="171" formatCode="0.0&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        book.writestr("xl/worksheets/a.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>')
        book.writestr("xl/worksheets/b.xml", f'<worksheet xmlns="{MAIN}"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>x</t></is></c></row><row r="2"><c r="A2"><v>1</v></c></row></sheetData></worksheet>')


ROWS = """<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>0</v></c><c r="D1" t="s"><v>2</v></c></row>
<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2" t="str"><f>A1</f><v>made</v></c><c r="C2"><v>0.1</v></c><c r="D2" s="1"><v>45000</v></c></row>
<row r="3"><c r="B3" t="b"><v>1</v></c><c r="D3" s="4"><v>45000.5</v></c><c r="AA3" t="e"><v>#N/A</v></c></row><row r="4"/>
<row r="5"><c t="s"><v>3</v></c><c s="3"><v>7</v></c><c s="0"><v/></c><c s="2"><v>1</v></c></row>"""


def test_a_foreign_workbook(spark, tmp_path):
    foreign(tmp_path / "a.xlsx", ROWS)
    rows = {(r.sheet, r.pos): r.cells for r in workbooks.cells(spark, str(tmp_path)).collect()}
    assert rows == {
        ("other", 0): {"x": "1"},
        ("my & data", 0): {"name": "two runs", "name.1": "made", "Unnamed: 2": "0.1", "day": "2023-03-15"},
        ("my & data", 1): {"name.1": "true", "day": "2023-03-15 12:00:00", "Unnamed: 26": "#N/A"},
        ("my & data", 3): {"name": " a\r<b ", "name.1": "7", "day": "1899-12-31"},
    }
    typed = workbooks.read_workbooks(spark, str(tmp_path), "my & data", "day date, `name.1` int, none double").orderBy("pos").collect()
    assert [tuple(r) for r in typed] == [(datetime.date(2023, 3, 15), None, None, "a.xlsx", 0), (datetime.date(2023, 3, 15), None, None, "a.xlsx", 1), (datetime.date(1899, 12, 31), 7, None, "a.xlsx", 3)]


def test_round_trip_of_several_workbooks(spark, tmp_path):
    said = ["plain", " spaces ", "a<b & \"c\"", "é日\U0001f600", "line\nbreak", "\x01\x1f\r_x0041_", None, "", "x" * 32_767]
    rows = [(i, s, None if i == 3 else i / 7, i % 2 == 0, datetime.date(2024, 1, i + 1)) for i, s in enumerate(said)] + [(2**53 + 1, "big", math.nan, None, None)]
    df = spark.createDataFrame(rows, "id long, said string, x double, even boolean, day date")
    workbooks.write_workbook({"first": df.orderBy("id"), "a name that is longer than the format allows": df.select("id").limit(0)}, f"{tmp_path}/one.xlsx")
    workbooks.write_workbook({"first": df.where("id < 3").withColumn("extra", F.lit("e"))}, f"{tmp_path}/two.xlsx")
    workbooks.write_workbook({"first": df.where("id < 2").orderBy("id")}, f"{tmp_path}/two.xlsx")  # in the place of the former
    workbooks.write_workbook({}, f"{tmp_path}/none.xlsx")
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["one.xlsx", "two.xlsx"]
    back = workbooks.read_workbooks(spark, [f"{tmp_path}/one.xlsx", f"{tmp_path}/two.xlsx"], "first", "id long, said string, x double, even boolean, day date")
    want = [(i, s or None, None if x is None or x != x else x, e, d) for i, s, x, e, d in rows]
    assert [tuple(r)[:5] for r in back.where("workbook = 'one.xlsx'").orderBy("pos").collect()] == want
    assert [tuple(r)[:5] for r in back.where("workbook = 'two.xlsx'").orderBy("pos").collect()] == want[:2]
    names = zipfile.ZipFile(tmp_path / "one.xlsx")
    assert list(workbooks.sheet_names(names)) == ["first", "a name that is longer than the "] and names.testzip() is None
    untyped = workbooks.read_workbooks(spark, str(tmp_path), "first")
    assert untyped.columns == ["day", "even", "id", "said", "x", "workbook", "pos"] and workbooks.read_workbooks(spark, str(tmp_path), "gone").count() == 0


def test_what_the_format_does_not_hold_is_an_error(spark, tmp_path, monkeypatch):
    with pytest.raises(ValueError, match="characters"):
        workbooks.write_workbook({"s": spark.sql("select repeat('x', 40000) as t")}, f"{tmp_path}/a.xlsx")
    monkeypatch.setattr(workbooks, "MOST_ROWS", 3)
    with pytest.raises(ValueError, match="holds 3 rows"):
        workbooks.write_workbook({"s": spark.range(4)}, f"{tmp_path}/a.xlsx")
    workbooks.write_workbook({"s": spark.range(3)}, f"{tmp_path}/b.xlsx")
    with pytest.raises(ValueError, match="one name"):
        workbooks.write_workbook({"s" * 31 + "a": spark.range(1), "s" * 31 + "b": spark.range(1)}, f"{tmp_path}/c.xlsx")
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["b.xlsx"]
    assert io.BytesIO((tmp_path / "b.xlsx").read_bytes()).read(2) == b"PK"
