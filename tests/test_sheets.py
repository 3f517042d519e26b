"""Workbooks, written here and by hand, read back."""

import zipfile

import pytest
from pyspark.sql import functions as F

from repeatloom.sources import sheets, text

HAND = {
    "xl/workbook.xml": '<workbook xmlns="m" xmlns:r="r"><sheets><sheet name="b" sheetId="2" r:id="rId7"/><sheet name="a" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId7" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
    "xl/sharedStrings.xml": '<sst xmlns="m"><si><t>Chrom</t></si><si><r><t>chr</t></r><r><rPr/><t>1</t></r><rPh><t>x</t></rPh></si><si><t>start</t></si></sst>',
    "xl/worksheets/sheet1.xml": '<worksheet xmlns="m"><sheetData><row><c><v>1</v></c></row></sheetData></worksheet>',
    "xl/worksheets/sheet2.xml": '<worksheet xmlns="m"><cols/><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>2</v></c><c r="C2" t="inlineStr"><is><t>END</t></is></c>'
    '<c r="E2" t="str"><f>"cons"</f><v>cons_len</v></c><c r="F2" t="str"><v>period</v></c></row><row r="3"><c r="A3" s="1"/></row>'
    '<row r="4"><c r="A4" t="s"><v>1</v></c><c r="B4"><v>5</v></c><c r="C4"><v>1.2E1</v></c><c r="E4"><v>40.9</v></c><c r="F4"><v>3</v></c></row>'
    '<row r="9"><c r="A9" t="s"><v>1</v></c><c r="B9"><v>7.0</v></c><c r="C9"><v>9</v></c><c r="E9" t="e"><v>#N/A</v></c></row></sheetData></worksheet>',
}


def by_hand(path):
    with zipfile.ZipFile(path, "w") as book:
        for name, content in HAND.items():
            book.writestr(name, content)
    return str(path)


def test_region_list(spark, tmp_path):
    """The first sheet by order, shared strings in runs, gaps, an empty row, an error."""
    path = by_hand(tmp_path / "a.xlsx")
    assert sheets.read_sheet(spark, path).columns == ["Chrom", "start", "END", "Unnamed: 3", "cons_len", "period"]
    found = text.read_region_list(spark, path).orderBy("ord").collect()
    assert [tuple(r)[1:] for r in found] == [("chr1", 5, 12, 40), ("chr1", 7, 9, None)]


def test_round_trip(spark, tmp_path, monkeypatch):
    rows = [(1, 0.1, "a <&> \"b\" ]]>\n é", True), (None, None, None, None), (-(2**62), float("nan"), "  ", False), (3, 1e300, "", None)]
    table = spark.createDataFrame(rows, "n long, x double, `s t` string, b boolean").coalesce(1)
    assert sheets.write_sheet(table, str(tmp_path / "t.xlsx")) == 4
    monkeypatch.setattr(sheets, "BATCH_ROWS", 2)
    got = sheets.read_sheet(spark, str(tmp_path / "t.xlsx"), "at").orderBy("at").drop("at")
    back = got.select(F.col("n").cast("long"), F.col("x").cast("double"), "s t", F.col("b").cast("boolean")).collect()
    assert [tuple(r) for r in back] == [rows[0], (-(2**62), None, "  ", False), rows[3]]


def test_limits(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t.xlsx")
    with pytest.raises(sheets.SheetError):
        sheets.write_sheet(spark.createDataFrame([("x" * 32768,)], "s string"), path)
    with pytest.raises(sheets.SheetError):
        sheets.write_sheet(spark.createDataFrame([("\x01",)], "s string"), path)
    monkeypatch.setattr(sheets, "MOST_ROWS", 3)
    assert sheets.write_sheet(spark.range(2).toDF("a"), path) == 2
    with pytest.raises(sheets.SheetError):
        sheets.write_sheet(spark.range(3).toDF("a"), path)


def test_names():
    assert sheets._names(["a", None, "a", "a.1", "a"]) == ["a", "Unnamed: 1", "a.1", "a.1.1", "a.2"]
