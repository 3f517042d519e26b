"""Spreadsheets (XLSX): the first sheet of a workbook as a table, and tables written as one.

A sheet has at most MOST_ROWS rows by its format, so one task decodes a workbook, row by
row; Spark reads the file, so any path that Spark knows will do.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import InputError

# Limits of the format, and names of its parts.
MOST_ROWS, MOST_TEXT = 1_048_576, 32_767
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"

BATCH_ROWS = 20_000
_ROWS = pa.schema([("ord", pa.int64()), ("cells", pa.list_(pa.string()))])


class SheetError(InputError):
    """A file that isn't a workbook, or a table that doesn't fit in a sheet."""


def _local(element) -> str:
    return element.tag.rpartition("}")[2]


def _text(element) -> str:
    """The text of a string, plain or in runs, without the readings given for it."""
    if _local(element) == "t":
        return element.text or ""
    return "".join(_text(e) for e in element if _local(e) in ("t", "r"))


def _first_sheet(book: zipfile.ZipFile) -> str:
    """The name of the first sheet's part."""
    sheets = (e for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _local(e) == "sheet")
    first = next(sheets, None)
    if first is None:
        raise SheetError("the workbook has no sheet")
    wanted = next(v for k, v in first.attrib.items() if k.rpartition("}")[2] == "id")
    for relation in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if relation.get("Id") == wanted:
            return posixpath.normpath(posixpath.join("/xl", relation.get("Target"))).lstrip("/")
    raise SheetError(f"the workbook lacks its sheet {wanted}")


def _strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return [_text(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if _local(e) == "si"]


def _column(reference: str) -> int:
    """The number of a cell's column, from 0, by its letters."""
    number = 0
    for letter in re.match("[A-Z]*", reference).group():
        number = 26 * number + ord(letter) - ord("A") + 1
    return number - 1


def _value(cell, strings: list[str]) -> str | None:
    """A cell's value as text; null for empty cells and errors."""
    kind = cell.get("t", "n")
    parts = {_local(e): e for e in cell}
    if kind == "inlineStr":
        return _text(parts["is"]) if "is" in parts else None
    raw = parts["v"].text if "v" in parts else None
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return strings[int(raw)]
    return {"0": "False", "1": "True"}.get(raw, raw) if kind == "b" else raw


def sheet_rows(data: bytes) -> Iterator[list[str | None]]:
    """The cells, as text, of each row of a workbook's first sheet that has any."""
    try:
        book = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as error:
        raise SheetError("not an XLSX workbook; save it as XLSX or CSV") from error
    with book:
        strings = _strings(book)
        with book.open(_first_sheet(book)) as part:
            body = None
            for event, element in ElementTree.iterparse(part, events=("start", "end")):
                if event == "start":
                    body = element if _local(element) == "sheetData" else body
                elif _local(element) == "row" and body is not None:
                    cells: list[str | None] = []
                    for cell in element:
                        at = _column(cell.get("r")) if cell.get("r") else len(cells)
                        cells += [None] * (at + 1 - len(cells))
                        cells[at] = _value(cell, strings)
                    if any(c is not None for c in cells):
                        yield cells
                    body.clear()  # rows that were read


def _batches(most: int | None):
    def run(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in files:
            for content in batch.column("content"):
                held = []
                for number, cells in enumerate(sheet_rows(content.as_py())):
                    if number == most:
                        break
                    held.append((number, cells))
                    if len(held) == BATCH_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ROWS)], schema=_ROWS)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ROWS)], schema=_ROWS)

    return run


def _names(header: list[str | None]) -> list[str]:
    """Names of columns: those without one are numbered, and so are further ones of a name."""
    names: list[str] = []
    for at, given in enumerate(header):
        name, again = given if given is not None else f"Unnamed: {at}", 0
        while (f"{name}.{again}" if again else name) in names:
            again += 1
        names.append(f"{name}.{again}" if again else name)
    return names


def read_sheet(spark: SparkSession, path: str, order: str | None = None) -> DataFrame:
    """The first sheet of a workbook: its first row names the columns, all values are text.

    Empty rows are left out, empty cells and errors are null; a sheet without rows is an
    error. ``order`` names a column for the place of a row.
    """
    file = spark.read.format("binaryFile").load(path).select("content")
    kind = "ord long, cells array<string>"
    try:
        first = file.mapInArrow(_batches(1), kind).collect()
    except PythonException as error:
        raise SheetError(f"{path}: not an XLSX workbook that can be read") from error
    if not first:
        raise SheetError(f"{path}: no rows")
    columns = [F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(_names(first[0].cells))]
    rows = file.mapInArrow(_batches(None), kind).where("ord > 0")
    return rows.select(*([F.col("ord").alias(order)] if order else []), *columns)


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>" if value == value and abs(value) != float("inf") else "<c/>"
    text = str(value)
    if len(text) > MOST_TEXT:
        raise SheetError(f"a cell holds at most {MOST_TEXT} characters, not {len(text)}")
    if re.search("[\x00-\x08\x0b\x0c\x0e-\x1f]", text):
        raise SheetError("a cell can't hold control characters")
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write_sheet(table: DataFrame, path: str, title: str = "Sheet1") -> int:
    """Write ``table``, in its order, as the one sheet of a workbook, with its columns' names first; returns how many rows.

    Rows come one at a time. Numbers that aren't finite are empty cells, as nulls are. A table
    of MOST_ROWS rows or more, which no sheet can hold, is an error, never cut.
    """
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    small = {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>'
        f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets><sheet name={quoteattr(title)} sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATIONS}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }
    written = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in small.items():
            book.writestr(name, head + text)
        with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as part:
            line = lambda cells: part.write(f"<row>{''.join(map(_cell, cells))}</row>".encode())
            part.write(f'{head}<worksheet xmlns="{MAIN}"><sheetData>'.encode())
            line(table.columns)
            for row in table.toLocalIterator():
                written += 1
                if written == MOST_ROWS:
                    raise SheetError(f"a sheet holds fewer than {MOST_ROWS} rows below its header; write CSV or Parquet instead")
                line(row)
            part.write(b"</sheetData></worksheet>")
    return written
