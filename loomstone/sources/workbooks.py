"""Spreadsheet workbooks (.xlsx) as tables, and tables as workbooks.

Workbooks are read as binary files by Spark, from any store; a task takes a
workbook at a time and streams its sheets' rows. A workbook is written row by row
into the shared store, as a file of this format is one stream; its sheets have at
most ``MOST_ROWS`` rows, and more raise an error instead of being cut.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from itertools import batched
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.sources.stores import Folder

MOST_ROWS = 1_048_575  # of a sheet below its header, by the format
MOST_COLUMNS = 16_384
_ROWS = "workbook string, sheet string, pos bigint, cells map<string,string>"
_BATCH = 2048

# fixed values of the format
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_DAY_FORMATS = {*range(14, 23), *range(45, 48)}
_DAY_ZERO = datetime.datetime(1899, 12, 30)

_CONTROL = re.compile("[\x00-\x08\x0b-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")


def _column(ref: str) -> int:
    """The place of a cell such as ``AB7`` in its row."""
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _letters(place: int) -> str:
    out, n = "", place + 1
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def _text(node) -> str:
    """The text of a string item, its phonetic hints aside."""
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), "".join(t.text or "" for part in ([node] + node.findall(f"{_MAIN}r")) for t in part.findall(f"{_MAIN}t")))


def _day_styles(book: zipfile.ZipFile) -> set[int]:
    """The cell styles that show a number as a day or time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")) for f in root.iter(f"{_MAIN}numFmt")}
    days = _DAY_FORMATS | {i for i, code in custom.items() if re.search("[ydhs]", code.lower())}
    styles = root.find(f"{_MAIN}cellXfs")
    return {i for i, xf in enumerate(styles if styles is not None else []) if int(xf.get("numFmtId", 0)) in days}


def _number(said: str, is_day: bool) -> str:
    if not is_day:
        return said
    at = _DAY_ZERO + datetime.timedelta(seconds=round(float(said) * 86_400))
    return at.strftime("%Y-%m-%d") if float(said) == int(float(said)) else at.strftime("%Y-%m-%d %H:%M:%S")


def sheet_names(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheets by name with the file that holds each, in the workbook's order."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    place = lambda target: target.removeprefix("/") if target.startswith("/") else f"xl/{target}"
    return {s.get("name"): place(links[s.get(_LINK)]) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")}


def read_sheets(content: bytes, wanted: str | None = None) -> Iterator[tuple[str, int, dict[str, str]]]:
    """(sheet, place, cells by header) of each row below a sheet's first row; blank cells are left out, and rows without any."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as f:
                for _, node in ElementTree.iterparse(f):
                    if node.tag == f"{_MAIN}si":
                        shared.append(_text(node))
                        node.clear()
        days = _day_styles(book)
        for sheet, file in sheet_names(book).items():
            if wanted is None or sheet == wanted:
                with book.open(file) as f:
                    yield from ((sheet, pos, cells) for pos, cells in _below_header(_rows(f, shared, days)))


def _rows(f, shared: list[str], days: set[int]) -> Iterator[dict[int, str]]:
    """Cells of each row by place."""
    for _, row in ElementTree.iterparse(f):
        if row.tag != f"{_MAIN}row":
            continue
        cells, place = {}, -1
        for c in row.findall(f"{_MAIN}c"):
            place = _column(c.get("r")) if c.get("r") else place + 1
            kind, value = c.get("t", "n"), c.findtext(f"{_MAIN}v")
            if kind == "inlineStr":
                inline = c.find(f"{_MAIN}is")
                value = _text(inline) if inline is not None else None
            elif value is not None:
                value = shared[int(value)] if kind == "s" else {"0": "false", "1": "true"}.get(value, value) if kind == "b" else _ESCAPED.sub(lambda m: chr(int(m[1], 16)), value) if kind == "str" else value if kind in ("e", "d") else _number(value, int(c.get("s", 0)) in days)
            if value:
                cells[place] = value
        row.clear()
        yield cells


def _below_header(rows: Iterator[dict[int, str]]) -> Iterator[tuple[int, dict[str, str]]]:
    header: dict[int, str] | None = None
    for pos, cells in enumerate(rows):
        if header is None:
            header, seen = {}, {}
            for place in sorted(cells):  # a repeated header gets a number, as in data frames
                name = cells[place]
                seen[name] = seen.get(name, -1) + 1
                header[place] = f"{name}.{seen[name]}" if seen[name] else name
        elif cells:
            yield pos - 1, {header.get(place, f"Unnamed: {place}"): value for place, value in cells.items()}


def cells(spark: SparkSession, paths: str | list[str], sheet: str | None = None) -> DataFrame:
    """(workbook, sheet, pos, cells) of all rows of a sheet (all sheets) of the workbooks at or below some paths.

    ``cells`` maps headers to texts; numbers come as they are written, truth
    values as true and false, days and times in ISO form. Blank cells are not in
    the map. ``workbook`` is the file's name. Paths without workbooks give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()))

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for path, content in zip(batch.column(0), batch.column(1), strict=True):
                    name = path.as_py().rpartition("/")[2]
                    yield from ((name, *row[:2], list(row[2].items())) for row in read_sheets(content.as_py(), sheet))

        for part in batched(rows(), _BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=["workbook", "sheet", "pos", "cells"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(paths)
    return files.select("path", "content").mapInArrow(run, _ROWS)


def read_workbooks(spark: SparkSession, paths: str | list[str], sheet: str, schema: str | None = None) -> DataFrame:
    """One sheet of several workbooks on top of each other, with ``workbook`` and ``pos``.

    Columns are those of ``schema`` (cells that do not fit give null); without one
    they are all headers, as text, found by a scan of the sheets. A workbook that
    lacks a column has nulls there.
    """
    rows = cells(spark, paths, sheet)
    if schema is None:
        names = [r[0] for r in rows.select(F.explode(F.map_keys("cells"))).distinct().limit(MOST_COLUMNS + 1).collect()]
        fields = [(n, "string") for n in sorted(names)]
    else:
        fields = [(f.name, f.dataType.simpleString()) for f in spark.createDataFrame([], schema).schema]
    at = lambda n: F.try_element_at("cells", F.lit(n))
    return rows.select(*[at(n).try_cast(kind).alias(n) for n, kind in fields], "workbook", "pos")


class _Stream(io.RawIOBase):
    """A stream of the JVM as a file to write to."""

    def __init__(self, stream):
        self._stream = stream

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self._stream.write(bytearray(data))
        return len(data)


def _cell(place: int, row: int, value) -> str:
    ref = f"{_letters(place)}{row}"
    if value is None or (isinstance(value, float) and value != value):
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float) and abs(value) < 1e15:
        return f'<c r="{ref}"><v>{value!r}</v></c>'
    said = _CONTROL.sub(lambda m: f"_x{ord(m[0]):04X}_", str(value))
    if len(said) > 32_767:
        raise ValueError(f"a cell of {len(said)} characters at {ref}; the format holds 32767")
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(said)}</t></is></c>'


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """Write tables as the sheets of one workbook, with headers, in the order of the tables' rows.

    Names longer than the 31 characters of the format are cut; nulls are blank
    cells, dates and other kinds their text. Rows go one partition at a time to
    the file, which takes its place once it is whole. Without sheets none is written.
    """
    if not sheets:
        return
    names = [name[:31] for name in sheets]
    if len(set(names)) < len(names):
        raise ValueError("two sheets of one name")
    spark = next(iter(sheets.values())).sparkSession
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    folder = Folder(spark, path.rpartition("/")[0])
    with folder.whole(path.rpartition("/")[2]) as stream, io.BufferedWriter(_Stream(stream), 1 << 20) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(names) + 1))
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        rels = "http://schemas.openxmlformats.org/package/2006/relationships"
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{rels}"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{rels}">{links}</Relationships>')
        for i, df in enumerate(sheets.values(), 1):
            if len(df.columns) > MOST_COLUMNS:
                raise ValueError(f"{len(df.columns)} columns; a sheet holds {MOST_COLUMNS}")
            with book.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as f:
                line = lambda n, values: f'<row r="{n}">{"".join(_cell(k, n, v) for k, v in enumerate(values))}</row>'.encode()
                f.write(f'{head}<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode() + line(1, df.columns))
                for n, row in enumerate(df.toLocalIterator(), 2):
                    if n > MOST_ROWS + 1:
                        raise ValueError(f"a sheet holds {MOST_ROWS} rows; write a table instead")
                    f.write(line(n, row))
                f.write(b"</sheetData></worksheet>")
