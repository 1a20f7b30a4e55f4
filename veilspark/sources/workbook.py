"""Workbooks (.xlsx): their rows from zip and XML, and a writer; no other library is needed."""

from __future__ import annotations

import io
import re
import sys
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _open(data: bytes) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(data))


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of each sheet, in order."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    names = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
    return [(s.get("name"), "xl/" + links[s.get(LINK)].lstrip("/").removeprefix("xl/")) for s in names]


def sheet_names(data: bytes) -> list[str]:
    with _open(data) as book:
        return [n for n, _ in _sheets(book)]


def column_number(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def rows_of(data: bytes, sheet: str) -> Iterator[list[str | None]]:
    """The rows of a sheet (by name or number), gaps as None; values as they are stored, numbers without a trailing .0."""
    with _open(data) as book:
        sheets = _sheets(book)
        part = next((p for n, p in sheets if n == sheet), None) or sheets[int(sheet)][1]
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in x.iter(f"{MAIN}t")) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        place = 0
        for _, row in ElementTree.iterparse(book.open(part)):
            if row.tag != f"{MAIN}row":
                continue
            number = int(row.get("r", place + 1)) - 1
            while place < number:
                yield []
                place += 1
            out: list[str | None] = []
            for cell in row.iter(f"{MAIN}c"):
                at = column_number(cell.get("r")) if cell.get("r") else len(out)
                value, kind = cell.find(f"{MAIN}v"), cell.get("t")
                text = value.text if value is not None else None
                if kind == "s" and text is not None:
                    text = shared[int(text)]
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
                elif kind == "b" and text is not None:
                    text = str(text == "1")
                elif kind is None and text and text.endswith(".0"):
                    text = text[:-2]
                out += [None] * (at + 1 - len(out))
                out[at] = text or None
            yield out
            place += 1
            row.clear()


def write_workbook(path: str, sheets: dict[str, tuple[list[str], list[tuple]]]) -> None:
    """A workbook of (names, rows) by sheet name; numbers as numbers, all else as text.  For results of a size that one
    file can hold."""
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    n = len(sheets)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, n + 1))
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(s[:31], {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, s in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, n + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, (columns, rows) in enumerate(sheets.values(), 1):
            lines = []
            for r, row in enumerate([tuple(columns), *rows] if columns else rows, 1):
                cells = []
                for c, v in enumerate(row):
                    at, k = "", c
                    while k >= 0:
                        at, k = chr(65 + k % 26) + at, k // 26 - 1
                    if v is None:
                        continue
                    if isinstance(v, (int, float)) and not isinstance(v, bool):
                        cells.append(f'<c r="{at}{r}"><v>{v!r}</v></c>')
                    else:
                        cells.append(f'<c r="{at}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
                lines.append(f'<row r="{r}">{"".join(cells)}</row>')
            book.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{MAIN[1:-1]}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
