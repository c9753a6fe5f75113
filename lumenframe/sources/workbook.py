"""Cells of one .xlsx workbook: a zip archive of XML parts."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


# The number formats of the file format that show dates and times, and its relation namespaces.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_DATE_LETTERS = re.compile(r"[dmyhs]", re.I)
_LITERALS = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]')


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    """Cell styles whose number format shows a date or time."""
    if "xl/styles.xml" not in archive.namelist():
        return set()
    root = ElementTree.fromstring(archive.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{_MAIN}numFmt")
           if _DATE_LETTERS.search(_LITERALS.sub("", f.get("formatCode", "")))}
    formats = root.find(f"{_MAIN}cellXfs")
    return {i for i, x in enumerate(formats if formats is not None else ())
            if int(x.get("numFmtId", 0)) in _DATE_FORMATS | own}


def _moment(serial: str, since_1904: bool) -> str:
    """ISO text of a serial day number; day 60 of the 1900 system never was, so days before it count one more."""
    days = float(serial)
    start = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30) if days >= 60 else datetime(1899, 12, 31)
    return (start + timedelta(seconds=round(days * 86_400))).isoformat()


def _sheet_parts(archive: zipfile.ZipFile) -> tuple[list[str], bool]:
    """Parts of the sheets in the workbook's own order, and whether days count from 1904. A bare archive of sheets, without
    the part that lists them, has them in the order of their names."""
    if "xl/workbook.xml" not in archive.namelist():
        names = [n for n in archive.namelist() if n.startswith("xl/worksheets/") and n.endswith(".xml")]
        return sorted(names, key=lambda n: (len(n), n)), False
    book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
    links = ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
    targets = {link.get("Id"): link.get("Target") for link in links}
    parts = [targets[sheet.get(_RELATION)] for sheet in book.iter(f"{_MAIN}sheet")]
    settings = book.find(f"{_MAIN}workbookPr")
    since_1904 = settings is not None and settings.get("date1904") in ("1", "true")
    return [part.lstrip("/") if part.startswith("/") else f"xl/{part}" for part in parts], since_1904


def _cell_value(cell, shared: list[str], dates: set[int], since_1904: bool) -> str | None:
    kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return _text(cell)
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "true" if value.text == "1" else "false"
    if kind in (None, "n") and int(cell.get("s", 0)) in dates:
        return _moment(value.text, since_1904)
    return None if kind == "e" else value.text


def sheet_rows(content: bytes, sheet: int = 0, header: bool = True) -> list[dict[str, str | None]]:
    """Rows of a sheet, in the workbook's order of sheets, as {column name: text}; without a header columns are named
    c0, c1, ... Cells formatted as dates come as ISO texts."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in archive.namelist():
            root = ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))
            shared = [_text(item) for item in root.iter(f"{_MAIN}si")]
        dates = _date_styles(archive)
        parts, since_1904 = _sheet_parts(archive)
        root = ElementTree.fromstring(archive.read(parts[sheet]))
    rows = []
    for row in root.iter(f"{_MAIN}row"):
        cells = {}
        for place, cell in enumerate(row.iter(f"{_MAIN}c")):
            reference = cell.get("r")
            cells[_column_number(reference) if reference else place] = _cell_value(cell, shared, dates, since_1904)
        rows.append(cells)
    if header:
        titles = {i: name for i, name in (rows[0] if rows else {}).items() if name is not None}
        return [{titles[i]: row.get(i) for i in sorted(titles)} for row in rows[1:]]
    return [{f"c{i}": v for i, v in sorted(row.items())} for row in rows]
