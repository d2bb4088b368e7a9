"""Workbooks in the Office Open XML format, written with the standard library.

Rows come from Spark one partition at a time and go straight to the file, so the
driver holds one partition's rows. Only what a table of results needs is written: text,
numbers, truth values and empty cells.
"""

from __future__ import annotations

import math
import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

#: Fixed value: rows of a sheet, the header among them.
MAX_ROWS = 1_048_576
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def _cell(value) -> str:
    if value is None or (isinstance(value, float) and not math.isfinite(value)):
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_CONTROL.sub("", str(value)))}</t></is></c>'


def _row(values) -> str:
    return f"<row>{''.join(map(_cell, values))}</row>"


def write_workbook(path: str, sheets: dict[str, DataFrame]) -> None:
    """One sheet for each frame, with a header; a frame that is too long for a sheet raises a ValueError."""
    for name, frame in sheets.items():
        if frame.limit(MAX_ROWS).count() == MAX_ROWS:
            raise ValueError(f"{name} has more rows than a sheet can hold; write Parquet or CSV")
    numbers = range(1, len(sheets) + 1)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="{_KIND}.worksheet+xml"/>' for n in numbers)
        book.writestr(
            "[Content_Types].xml",
            f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-'
            f'package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" '
            f'ContentType="{_KIND}.sheet.main+xml"/>{parts}</Types>',
        )
        link = lambda n, kind, target: f'<Relationship Id="rId{n}" Type="{_LINKS}/{kind}" Target="{target}"/>'
        around = lambda links: f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>'
        book.writestr("_rels/.rels", around(link(1, "officeDocument", "xl/workbook.xml")))
        book.writestr("xl/_rels/workbook.xml.rels", around("".join(link(n, "worksheet", f"worksheets/sheet{n}.xml") for n in numbers)))
        names = "".join(f'<sheet name="{escape(s)}" sheetId="{n}" r:id="rId{n}"/>' for n, s in zip(numbers, sheets, strict=True))
        book.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_LINKS}"><sheets>{names}</sheets></workbook>')
        for n, frame in zip(numbers, sheets.values(), strict=True):
            with book.open(f"xl/worksheets/sheet{n}.xml", "w", force_zip64=True) as out:
                out.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>{_row(frame.columns)}'.encode())
                for row in frame.toLocalIterator():
                    out.write(_row(row).encode())
                out.write(b"</sheetData></worksheet>")
