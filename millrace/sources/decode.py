"""Decoding of CSV and workbook bytes to rows of typed cells, and writing of workbooks. Plain Python over the bytes of one file."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

#: Texts that mean an empty CSV cell; number formats that mean a date.
NULLS = frozenset(["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"])
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
CSV_SHEET = "CSV"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
Cell = tuple[str, str | None, float | None] | None


def csv_rows(data: bytes, encoding: str = "utf-8-sig") -> Iterator[list[Cell]]:
    """Rows with the width of the first line; wider rows are skipped, blank lines too (also above the header, so none is counted twice)."""
    width = None
    for row in csv.reader(io.StringIO(data.decode(encoding, "replace"), newline="")):
        if not row or (len(row) == 1 and not row[0].strip()):
            continue
        width = width or len(row)
        if len(row) <= width:
            yield [None if x in NULLS else ("s", x, None) for x in row + [""] * (width - len(row))]


def _strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ET.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in root.findall(f"{_MAIN}si")]


def is_date_code(code: str) -> bool:
    """Whether a number format shows a date or time."""
    return bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code), re.I)) and code.lower() != "general"


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{_MAIN}numFmt")}
    dates = DATE_FORMATS | {k for k, code in own.items() if is_date_code(code)}
    formats = root.find(f"{_MAIN}cellXfs")
    return {i for i, x in enumerate(formats if formats is not None else []) if int(x.get("numFmtId", 0)) in dates}


def sheet_names(data: bytes) -> list[tuple[str, str]]:
    """(name, part) of each sheet in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheets = ET.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}sheets")
        return [(s.get("name"), t.lstrip("/") if (t := links[s.get(f"{_REL}id")]).startswith("/") else f"xl/{t}") for s in sheets]


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def number_cell(x: float, date: bool) -> Cell:
    """A number, or the date that it shows as; beyond the calendar a number."""
    if date and -693593 <= x < 2958466:
        return "d", (datetime(1899, 12, 30) + timedelta(seconds=round(x * 86400))).isoformat(sep=" "), x
    return "n", _number(x), x


def _cell(c, strings: list[str], dates: set[int]) -> Cell:
    """A cell by its type; errors (#N/A and the like) are empty, booleans are kind b."""
    kind, v = c.get("t", "n"), c.find(f"{_MAIN}v")
    if kind == "inlineStr":
        text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
        return ("s", text, None) if text else None
    if v is None or v.text is None or kind == "e":
        return None
    if kind == "s":
        return "s", strings[int(v.text)], None
    if kind in ("str", "d"):
        return "s", v.text, None
    if kind == "b":
        return "b", "True" if v.text == "1" else "False", float(v.text)
    return number_cell(float(v.text), int(c.get("s", 0)) in dates)


def xlsx_rows(data: bytes, part: str) -> Iterator[list[Cell]]:
    """Rows of a sheet, empty ones where numbers are skipped, read as a stream."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        strings, dates, at = _strings(book), _date_styles(book), 0
        with book.open(part) as f:
            for _, row in ET.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                for _ in range(at, int(row.get("r", at + 1)) - 1):
                    yield []
                    at += 1
                cells: list[Cell] = []
                for c in row.findall(f"{_MAIN}c"):
                    k = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (k - len(cells))
                    cells.append(_cell(c, strings, dates))
                yield cells
                at += 1
                row.clear()


def write_xlsx(header: list[str], rows: Iterator[list], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet: numbers as numbers, other values as text, nulls as empty cells."""
    name = lambda k: (name(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)
    clean = lambda v: re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))

    def line(r: int, values: list) -> str:
        cells = []
        for k, v in enumerate(values):
            if v is None:
                continue
            at = f'r="{name(k)}{r}"'
            cells.append(f"<c {at}><v>{v!r}</v></c>" if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) != float("inf") else f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(clean(v))}</t></is></c>')
        return f'<row r="{r}">{"".join(cells)}</row>'

    out = io.BytesIO()
    main, rel, pack = _MAIN[1:-1], _REL[1:-1], "http://schemas.openxmlformats.org/package/2006"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<worksheet xmlns="{main}"><sheetData>{line(1, header)}'.encode())
            for r, values in enumerate(rows, 2):
                f.write(line(r, values).encode())
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()
