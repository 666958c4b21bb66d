"""Small spreadsheets (Office Open XML) by the standard library: values only, read and written on the driver."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import date, datetime
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

# Names of the format.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_SHEET_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"
_BOOK_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _column(k: int) -> str:
    name = ""
    while k >= 0:
        k, letter = k // 26 - 1, chr(65 + k % 26)
        name = letter + name
    return name


def _place(ref: str) -> int:
    k = 0
    for c in ref:
        if not c.isalpha():
            break
        k = 26 * k + ord(c.upper()) - 64
    return k - 1


def _cell(ref: str, v) -> str:
    if v is None or isinstance(v, float) and v != v:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    text = v.isoformat(" ") if isinstance(v, datetime) else v.isoformat() if isinstance(v, date) else str(v)
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(_CONTROL.sub("", text))}</t></is></c>'


def write(sheets: list[tuple[str, list[list]]]) -> bytes:
    """A workbook of (title, rows)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{_SHEET_TYPE}"/>' for k in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_BOOK_TYPE}"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name={quoteattr(title[:31])} sheetId="{k}" r:id="rId{k}"/>' for k, (title, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Type="{_REL}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>')
        for k, (_, rows) in enumerate(sheets, 1):
            body = "".join(f'<row r="{i}">{"".join(_cell(f"{_column(j)}{i}", v) for j, v in enumerate(row))}</row>' for i, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def _text(e) -> str:
    return "".join(t.text or "" for t in e.iter(f"{{{_MAIN}}}t"))


def titles(data: bytes) -> dict[str, str]:
    """The part of each sheet, by title, in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    part = lambda target: target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return {s.get("name"): part(links[s.get(f"{{{_REL}}}id")]) for s in book.iter(f"{{{_MAIN}}}sheet")}


def rows(data: bytes, title: str):
    """The cells of a sheet, row by row: text, numbers, true or false, or None. Dates are day numbers."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = [_text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{{{_MAIN}}}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        with z.open(titles(data)[title]) as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag != f"{{{_MAIN}}}row":
                    continue
                out: list = []
                for c in e.iter(f"{{{_MAIN}}}c"):
                    at, kind, v = _place(c.get("r", "")), c.get("t", "n"), c.find(f"{{{_MAIN}}}v")
                    at = len(out) if at < 0 else at
                    out += [None] * (at + 1 - len(out))
                    raw = None if v is None else v.text
                    if kind == "inlineStr":
                        out[at] = _text(c)
                    elif raw is not None:
                        out[at] = shared[int(raw)] if kind == "s" else raw == "1" if kind == "b" else raw if kind in ("str", "e", "d") else float(raw) if re.search(r"[.eE]", raw) else int(raw)
                yield out
                e.clear()
