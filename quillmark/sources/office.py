"""DOCX and XLSX to blocks, with the standard library's zip and XML readers alone."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Characters up to which a row's only cell names a section.
SECTION_CHARS = 120


def _clean(text: str) -> str:
    return " ".join(text.split())


def _block(kind: str, number: str, section: str | None, text: str, **more: object) -> dict:
    return {"block_id": number, "block_type": kind, "section": section, "text": text, "table_index": None, "row_index": None, "cell_values": None, **more}


# --- docx ---
def _run_text(element: ET.Element) -> str:
    out = []
    for e in element.iter():
        if e.tag == W + "t":
            out.append(e.text or "")
        elif e.tag in (W + "tab", W + "br", W + "cr"):
            out.append(" ")
    return "".join(out)


def _headings(package: zipfile.ZipFile) -> set[str]:
    """Ids of the styles whose name begins with Heading or holds its Russian form."""
    if "word/styles.xml" not in package.namelist():
        return set()
    out = set()
    for style in ET.fromstring(package.read("word/styles.xml")).iter(W + "style"):
        name = style.find(W + "name")
        label = name.get(W + "val", "") if name is not None else ""
        if label.lower().startswith("heading") or "заголовок" in label.lower():
            out.add(style.get(W + "styleId", ""))
    return out


def _is_heading(paragraph: ET.Element, named: set[str]) -> bool:
    style = paragraph.find(f"{W}pPr/{W}pStyle")
    value = style.get(W + "val", "") if style is not None else ""
    return value in named or value.lower().startswith("heading")


def docx_blocks(data: bytes) -> list[dict]:
    return read_docx(data)[0]


def read_docx(data: bytes) -> tuple[list[dict], dict[str, int]]:
    """Paragraphs and table rows in the order of the body, and how many tables it has, those without text included. A
    heading names the section, its own included; a merged cell counts once; tables in cells are left out; rows without
    text give nothing but keep their number."""
    out: list[dict] = []
    with zipfile.ZipFile(io.BytesIO(data)) as package:
        named = _headings(package)
        body = ET.fromstring(package.read("word/document.xml")).find(W + "body")
        section, paragraphs, tables = None, 0, 0
        for element in body if body is not None else ():
            if element.tag == W + "p":
                if text := _clean(_run_text(element)):
                    section = text if _is_heading(element, named) else section
                    paragraphs += 1
                    out.append(_block("paragraph", f"p{paragraphs:06d}", section, text))
            elif element.tag == W + "tbl":
                tables += 1
                for row, tr in enumerate(element.findall(W + "tr"), 1):
                    cells = [_cell_text(tc) for tc in tr.findall(W + "tc") if not _continues(tc)]
                    if kept := [c for c in cells if c]:
                        out.append(_block("table_row", f"t{tables:06d}_r{row:06d}", section, " | ".join(kept), table_index=tables, row_index=row, cell_values=kept))
    return out, {"tables": tables}


def _cell_text(cell: ET.Element) -> str:
    return _clean(" ".join(_run_text(p) for p in cell.findall(W + "p")))


def _continues(cell: ET.Element) -> bool:
    """Whether a cell goes on from the row above."""
    merge = cell.find(f"{W}tcPr/{W}vMerge")
    return merge is not None and merge.get(W + "val", "continue") == "continue"


# --- xlsx ---
def column_number(reference: str) -> int:
    """From 1: A is 1, AA is 27."""
    n = 0
    for c in re.match(r"[A-Za-z]*", reference)[0].upper():  # type: ignore[index]
        n = n * 26 + ord(c) - 64
    return n


def format_number(text: str) -> str:
    """Whole numbers without a fraction, others with up to 15 significant digits, no negative zero."""
    try:
        value = float(text)
    except ValueError:
        return text
    if value != value or value in (float("inf"), float("-inf")):
        return text
    return str(int(value)) if value == int(value) else f"{value:.15g}"


def _shared(package: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in package.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter(S + "t")) for si in ET.fromstring(package.read("xl/sharedStrings.xml")).findall(S + "si")]


def _sheets(package: zipfile.ZipFile) -> list[tuple[str, str, bool]]:
    """(name, member, visible) in order."""
    targets = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(package.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ET.fromstring(package.read("xl/workbook.xml")).iter(S + "sheet"):
        target = targets.get(sheet.get(R + "id"), "")
        member = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        out.append((sheet.get("name", ""), member, sheet.get("state", "visible") == "visible"))
    return out


def sheet_members(package: zipfile.ZipFile) -> dict[str, str]:
    """The file of each sheet by its name."""
    return {n: m for n, m, _ in _sheets(package)}


def _cell_value(cell: ET.Element, shared: list[str]) -> str:
    kind, value = cell.get("t", "n"), cell.findtext(S + "v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(S + "t"))
    if value is None:
        return ""
    if kind == "s":
        return shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
    if kind == "b":
        return "true" if value.strip() == "1" else "false"
    return format_number(value) if kind == "n" else value


def sheet_rows(package: zipfile.ZipFile, member: str, shared: list[str], columns: frozenset[int] | None = None) -> Iterator[tuple[int, dict[int, str]]]:
    """(row number, {column: value}) of a sheet, read as a stream; only wanted columns are decoded. A HYPERLINK
    formula counts as its address."""
    number = 0
    with package.open(member) as stream:
        rows: ET.Element | None = None
        for event, element in ET.iterparse(stream, events=("start", "end")):
            if event == "start":
                rows = element if element.tag == S + "sheetData" else rows
                continue
            if element.tag != S + "row":
                continue
            number = int(element.get("r", number + 1))
            values: dict[int, str] = {}
            last = 0
            for cell in element.findall(S + "c"):
                last = column_number(cell.get("r", "")) or last + 1
                if columns is not None and last not in columns:
                    continue
                link = re.match(r'\s*=?\s*HYPERLINK\(\s*"([^"]*)"', cell.findtext(S + "f") or "", re.IGNORECASE)
                if value := (link[1] if link else _clean(_cell_value(cell, shared))):
                    values[last] = value
            yield number, values
            if rows is not None:
                rows.clear()  # else every row that was read stays


def xlsx_blocks(data: bytes) -> list[dict]:
    return read_xlsx(data)[0]


def read_xlsx(data: bytes) -> tuple[list[dict], dict[str, int]]:
    """Rows of visible sheets that have a value, and how many visible sheets there are. A row whose only cell is short
    names the section, its own included."""
    out: list[dict] = []
    with zipfile.ZipFile(io.BytesIO(data)) as package:
        shared = _shared(package)
        visible = [(n, m) for n, m, v in _sheets(package) if v]
        for index, (name, member) in enumerate(visible, 1):
            section, row = None, 0
            for number, values in sheet_rows(package, member, shared):
                if not values:
                    continue
                row += 1
                cells = [values[c] for c in sorted(values)]
                if len(cells) == 1 and len(cells[0]) <= SECTION_CHARS:
                    section = cells[0]
                out.append(_block("table_row", f"s{index:06d}_r{row:06d}", section, " | ".join(cells), table_index=index, row_index=row, cell_values=cells, sheet_name=name, excel_row_index=number))
    return out, {"sheets": len(visible)}


def xlsx_records(data: bytes, sheet: str, columns: dict[str, str], skip_rows: int = 1) -> Iterator[dict]:
    """{row, name: value or null} of one sheet for columns {letters: name}, after a header; rows without any are left out."""
    wanted = {column_number(letters): name for letters, name in columns.items()}
    with zipfile.ZipFile(io.BytesIO(data)) as package:
        members = sheet_members(package)
        if sheet not in members:
            raise ValueError(f"no sheet named {sheet}")
        for number, values in sheet_rows(package, members[sheet], _shared(package), frozenset(wanted)):
            if number > skip_rows and values:
                yield {"row": number} | {name: values.get(c) for c, name in wanted.items()}
