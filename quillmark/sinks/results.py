"""Audit results where they are wanted: CSV of the flags, CSV of the rows that need human eyes, and the flags in their
existing cells of a workbook, whose other parts stay byte for byte.

A workbook and its results are one file's rows, on the driver; the CSV writers are Spark's.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators.audit import review_queue
from quillmark.sources.office import column_number, sheet_members

# --- fixed values: heads of the columns, sources of a code, cells of the flags ---
FLAGS = {"row": "row", "ai": "AI (фольга не снята)", "aj": "AJ (нет DMC)", "ak": "AK (DMC не совпадает)", "an": "AN (итог)"}
REVIEW = {
    "row": "row", "review_reason": "Причина проверки", "decoded": "Распознанный DMC", "dmc_ref": "Эталон AE", "source": "Источник DMC", "ak": "AK", "ai": "AI", "an": "AN",
    "foil_status": "Статус фольги", "foil_confidence": "Foil confidence",
}
SOURCES, NO_SOURCE = {"AG": "AG", "AF": "AF (фоллбэк)"}, "—"
CELLS = {"ai": "AI", "aj": "AJ", "ak": "AK", "an": "AN"}
#: What a run that looked at codes alone leaves out.
FOIL_ONLY = ("ai", "an", "foil_status", "foil_confidence")


def _named(heads: dict[str, str], dmc_only: bool) -> dict[str, str]:
    return {k: v for k, v in heads.items() if not (dmc_only and k in FOIL_ONLY)}


def flags_table(evaluated: DataFrame, dmc_only: bool = False) -> DataFrame:
    """Rows in order with their flags, under the heads of the CSV."""
    return evaluated.select(*(F.col(k).alias(v) for k, v in _named(FLAGS, dmc_only).items())).orderBy("row")


def _of(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def review_table(evaluated: DataFrame, dmc_only: bool = False) -> DataFrame:
    """Rows in order that need human eyes, with the reason and what was found. decode_source and foil_confidence may lack."""
    names = F.create_map(*(F.lit(x) for pair in SOURCES.items() for x in pair))
    held = review_queue(evaluated)
    held = held.withColumns({"source": F.coalesce(F.element_at(names, _of(held, "decode_source")), F.lit(NO_SOURCE)), "foil_confidence": _of(held, "foil_confidence")})
    return held.select(*(F.col(k).alias(v) for k, v in _named(REVIEW, dmc_only).items())).orderBy("row")


def _cell(reference: str, old: str, value: str) -> str:
    style = re.search(r'\bs="\d+"', old.partition(">")[0])
    head = f'<c r="{reference}"' + (f" {style[0]}" if style else "")
    return f'{head} t="inlineStr"><is><t>{escape(value)}</t></is></c>' if value else f"{head}/>"


def _filled(row: str, number: int, values: dict[str, str]) -> str:
    head, _, body = row.partition(">")
    if head.endswith("/"):
        head, body = head[:-1], "</row>"
    cells = {column_number(m[1]): m[0] for m in re.finditer(r'<c\b[^>]*?\br="([A-Z]+)\d+"[^>]*?(?:/>|>.*?</c>)', body, re.DOTALL)}
    cells |= {column_number(letters): _cell(f"{letters}{number}", cells.get(column_number(letters), ""), value) for letters, value in values.items()}
    return f"{head}>" + "".join(cells[c] for c in sorted(cells)) + "</row>"


def fill_sheet(xml: str, values: dict[int, dict[str, str]]) -> str:
    """A sheet's XML with values {row: {letters: text}} in their cells, styles kept; rows that it lacks are put in order."""
    todo = dict(values)
    first = re.search(r"<sheetData\s*/>|<sheetData\b[^>]*>(.*?)</sheetData>", xml, re.DOTALL)
    if not first:
        raise ValueError("no rows in the sheet")
    rows: dict[int, str] = {}
    for m in re.finditer(r"<row\b[^>]*?(?:/>|>.*?</row>)", first[1] or "", re.DOTALL):
        told = re.search(r'\br="(\d+)"', m[0].partition(">")[0])
        number = int(told[1]) if told else max(rows, default=0) + 1
        rows[number] = _filled(m[0], number, todo.pop(number)) if number in todo else m[0]
    rows |= {n: _filled(f'<row r="{n}"/>', n, v) for n, v in todo.items()}
    return xml[: first.start()] + "<sheetData>" + "".join(rows[n] for n in sorted(rows)) + "</sheetData>" + xml[first.end() :]


def fill_workbook(data: bytes, sheet: str, flags: list[dict], cells: dict[str, str] | None = None, dmc_only: bool = False) -> bytes:
    """The workbook with each row's flags (row, ai, aj, ak, an) in its cells; a run that looked at codes alone leaves the
    others untouched. Nothing else changes."""
    wanted = _named(cells or CELLS, dmc_only)
    values = {f["row"]: {letters: f[k] or "" for k, letters in wanted.items()} for f in flags}
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        members = sheet_members(old)
        if sheet not in members:
            raise ValueError(f"no sheet named {sheet}")
        for item in old.infolist():
            content = old.read(item.filename)
            new.writestr(item, fill_sheet(content.decode("utf-8"), values).encode("utf-8") if item.filename == members[sheet] else content)
    return out.getvalue()
