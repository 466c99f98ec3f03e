"""HTML to blocks: a tag state machine, run once for each document by an Arrow-batched function.

Texts belong to the innermost open block; a block is emitted when it closes, after the blocks inside it. Text
outside all blocks gathers in a buffer that the next block start emits. Tables give one block for each row with a
cell that isn't empty; tables in tables are left out. Headings name the section, their own included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Tags whose content is ignored, tags that make blocks, tags without content.
IGNORED = frozenset({"script", "style", "noscript"})
BLOCKS = frozenset({"p", "div", "li", "section", "article", "header", "footer", "h1", "h2", "h3", "h4", "h5", "h6"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
#: Blocks that a worker hands over at once.
TOGETHER = 10_000
SCHEMA = "position int, block_id string, block_type string, section string, text string, table_index int, row_index int, cell_values array<string>"

_ARROW = pa.schema({n: {"int": pa.int32(), "string": pa.string()}.get(t, pa.list_(pa.string())) for n, t in (x.split(" ") for x in SCHEMA.split(", "))})


def _clean(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


class _Machine(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.section: str | None = None
        self.ignoring = self.depth = self.tables = self.rows = self.paragraphs = 0
        self.open: list[tuple[str, list[str]]] = []
        self.loose: list[str] = []
        self.cells: list[str] | None = None
        self.cell: list[str] | None = None

    # -- what is emitted --
    def _paragraph(self, tag: str | None, parts: list[str]) -> None:
        text = _clean(parts)
        if not text:
            return
        if tag and tag[0] == "h" and tag[1:].isdigit():
            self.section = text
        self.paragraphs += 1
        self.blocks.append({"block_id": f"p{self.paragraphs:06d}", "block_type": "paragraph", "section": self.section, "text": text, "table_index": None, "row_index": None, "cell_values": None})

    def _flush(self) -> None:
        parts, self.loose = self.loose, []
        self._paragraph(None, parts)

    def _end_cell(self) -> None:
        if self.cell is not None and self.cells is not None and (text := _clean(self.cell)):
            self.cells.append(text)
        self.cell = None

    def _end_row(self) -> None:
        if self.cells is None:
            return
        self._end_cell()
        cells, self.cells = self.cells, None
        self.rows += 1
        if cells:
            self.blocks.append({"block_id": f"t{self.tables:06d}_r{self.rows:06d}", "block_type": "table_row", "section": self.section, "text": " | ".join(cells), "table_index": self.tables, "row_index": self.rows, "cell_values": cells})

    # -- what arrives --
    def _text(self, data: str) -> None:
        if self.depth:
            if self.depth == 1 and self.cell is not None:
                self.cell.append(data)
        elif self.open:
            self.open[-1][1].append(data)
        else:
            self.loose.append(data)

    def handle_data(self, data: str) -> None:
        if not self.ignoring:
            self._text(data)

    def handle_starttag(self, tag: str, attrs: object) -> None:
        if tag in IGNORED:
            self.ignoring += 1
        elif self.ignoring:
            return
        elif tag in VOID:
            if tag == "br":
                self._text(" ")
        elif tag == "table":
            if not self.depth:
                for at in range(len(self.open) - 1, -1, -1):  # open blocks go on after the table
                    inner, parts = self.open[at]
                    self.open[at] = (inner, [])
                    self._paragraph(inner, parts)
                self._flush()
                self.tables, self.rows = self.tables + 1, 0
            self.depth += 1
        elif self.depth == 1 and tag == "tr":
            self._end_row()
            self.cells = []
        elif self.depth == 1 and tag in ("td", "th"):
            self._end_cell()
            if self.cells is None:
                self.cells = []
            self.cell = []
        elif not self.depth and tag in BLOCKS:
            self._flush()
            self.open.append((tag, []))

    def handle_startendtag(self, tag: str, attrs: object) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in IGNORED:
            self.ignoring = max(0, self.ignoring - 1)
        elif self.ignoring:
            return
        elif tag == "table" and self.depth:
            if self.depth == 1:
                self._end_row()
            self.depth -= 1
        elif self.depth == 1 and tag in ("td", "th"):
            self._end_cell()
        elif self.depth == 1 and tag == "tr":
            self._end_row()
        elif not self.depth and any(t == tag for t, _ in self.open):
            while True:
                inner, parts = self.open.pop()
                self._paragraph(inner, parts)
                if inner == tag:
                    break

    def finish(self) -> list[dict]:
        self.close()
        if self.depth:
            self._end_row()
            self.depth = 0
        while self.open:
            self._paragraph(*self.open.pop())
        self._flush()
        return self.blocks


def decode_html(data: bytes) -> str:
    """By the charset that the first 8 KiB name, else UTF-8, else Windows-1251: the first that decodes."""
    named = re.search(rb"<meta\b[^>]*charset\s*=\s*['\"]?\s*([A-Za-z0-9._:-]+)", data[:8192], re.IGNORECASE)
    for name in [*([named[1].decode("ascii")] if named else []), "utf-8", "cp1251"]:
        try:
            return data.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("utf-8", "replace")


def read_html(content: str | bytes | None) -> tuple[list[dict], dict[str, int]]:
    """Blocks of one document, in order, and how many tables it has."""
    machine = _Machine()
    machine.feed(decode_html(bytes(content)) if isinstance(content, (bytes, bytearray, memoryview)) else content or "")
    return machine.finish(), {"tables": machine.tables}


def parse_html(content: str | bytes | None) -> list[dict]:
    return read_html(content)[0]


def html_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, position, block columns) of docs (doc_id, content string or binary)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([batch.schema.field("doc_id"), *_ARROW])
            held: list[dict] = []
            for row in batch.to_pylist():
                held += ({"doc_id": row["doc_id"], "position": i} | b for i, b in enumerate(parse_html(row["content"]), 1))
                if len(held) >= TOGETHER:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held = []
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return docs.select("doc_id", "content").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
