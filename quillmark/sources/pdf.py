"""PDF page texts to blocks. Page text needs the optional pypdf; all that follows is plain text work."""

from __future__ import annotations

import re

#: Lines that only number pages, and numbered headings.
PAGE_LINE = re.compile(r"(?:стр(?:\.|аница)?|page|лист)?\s*\d+(?:\s*(?:из|of|/)\s*\d+)?", re.IGNORECASE)
NUMBERED = re.compile(r"\d+(?:\.\d+)*\.?\s+\S")
SECTION_CHARS = 120


def page_texts(data: bytes) -> list[str | None]:
    """Text of each page; an encrypted file is tried with an empty password."""
    try:
        from pypdf import PdfReader
    except ModuleNotFoundError as e:
        raise RuntimeError("pypdf is required to read PDF files") from e
    import io

    reader = PdfReader(io.BytesIO(data))
    if reader.is_encrypted and not reader.decrypt(""):
        raise RuntimeError("Unable to decrypt PDF file with empty password")
    return [page.extract_text() for page in reader.pages]


def read_pdf(data: bytes) -> tuple[list[dict], dict[str, int]]:
    """Blocks, and how many pages there are and how many of them have no text."""
    pages = page_texts(data)
    return blocks_of_pages(pages), {"pages": len(pages), "empty_pages": sum(not (p or "").strip() for p in pages)}


def is_section(text: str) -> bool:
    if len(text) > SECTION_CHARS or PAGE_LINE.fullmatch(text):
        return False
    return (text.upper() == text and any(map(str.isalpha, text))) or bool(NUMBERED.match(text))


def blocks_of_pages(pages: list[str | None]) -> list[dict]:
    """Paragraphs between blank lines, without page numbers; the section goes on over pages."""
    out: list[dict] = []
    section = None
    for number, page in enumerate(pages, 1):
        lines = [" ".join(x.split()) for x in (page or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")]
        for paragraph in re.split(r"\n{2,}", "\n".join(lines)):
            text = " ".join(paragraph.split())
            if not text or PAGE_LINE.fullmatch(text):
                continue
            section = text if is_section(text) else section
            out.append({"block_id": f"p{len(out) + 1:06d}", "block_type": "paragraph", "section": section, "text": text, "table_index": None, "row_index": None, "cell_values": None, "page_number": number})
    return out
