"""Text and properties of DOCX files with the standard library: a ZIP of XML parts."""

from __future__ import annotations

import io
import zipfile
from datetime import datetime
from xml.etree import ElementTree

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# The core properties in a DOCX and the names they get here.
PROPERTIES = {
    "creator": "author", "category": "category", "description": "comments", "contentStatus": "content_status", "created": "created", "identifier": "identifier", "keywords": "keywords",
    "language": "language", "lastModifiedBy": "last_modified_by", "lastPrinted": "last_printed", "modified": "modified", "revision": "revision", "subject": "subject", "title": "title", "version": "version",
}
_DATES = {"created", "modified", "last_printed"}
# Elements within a run that stand for a character.
_MARKS = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-", f"{_W}ptab": "\t"}


def _paragraph(p: ElementTree.Element) -> str:
    parts = []
    for child in p:
        runs = [child] if child.tag == f"{_W}r" else child.findall(f"{_W}r") if child.tag == f"{_W}hyperlink" else []
        for run in runs:
            for x in run:
                if x.tag == f"{_W}t":
                    parts.append(x.text or "")
                elif x.tag == f"{_W}br" and x.get(f"{_W}type") in ("page", "column"):
                    continue
                else:
                    parts.append(_MARKS.get(x.tag, ""))
    return "".join(parts)


def _cells(row: ElementTree.Element) -> list[str]:
    found = []
    for cell in row.findall(f"{_W}tc"):
        text = "\n".join(_paragraph(p) for p in cell.findall(f"{_W}p"))
        span = cell.find(f"{_W}tcPr/{_W}gridSpan")
        found += [text] * (int(span.get(f"{_W}val", "1")) if span is not None else 1)
    return found


def read(content: bytes) -> tuple[str, dict[str, str]]:
    """Text (paragraphs and table rows in order, cells parted by tabs, empty blocks left out) and properties.

    Raises an error for what is no DOCX; empty properties are left out, times are in ISO form.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        core = ElementTree.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in z.namelist() else []
    blocks: list[str] = []
    for block in body if body is not None else []:
        if block.tag == f"{_W}p":
            blocks.append(_paragraph(block))
        elif block.tag == f"{_W}tbl":
            blocks += ["\t".join(_cells(row)) for row in block.findall(f"{_W}tr")]
    properties = {}
    for x in core:
        name = PROPERTIES.get(x.tag.rpartition("}")[2])
        if name and x.text:
            properties[name] = datetime.fromisoformat(x.text).isoformat() if name in _DATES else x.text
    return "\n".join(b for b in blocks if b), properties
