"""Structural groups of one text, as ``operators.structure`` finds them with windows.

Planning needs a whole text in one place anyway, so there the groups are found without a shuffle.
"""

from __future__ import annotations

import re
from itertools import groupby
from typing import NamedTuple

from marginalia.functions.dialect import N, S
from marginalia.operators.structure import HEADING_CHARS, HEADING_WORDS, NO_HEADING_END

_BULLET = re.compile(rf"{S}*(?:[-*+•]{S}+|\d+[.)]{S}+)")
_ATX = re.compile(rf"{S}{{0,3}}#{{1,6}}{S}+{N}")
_NUMBERED = re.compile(rf"{S}*\d+(?:\.\d+)*[.)]?{S}+{N}")
_LINE = re.compile(r"[^\n]*(?:\n|\Z)")


class Group(NamedTuple):
    start: int
    end: int
    kind: str
    items: list[int]


def _kind(line: str, next_line: str | None) -> str:
    text = line.strip()
    if not text:
        return "blank"
    if _ATX.match(line):
        return "heading"
    if _BULLET.match(line):
        return "list"
    bare = len(text) <= HEADING_CHARS and len(text.split()) <= HEADING_WORDS and text[-1] not in NO_HEADING_END and next_line is not None and not next_line.strip()
    if bare and (_NUMBERED.match(line) or text == text.title() and any(map(str.isalpha, text))):
        return "heading"
    return "paragraph"


def groups(text: str) -> list[Group]:
    """The groups of ``text`` in order, headings joined with the content after them."""
    at = [(m.start(), m.end()) for m in _LINE.finditer(text) if m.end() > m.start()]
    lines = [text[a:b].removesuffix("\n").removesuffix("\r") for a, b in at]
    kinds = [_kind(line, after) for line, after in zip(lines, [*lines[1:], None])]
    found: list[Group] = []
    numbered = enumerate(kinds)
    for kind, run in groupby(numbered, key=lambda x: (x[1], x[0] if x[1] == "heading" else -1)):
        if kind[0] != "blank":
            own = [i for i, _ in run]
            start, items = at[own[0]][0], [at[i][0] for i in own] if kind[0] == "list" else []
            if found and found[-1].kind == "heading" and kind[0] != "heading":
                start = found.pop().start
                found.append(Group(start, at[own[-1]][1], "heading_with_content", items))
            else:
                found.append(Group(start, at[own[-1]][1], kind[0], items))
    return found


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Hard boundaries (starts of groups, both ends of the text) and soft ones (items of lists)."""
    found = groups(text)
    return sorted({0, len(text), *(g.start for g in found[1:])}), sorted({i for g in found for i in g.items[1:]})
