"""Greedy planning of overlapping chunks over structural boundaries, one text at a time.

All positions where a piece may end or start are found once per text and kept sorted, so that every step
of the plan is a few binary searches.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from marginalia.errors import CHUNK
from marginalia.functions.dialect import S

_SENTENCE_END = re.compile(rf"[.!?](?={S}|\Z)")
_SPACE = re.compile(S)


@dataclass(frozen=True)
class ChunkingConfig:
    """Sizes in code points; ``min_chunk_chars`` unset means a quarter of the size, as far as the overlap leaves it."""

    max_chars: int = 3000
    overlap_chars: int = 300
    min_chunk_chars: int | None = None

    def __post_init__(self) -> None:
        sizes = [self.max_chars, self.overlap_chars] + ([] if self.min_chunk_chars is None else [self.min_chunk_chars])
        valid = all(type(x) is int for x in sizes) and self.max_chars > 0 and 0 <= self.overlap_chars < self.max_chars
        if not valid or (self.min_chunk_chars is not None and not 0 < self.min_chunk_chars <= self.max_chars - self.overlap_chars):
            raise CHUNK["invalid_config"](f"not 0 <= overlap < max, or not 0 < min <= max - overlap, in whole numbers: {self}")

    @property
    def least(self) -> int:
        """What every chunk must add to the one before it."""
        if self.min_chunk_chars is not None:
            return self.min_chunk_chars
        return max(1, min(self.max_chars // 4, self.max_chars - self.overlap_chars))


def _last(positions: list[int], above: int, upto: int) -> int | None:
    i = bisect_right(positions, upto)
    return positions[i - 1] if i and positions[i - 1] > above else None


def _first(positions: list[int], least: int, upto: int) -> int | None:
    i = bisect_left(positions, least)
    return positions[i] if i < len(positions) and positions[i] <= upto else None


class Planner:
    """The plan of one text; ``hard`` and ``soft`` are sorted boundary offsets."""

    def __init__(self, text: str, hard: list[int], soft: list[int], config: ChunkingConfig):
        self.n, self.hard, self.soft, self.config = len(text), hard, soft, config
        self.sentences = [m.end() for m in _SENTENCE_END.finditer(text)]
        self.spaces = [m.end() for m in _SPACE.finditer(text)]
        self.both = sorted({*hard, *soft})

    def _end(self, start: int, need: int | None) -> int:
        limit = min(self.n, start + self.config.max_chars)
        if limit == self.n:
            return limit
        end = _last(self.hard, start, limit) or _last(self.soft, start, limit) or _last(self.sentences, start + 1, limit) or _last(self.spaces, start + 1, limit) or limit
        if need is None or end >= need:
            return end
        if need > limit:
            return limit
        for positions, upto in ((self.hard, limit), (self.soft, limit), (self.sentences, limit), (self.spaces, limit - 1)):
            if (found := _first(positions, need, upto)) is not None:
                return found
        return need

    def _start(self, start: int, end: int) -> int:
        c = self.config
        if not c.overlap_chars:
            return end
        least = max(start + 1, end - (c.max_chars - c.least))
        target = max(least, end - c.overlap_chars)
        nearest = lambda found: min((x for x in found if x is not None), key=lambda x: (abs(x - target), x), default=None)
        if (best := nearest([_last(self.both, least - 1, target), _first(self.both, target, end - 1)])) is not None:
            return best
        target = min(target, end - 1)
        best = nearest([_last(self.spaces, least, target), _first(self.spaces, max(target, least + 1), end - 1)])
        return target if best is None else best

    def spans(self) -> list[tuple[int, int]]:
        """Chunks (start, end) that cover the text; a short rest is added to the last chunk."""
        found: list[tuple[int, int]] = []
        start = 0
        while start < self.n:
            need = found[-1][1] + self.config.least if found else None
            end = self._end(start, need)
            if end <= start:
                end = min(self.n, start + self.config.max_chars)
            if need is not None and end == self.n and end < need:
                found[-1] = (found[-1][0], end)
                break
            found.append((start, end))
            if end == self.n:
                break
            start = self._start(start, end)
        return found


def broken_rules(spans: list[tuple[int, int]], n: int, config: ChunkingConfig) -> list[str]:
    """The rules of a plan that ``spans`` break."""
    if not spans:
        return ["empty"]
    found = []
    if spans[0][0] != 0 or spans[-1][1] != n:
        found.append("cover")
    if any(not 0 <= a < b <= n for a, b in spans):
        found.append("range")
    if any(b - a > config.max_chars for a, b in spans[:-1]) or spans[-1][1] - spans[-1][0] > config.max_chars + config.least:
        found.append("size")
    for (a, b), (c, d) in zip(spans, spans[1:]):
        if c <= a:
            found.append("progress")
        if c > b:
            found.append("gap")
        if d <= b:
            found.append("end")
        elif d - b < config.least:
            found.append("contribution")
    return sorted(set(found))
