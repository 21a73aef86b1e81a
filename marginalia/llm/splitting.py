"""Splitting texts above a size limit at natural boundaries, and checking pieces against the same rules.

Positions where a text may be cut carry penalties: none at a blank line, more at a line end, a sentence
end, a gap between words, and most within a word. ``split`` finds by dynamic programming over the
boundary positions the pieces whose penalties and differences of size cost least, under the maximum length
and with the specified overlap; ``audit`` holds stored pieces, which other means made, against the rules that such a
split keeps, and reports those that break them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions.dialect import N, S
from marginalia.runtime import spread

#: Cost of a cut, by the kind of boundary.
PARAGRAPH, LINE, SENTENCE, WORD, INSIDE = 0.0, 1.0, 2.0, 6.0, 1000.0
#: Cost of a piece that uses none of the allowed length; falls with the square of what it uses.
IMBALANCE = 4.0
#: Stored pieces of one text that are checked together; a text travels once for so many.
PIECES = 4096

_PARAGRAPH = re.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*(?:\r\n|\r|\n)\s*")
_LINE = re.compile(r"(?:\r\n|\r|\n)\s*")
_SENTENCE = re.compile(rf"[.!?…][\"'”’»)\]]*{S}+")
_WORD = re.compile(rf"{S}+")
_TEXT = re.compile(N)


class Limits(NamedTuple):
    max_chars: int
    overlap_chars: int


class CutGraph:
    """The boundary positions of one text, their penalties, and which pieces may follow each other."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def natural(self) -> dict[int, float]:
        """Penalties of the natural boundaries by position."""
        found: dict[int, float] = {}
        for pattern, penalty in ((_SENTENCE, SENTENCE), (_LINE, LINE), (_PARAGRAPH, PARAGRAPH)):
            for m in pattern.finditer(self.text):
                if 0 < m.end() < len(self.text):
                    found[m.end()] = penalty
        return found

    def inside_word(self, start: int, end: int) -> bool:
        """Whether a piece ends between two non-space characters although it holds white space."""
        t = self.text
        return 0 < end < len(t) and not t[end - 1].isspace() and not t[end].isspace() and _WORD.search(t, max(start, 0), end) is not None

    @cached_property
    def gaps(self) -> list[int]:
        """The ends of all white space within the text."""
        return [m.end() for m in _WORD.finditer(self.text) if m.end() < len(self.text)]

    def defects(self, previous_end: int | None, start: int, end: int, piece: str | None, limits: Limits) -> list[str]:
        """The rules that a piece (``piece``: the MD5 of its text) breaks after its predecessor; ``split`` breaks none."""
        found = []
        if limits.max_chars is not None and end - start > limits.max_chars:
            found.append("too_long")
        if piece is None or start < 0 or end < start or piece != hashlib.md5(self.text[start:end].encode(), usedforsecurity=False).hexdigest():
            found.append("offset")
        if self.inside_word(start, end):
            found.append("inside_word")
        if previous_end is not None and start > previous_end:
            found.append("gap")
        if previous_end is not None and limits.overlap_chars is not None and start < previous_end - limits.overlap_chars:
            found.append("overlap")
        return found

    def positions(self, limits: Limits) -> tuple[list[int], list[float]]:
        """Boundary positions and penalties for ``limits``.

        Natural boundaries all count. Where two neighbours lie so far apart that no piece with its overlap
        could reach from one to the next, the gaps between words count too, and where words are as long, every character.
        """
        reach = max(1, limits.max_chars - limits.overlap_chars)
        marks = [0, *sorted(self.natural), len(self.text)]
        found = dict(self.natural)
        for a, b in zip(marks, marks[1:]):
            if b - a > reach:
                words = [a, *(m.end() for m in _WORD.finditer(self.text, a, b) if m.end() < b), b]
                found |= {w: WORD for w in words[1:-1]}
                for c, d in zip(words, words[1:]):
                    if d - c > reach:
                        found |= dict.fromkeys(range(c + 1, d), INSIDE)
        at = sorted(found)
        return [*at, len(self.text)], [*(found[p] for p in at), 0.0]

    def split(self, limits: Limits) -> list[tuple[int, int]]:
        """Pieces (start, end) from 0 to the end of the text, each at most ``max_chars`` long.

        A piece starts at the best natural boundary (least penalty, then the earliest) within ``overlap_chars`` before the
        end of its predecessor, else at the earliest gap between words there, else exactly ``overlap_chars`` before it.
        Pieces cover the text and move forward.
        """
        n = len(self.text)
        if n <= limits.max_chars:
            return [(0, n)] if n else []
        ends, cost = self.positions(limits)
        starts = [0, *self.starts(ends, limits)]  # they don't decrease
        pen = np.array(cost)
        from_ = np.array(starts)  # start of the piece that follows end k - 1
        best = np.full(len(ends) + 1, np.inf)
        best[0] = 0.0
        back = np.zeros(len(ends) + 1, np.int64)
        for k, end in enumerate(ends):
            # predecessors whose next piece would end here within the limit, and start before the piece after it does
            lo = bisect_left(starts, end - limits.max_chars, 0, k + 1)
            hi = bisect_left(starts, starts[k + 1], lo, k + 1) if end < n else k + 1
            length = end - from_[lo:hi]
            ways = best[lo:hi] + IMBALANCE * (1 - length / limits.max_chars) ** 2
            if len(ways):
                j = int(np.argmin(ways))
                best[k + 1] = ways[j] + pen[k]
                back[k + 1] = lo + j
        pieces, k = [], len(ends)
        while k:
            j = int(back[k])
            pieces.append((starts[j], ends[k - 1]))
            k = j
        return pieces[::-1]

    def starts(self, ends: list[int], limits: Limits) -> list[int]:
        """Where the piece after each of ``ends`` (ascending) starts; linear, as the best boundary only moves on."""
        if not limits.overlap_chars:
            return ends
        natural = sorted(self.natural.items())
        found, ahead, window = [], 0, deque()  # window: boundaries that may still become the best, costs ascending
        for end in ends:
            while ahead < len(natural) and natural[ahead][0] < end:
                while window and window[-1][1] > natural[ahead][1]:
                    window.pop()
                window.append(natural[ahead])
                ahead += 1
            first = end - limits.overlap_chars
            while window and window[0][0] < first:
                window.popleft()
            if window:
                found.append(window[0][0])
            else:
                k = bisect_left(self.gaps, max(first, 1))
                found.append(self.gaps[k] if k < len(self.gaps) and self.gaps[k] < end else max(first, 1))
        return found


def split(df: DataFrame, id_col: str, text_col: str, max_col: str, overlap_col: str) -> DataFrame:
    """Pieces of every text: (``id_col``, piece_index, start_char, end_char), offsets in code points.

    A text within its limit is one piece; null and empty texts have none. A null or invalid limit (not
    0 <= overlap < max) leaves the text whole, as one piece. Repeated rows are split alike, each for itself. Narrow.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    rows = spread(df.select(df[id_col].alias("id"), df[text_col].alias("text"), df[max_col].cast("int").alias("m"), df[overlap_col].cast("int").alias("o")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, index, lo, hi = [], [], [], []
            for i, (text, m, o) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))):
                if not text:
                    continue
                fit = m is not None and len(text) <= m or m is None or o is None or not 0 <= o < m
                for k, (a, b) in enumerate([(0, len(text))] if fit else CutGraph(text).split(Limits(m, o))):
                    owner.append(i), index.append(k), lo.append(a), hi.append(b)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int32()) for x in (index, lo, hi))], names=["id", "piece_index", "start_char", "end_char"]
            )

    return rows.mapInArrow(run, f"id {id_type}, piece_index int, start_char int, end_char int").withColumnRenamed("id", id_col)


def audit(chunks: DataFrame, documents: DataFrame, configs: DataFrame, pieces: int = PIECES) -> DataFrame:
    """(parsed_id, chunk_index, defect) of stored chunks, each held against the one before it.

    Chunks delivered again (equal in the columns read) count once; chunks without a document, and those
    with a null index or offset, are left out; a null text breaks ``offset``. A document without a configuration has
    no limits, so ``too_long`` and ``overlap`` cannot be broken. Chunks with one index are ordered by start.

    Chunks travel without their texts, whose hashes are compared. A document's chunks go in groups of ``pieces``, each
    with the end of the one before it, so a document with very many of them isn't collected as a whole. Built-in
    functions could express the rules, but find a position by counting characters from a text's beginning, for every
    chunk anew.
    """
    rows = chunks.where("chunk_index IS NOT NULL AND start_char IS NOT NULL AND end_char IS NOT NULL").select("parsed_id", "chunk_index", "start_char", "end_char", F.md5("text").alias("hash")).distinct()
    order = Window.partitionBy("parsed_id").orderBy("chunk_index", "start_char", "end_char", "hash")
    rows = rows.withColumn("previous", F.lag("end_char").over(order)).withColumn("part", F.floor((F.row_number().over(order) - 1) / pieces))
    lists = rows.groupBy("parsed_id", "part").agg(F.collect_list(F.struct("chunk_index", "start_char", "end_char", "hash", "previous")).alias("chunks"))
    limits = configs.select("config_id", "max_chars", "overlap_chars")
    docs = documents.select("parsed_id", "extracted_text", "config_id").where("extracted_text IS NOT NULL").join(limits, "config_id", "left")
    joined = lists.join(docs, "parsed_id").select("parsed_id", "extracted_text", "max_chars", "overlap_chars", "chunks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for pid, text, m, o, stored in zip(*(c.to_pylist() for c in batch.columns)):
                graph = CutGraph(text)
                for c in stored:
                    for d in graph.defects(c["previous"], c["start_char"], c["end_char"], c["hash"], Limits(m, o)):
                        found.append((pid, c["chunk_index"], d))
            a, b, c_ = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int32()), pa.array(c_, pa.string())], names=["parsed_id", "chunk_index", "defect"])

    return joined.mapInArrow(run, "parsed_id string, chunk_index int, defect string").distinct()
