"""Repair of text from scanned pages.

Three things are done, each over all documents: page furniture (running heads and page numbers) is found
from its recurrence page by page; words broken over lines are joined where the corpus knows the joined
word; misread words are corrected by a symmetric-delete index over the corpus' frequency lexicon, weighing
edits by pairs of characters that scanners confuse, and by the neighbouring words.

The index is asked about different words, not about every occurrence: only words for which it knows a correction
leave the pass over the scans' lines, with their neighbours. All decisions are ratios of counts, so they
are the same for a corpus ten thousand times as large.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Collection, Iterator
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.sketch import Bits
from marginalia.runtime import spread, stage

# What is printed and what scanners read for it, with the cost of the confusion.
CONFUSIONS = {
    ("l", "1"): 0.5, ("i", "1"): 0.6, ("I", "1"): 0.5, ("l", "I"): 0.5, ("I", "l"): 0.5, ("i", "l"): 0.8, ("o", "0"): 0.5, ("O", "0"): 0.5, ("s", "5"): 0.5, ("S", "5"): 0.5,
    ("g", "9"): 0.5, ("b", "6"): 0.6, ("B", "8"): 0.5, ("z", "2"): 0.6, ("Z", "2"): 0.6, ("0", "O"): 0.5, ("0", "o"): 0.6, ("1", "l"): 0.5, ("1", "I"): 0.5, ("5", "S"): 0.5,
    ("5", "s"): 0.6, ("2", "Z"): 0.5, ("8", "B"): 0.5, ("9", "g"): 0.6, ("6", "b"): 0.6, ("e", "c"): 0.7, ("c", "e"): 0.8, ("t", "f"): 0.8, ("f", "t"): 0.9, ("h", "b"): 0.8, ("b", "h"): 0.9,
    ("a", "o"): 0.9, ("o", "a"): 1.0, ("m", "rn"): 0.6, ("rn", "m"): 0.7, ("d", "cl"): 0.6, ("cl", "d"): 0.7, ("w", "vv"): 0.5, ("u", "ii"): 0.6, ("n", "ri"): 0.7, ("ri", "n"): 0.8,
    ("i", "!"): 0.5, ("l", "!"): 0.7, ("I", "!"): 0.6, ("i", "|"): 0.6, ("l", "|"): 0.5, ("I", "|"): 0.5, ("h", "li"): 0.7, ("li", "h"): 0.7, ("nn", "rm"): 0.7, ("rm", "nn"): 0.9, ("M", "RN"): 0.8, ("n", "u"): 1.0, ("u", "n"): 1.0, ("O", "Q"): 1.0, ("E", "F"): 1.0,
}
#: Hyphens that only a broken word has, and the plain one, which compounds have too.
BREAK_SIGNS = "¬­‐"
HYPHENS = "-" + BREAK_SIGNS
#: Width of a printed line that at least half of a scanned text has at most; other lines may be wider.
WIDEST = 100
#: Edits that the index reaches, and the greatest cost of a correction.
DELETES, GREATEST_COST = 2, 1.7
#: Longer words are found by their segments: what deletions leave of them grows as the square of their length.
LONG = 32
#: How many times as frequent as the word read (in documents) its correction must be, before confusion cost and context.
RATIO = 4.0
#: Most bits of the filters of words and of word pairs that are looked for; full ones only let more through.
FILTER_BITS = 1 << 28

_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
#: A word as read, which may hold signs that stand for letters.
_READ = re.compile(r"[!|]?[^\W_]+(?:['’!|][^\W_]+)*")
_COMPOUND = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
_LETTERS = re.compile(r"[^\W\d_]+")
_SIGNS = re.compile(r"[!|]")
_SENTENCE_END = re.compile(r"[.!?:;…][\"'”’»)\]]*\s*$")
_END = re.compile(rf"((?:[^\W_]|[!|](?=[^\W_]))+)([{HYPHENS}])\s*$")
_FIRST = re.compile(r"\s*((?:[^\W_]|[!|](?=[^\W_]))+)")
# What is around a page number.
_NUMBERS = [
    (k, re.compile(p, re.IGNORECASE))
    for k, p in (("bare", r"([\dlIOSBZ]+)"), ("roman", r"([ivxlc]+)"), ("brackets", r"[\[(]\s*(\w+)\s*[\])]"), ("page", r"(?:page|p\.|seite|página|pág\.|s\.)\s*(\w+)"), ("dashes", r"[-–—]\s*(\w+)\s*[-–—]"), ("of", r"(?:page\s+)?(\w+)\s*(?:/|of|von|sur|de)\s*\w+"))
]
_DIGITS = str.maketrans("lIOoSBZ", "1100582")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def _value(number: str) -> int | None:
    digits = number.translate(_DIGITS)
    if digits.isdecimal() and len(digits) < 1000 and any(c.isdigit() for c in number + ("0" if set(number) <= set("lIO") and len(number) > 1 else "")):
        return int(digits)
    return None


def _roman(number: str) -> int | None:
    total, most = 0, 0
    for c in reversed(number.lower()):
        v = _ROMAN.get(c)
        if v is None:
            return None
        total += v if v >= most else -v
        most = max(most, v)
    return total


def page_numbers(line: str) -> list[tuple[str, int]]:
    """The ways to read a line as nothing but a page number: (style, value)."""
    found = []
    text = line.strip()
    for style, pattern in _NUMBERS if text and len(text.split()) <= 4 else ():  # no form has more parts
        if m := pattern.fullmatch(text):
            for v in {_value(m[1]), _roman(m[1])} - {None}:
                found.append((style, v))
    return found


_HEAD_LEFT = re.compile(r"([\dlIOSBZ]+|[ivxlc]+)\s{1,}(\S.*)")
_HEAD_RIGHT = re.compile(r"(.*\S)\s{1,}([\dlIOSBZ]+|[ivxlc]+)")


def _distance(a: str, b: str) -> int:
    """Edits of one character between two words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _near(a: str, b: str) -> bool:
    """Whether two running heads are the same but for a few misread characters; their words are as many."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 2:
        return False
    x, y = a.split(), b.split()
    if len(x) != len(y):
        return False
    differ = [(p, q) for p, q in zip(x, y) if p != q]
    if len(differ) > max(1, len(x) // 2):
        return False
    return sum(_distance(p, q) for p, q in differ) <= 2 * max(1, len(a) // 10)


def _promising(numbers: list[list[tuple[str, int]]], heads: list[list[tuple[str, int | None]]]) -> list[bool]:
    """Which lines may be furniture: those that can be page numbers, and those whose head another line has too."""
    ends: dict[tuple[int, int, str], set[int]] = {}
    for i, ways in enumerate(heads):
        for text, _ in ways:
            words = text.count(" ")  # heads that are the same have as many
            ends.setdefault((0, words, text[:3]), set()).add(i)
            ends.setdefault((1, words, text[-3:]), set()).add(i)
    exact = Counter(t for ways in heads for t in {text for text, _ in ways})
    sizes = [{len(text) for text, _ in ways} for ways in heads]

    def repeated(i: int) -> bool:
        for text, _ in heads[i]:
            if exact[text] > 1:
                return True
            for j in ends[0, text.count(" "), text[:3]] | ends[1, text.count(" "), text[-3:]]:
                if j != i and any(abs(len(text) - n) <= 2 for n in sizes[j]) and any(_near(text, other) for other, _ in heads[j]):
                    return True
        return False

    return [bool(numbers[i]) or repeated(i) for i in range(len(numbers))]


def furniture(lines: list[str], pages: int) -> dict[int, str]:
    """Kinds of the lines that are page furniture: ``header`` or ``page_number``.

    Pages have equally many lines, the first up to two fewer and the last any number. Of all ways to cut the lines
    into ``pages`` pages the one is taken whose first and last lines recur most: page numbers that count on
    from page to page, and heads that repeat on every or every other page.
    """
    n = len(lines)
    while n and not lines[n - 1].strip():
        n -= 1
    if pages < 2 or n < pages:
        return {}
    numbers = [page_numbers(x) for x in lines[:n]]
    heads: list[list[tuple[str, int | None]]] = []
    for x in lines[:n]:
        text = " ".join(x.split())
        if numbers[len(heads)] or not _LETTERS.search(text):
            heads.append([])
            continue
        ways: list[tuple[str, int | None]] = [(text.casefold(), None)]
        for pattern, number, rest in ((_HEAD_LEFT, 1, 2), (_HEAD_RIGHT, 2, 1)):
            if (m := pattern.fullmatch(text)) and _LETTERS.search(m[rest]):
                ways += [(m[rest].casefold(), v) for v in {_value(m[number]), _roman(m[number])} - {None}]
        heads.append(ways)

    promising = _promising(numbers, heads)

    def series(at: list[int | None]) -> dict[int, str]:
        best: dict[int, str] = {}
        if sum(i is not None and promising[i] for i in at) < 2:
            return best
        counting: dict[tuple[str, int], list[int]] = {}
        for k, i in enumerate(at):
            if i is not None:
                for style, v in numbers[i]:
                    counting.setdefault((style, v - k), []).append(i)
        for key, own in counting.items():
            if len(own) >= 2 and len(own) > len(best) and key[1] > -2:
                best = dict.fromkeys(own, "page_number")
        for parts in ([range(len(at))], [range(0, len(at), 2), range(1, len(at), 2)]):
            found: dict[int, str] = {}
            for part in parts:
                runs: list[tuple[str, int | None, list[int]]] = []
                for k in part:
                    if (i := at[k]) is not None:
                        for text, v in heads[i]:
                            offset = None if v is None else v - k
                            for run in runs:
                                if run[1] == offset and run[2][-1] != i and _near(run[0], text):
                                    run[2].append(i)
                                    break
                            else:
                                runs.append((text, offset, [i]))
                own = max((r[2] for r in runs), key=len, default=[])
                if len(own) >= 2:
                    found |= dict.fromkeys(own, "header")
            if len(found) > len(best):
                best = found
        # Heads with numbers may stand left on one page and right on the next: the text decides, the number counts on.
        counted: dict[int, list[tuple[str, int]]] = {}
        for k, i in enumerate(at):
            if i is not None:
                for text, v in heads[i]:
                    if v is not None:
                        counted.setdefault(v - k, []).append((text, i))
        for own in counted.values():
            lead = Counter(t for t, _ in own).most_common(1)[0][0]
            same = {i for t, i in own if _near(lead, t)}
            if len(same) >= 2 and len(same) >= len(best):
                best = dict.fromkeys(same, "header")
        return best

    best: tuple[float, dict[int, str]] = (0.0, {})
    for height in range(max(2, -(-n // pages)), n):
        if pages > 2 and height * (pages - 2) > n:
            break
        for first in (height, height - 1, height - 2):
            starts = [0, *(first + k * height for k in range(pages - 1))]
            if first < 1 or not starts[-1] < n <= starts[-1] + height:
                continue
            ends = [s - 1 for s in starts[1:]] + [n - 1]
            found: dict[int, str] = {}
            for slot in (starts, ends, [s + 1 for s in starts], [e - 1 for e in ends]):
                at = [i if s <= i <= e and i not in found else None for i, s, e in zip(slot, starts, ends)]
                if slot[0] not in (starts[0], ends[0]) and not found:
                    continue  # a second line is furniture only next to a first
                for i, kind in series(at).items():
                    if i + 1 in found or i - 1 in found or i in starts or i in ends:
                        found[i] = kind
            score = len(found) - 0.01 * (height - first)
            if score > best[0]:
                best = (score, found)
    return best[1]


class Break(NamedTuple):
    """A word that goes on in the next body line."""

    line: int
    left: str
    sign: str
    next_line: int
    right: str


class Line(NamedTuple):
    """The words of a body line: without the rest of one from the line before (``rest`` says so), a broken one as joined."""

    line: int
    words: list[str]
    rest: bool
    broken: Break | None


def lines_of(text: str) -> list[str]:
    return [x[:-1] if x.endswith("\r") else x for x in text.split("\n")]


def is_scanned(file_type: str | None, page_count: int | None, text: str) -> bool:
    """A PDF with counted pages whose lines are printed ones.

    Lines follow each other in the middle of sentences more often than not, and half of the text or more stands on
    lines no wider than ``WIDEST``.
    """
    if (file_type or "").lower() != "pdf" or (page_count or 0) < 1:
        return False
    lines = lines_of(text)
    ends = [_SENTENCE_END.search(x) is None for x, y in zip(lines, lines[1:]) if x.strip() and y.strip()]
    narrow = sum(len(x) for x in lines if len(x) <= WIDEST)
    return 2 * sum(ends) > len(ends) and 2 * narrow >= sum(map(len, lines))


def words_of(lines: list[str], kinds: Collection[int]) -> list[Line]:
    """The words in order of the lines that are no furniture (``kinds``)."""
    body = [i for i, x in enumerate(lines) if i not in kinds and x.strip()]
    found, taken = [], False
    for here, after in zip(body, [*body[1:], None]):
        line = lines[here]
        words = _READ.findall(line)
        rest = taken and bool(words) and bool(_FIRST.match(line))
        words = words[1:] if rest else words
        end = _END.search(line) if after is not None and line.rstrip()[-1] in HYPHENS else None
        first = _FIRST.match(lines[after]) if end else None
        taken = bool(first and (end[2] != "-" or not first[1][0].isupper() or end[1].isupper()))
        broken = Break(here, end[1], end[2], after, first[1]) if taken else None
        if taken and words:
            words[-1] += first[1]
        found.append(Line(here, words, rest, broken))
    return found


def mixed(word: str) -> str | None:
    """What a word or number with a character of the other sort among its own stands for; None if it has none."""
    if re.search(r"[!|](?=[^\W\d_])", word):
        return word.replace("!", "i").replace("|", "l")
    digits = sum(c.isdigit() for c in word)
    letters = sum(c.isalpha() for c in word)
    if digits and letters > digits and letters >= 2 and digits <= 2 and letters + digits == len(word):
        upper = sum(c.isupper() for c in word) > 1
        table = str.maketrans("01595682", "OISGSBBZ" if upper else "olsgsbbz")
        fixed = word.translate(table)
        return fixed if fixed.isalpha() else None
    if letters and digits >= 2 and digits > letters and set(filter(str.isalpha, word)) <= set("lIOoSBZ"):
        return word.translate(_DIGITS)
    if re.search(r"[a-zà-ÿ]I(?=[a-zà-ÿ]|$)", word) and not word.isupper():
        return re.sub(r"(?<=[a-zà-ÿ])I", "l", word)
    if len(word) > 3 and word.replace("l", "").isupper() and "l" in word[1:] and sum(c.isupper() for c in word) >= 3:
        return word.replace("l", "I")
    return None


@lru_cache(1 << 16)
def confusion_cost(read: str, meant: str) -> float:
    """The least cost of reading ``read`` where ``meant`` is printed; infinite if confusions alone don't explain it."""
    n, m = len(meant), len(read)
    if abs(n - m) > 2:
        return math.inf
    cost: list[dict[int, float]] = [{} for _ in range(n + 1)]  # only what is reached, so that it doesn't grow as the square
    cost[0][0] = 0.0
    for i in range(n + 1):
        for j, c in sorted(cost[i].items()):
            if c > GREATEST_COST:
                continue
            if i < n and j < m and meant[i] == read[j] and c < cost[i + 1].get(j + 1, math.inf):
                cost[i + 1][j + 1] = c
            for a in (1, 2):
                for b in (1, 2):
                    if i + a <= n and j + b <= m:
                        x = CONFUSIONS.get((meant[i : i + a], read[j : j + b]))
                        if x is not None and c + x < cost[i + a].get(j + b, math.inf):
                            cost[i + a][j + b] = c + x
    return cost[n].get(m, math.inf)


def cased(word: str, like: str) -> list[str]:
    """Forms of a lower-case lexicon word in the case of ``like``."""
    if sum(c.isupper() for c in like) >= 2 and not any(c.islower() and c != "l" for c in like):
        return [word.upper()]
    if like[:1].isupper():
        return [word[:1].upper() + word[1:], word] if like[0] == "I" else [word[:1].upper() + word[1:]]
    return [word] if like[:1].isalpha() else [word, word[:1].upper() + word[1:]]


_TWO = [(x.lower(), y.lower()) for x, y in CONFUSIONS if len(x) != len(y)]


def undone(word: str) -> set[str]:
    """What a short word was if two characters were read for one of it, or one for two: its deletions are too few to tell."""
    found = set()
    for meant, read in _TWO if len(word) <= 6 else ():
        at = word.find(read)
        while at >= 0:
            found.add(word[:at] + meant + word[at + len(read) :])
            at = word.find(read, at + 1)
    return found


def deletes(word: str, most: int = DELETES) -> set[str]:
    """``word`` and what is left of it without up to ``most`` characters (one for short words)."""
    found = level = {word}
    for _ in range(most if len(word) > 4 else 1):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        found = found | level
    return found


def _segments(length: int) -> Iterator[tuple[int, int, int]]:
    """(number, start, end) of the parts of a word of ``length``, one more than two words with up to ``DELETES`` deletions each differ in."""
    n = 2 * DELETES + 1
    for k in range(n):
        yield k, k * length // n, (k + 1) * length // n


def entries(word: str, known: bool) -> set[str]:
    """Keys of which a word read and a ``known`` one have one in common if up to ``DELETES`` deletions in each make them equal.

    Up to ``LONG`` characters of the known word these are what deletions leave. A longer one has a part without a deletion in
    either word, which stands in the word read no more than ``DELETES`` places away.
    """
    n = len(word)
    if known:
        return deletes(word) if n <= LONG else {f"{n} {k} {word[a:b]}" for k, a, b in _segments(n)}
    found = deletes(word) if n <= LONG + DELETES else set()
    for length in range(max(LONG + 1, n - DELETES), n + DELETES + 1):
        for k, a, b in _segments(length):
            found |= {f"{length} {k} {word[a + x : b + x]}" for x in range(-DELETES, DELETES + 1) if a + x >= 0 and b + x <= n}
    return found


def _alike(a: str, b: str) -> bool:
    """Whether up to ``DELETES`` deletions in each of two words make them equal."""
    far: dict[tuple[int, int], int] = {(0, 0): 0}  # by deletions in either word, how much of ``a`` has been dealt with
    for x in range(DELETES + 1):
        for y in range(DELETES + 1):
            ways = [far.get((x, y), -1), far.get((x - 1, y), -2) + 1, far.get((x, y - 1), -1)]
            i = max(i if i <= len(a) and i - x + y <= len(b) else -1 for i in ways)
            if i < 0:
                continue
            while i < len(a) and i - x + y < len(b) and a[i] == b[i - x + y]:
                i += 1
            if i == len(a) and i - x + y == len(b):
                return True
            far[x, y] = i
    return False


class _Parts(dict):
    """The lower-case words of each run without white space, with their hashes, and its compounds and words with signs; runs repeat, so they are kept."""

    def __missing__(self, raw: str) -> tuple[list[str], list[int], list[str]]:
        if len(self) >= 100_000:
            self.clear()
        words = [w.lower() for w in _TOKEN.findall(raw)]
        more = [w.lower() for w in _COMPOUND.findall(raw) if "-" in w] if "-" in raw else []
        if _SIGNS.search(raw):
            more += [w.lower() for w in _READ.findall(raw) if _SIGNS.search(w)]
        self[raw] = found = words, [xxhash.xxh3_64_intdigest(w) for w in words], more
        return found


_parts = _Parts()


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of pairs of neighbouring words from the words' hashes."""
    h = first * np.uint64(0x9E3779B97F4A7C15) + second
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def _hash(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


def lexicon(rows: DataFrame) -> DataFrame:
    """(word, n, n_scanned): in how many texts, and scanned texts, of ``rows`` (type, pages, text) a word occurs.

    Words are lower-cased; hyphenated compounds and words with signs within count too. The empty word is in every text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[Counter[str], Counter[str]] = Counter(), Counter()
            for kind, pages, text in zip(*(c.to_pylist() for c in batch.columns)):
                found: set[str] = {""}
                for raw in set(text.split()):
                    words, _, more = _parts[raw]
                    found.update(words, more)
                counts[is_scanned(kind, pages, text)].update(found)
            words = list(counts[0].keys() | counts[1].keys())
            n = [(counts[0][w] + counts[1][w], counts[1][w]) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([x[k] for x in n], pa.int64()) for k in (0, 1))], names=["word", "n", "n_scanned"])

    found = rows.select("type", "pages", "text").mapInArrow(run, "word string, n bigint, n_scanned bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_scanned").alias("n_scanned"))


_PAGES = "id string, text string, kinds array<struct<line:int,kind:string>>, breaks array<struct<line:int,left:string,sign:string,next_line:int,right:string>>"


def _pages(rows: DataFrame) -> DataFrame:
    """The scanned texts among ``rows`` (id, type, pages, text) with their furniture and broken words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_type = pa.list_(pa.struct([("line", pa.int32()), ("kind", pa.string())]))
        break_type = pa.list_(pa.struct([("line", pa.int32()), ("left", pa.string()), ("sign", pa.string()), ("next_line", pa.int32()), ("right", pa.string())]))
        for batch in batches:
            made: list[tuple] = []
            for key, kind, pages, text in zip(*(c.to_pylist() for c in batch.columns)):
                if is_scanned(kind, pages, text):
                    lines = lines_of(text)
                    kinds = furniture(lines, pages)
                    made.append((key, text, [{"line": i, "kind": k} for i, k in kinds.items()], [x.broken._asdict() for x in words_of(lines, kinds) if x.broken]))
            columns = list(zip(*made)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), kind_type, break_type))], names=["id", "text", "kinds", "breaks"])

    return rows.select("id", "type", "pages", "text").mapInArrow(run, _PAGES)


_WORDS = "id string, line_no int, start int, word string, read string, before string, after string, left string, next_line int, mixed string"


def _suspects(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """The words of scanned texts that have a correction (``wanted``: word) or hold characters of the other sort."""
    hashes = _hashes(wanted)
    bits = pages.sparkSession.sparkContext.broadcast(Bits.of(hashes, Bits.size(hashes.count(), FILTER_BITS)))  # of bounded size
    kinds_ = [pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 5, pa.int32(), pa.string()]
    names = [f.split()[0] for f in _WORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str | None] = {}  # words looked up; suspects with what they stand for, others None
        for batch in batches:
            found: list[tuple] = []
            for key, text, kinds in zip(*(c.to_pylist() for c in batch.columns)):
                lines = lines_of(text)
                body = words_of(lines, {k["line"] for k in kinds})
                sequence = [w for x in body for w in x.words]
                if len(known) > 200_000:
                    known.clear()
                if fresh := list(set(sequence) - known.keys()):
                    for w, h in zip(fresh, Bits.has(bits.value, _hash([w.lower() for w in fresh])).tolist()):
                        other = mixed(w)
                        known[w] = (other or "") if len(w) > 1 and not w.isdigit() and (h or other) else None
                at = 0
                for x in body:
                    for k, w in enumerate(x.words):
                        if (other := known[w]) is not None:
                            i = at + k
                            start = next(islice(_READ.finditer(lines[x.line]), k + x.rest, None)).start()
                            broken = x.broken if k == len(x.words) - 1 else None
                            before, after = sequence[i - 1].lower() if i else "", sequence[i + 1].lower() if i + 1 < len(sequence) else ""
                            found.append((key, x.line, start, w, w.lower(), before, after, broken and broken.left, broken and broken.next_line, other.lower() or None))
                    at += len(x.words)
            columns = list(zip(*found)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds_)], names=names)

    return pages.select("id", "text", "kinds").mapInArrow(run, _WORDS)


def _hashes(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_hash(batch.column(0).to_pylist()).view(np.int64))], names=["hash"])

    return words.mapInArrow(run, "hash bigint")


def _sorted(df: DataFrame) -> DataFrame:
    """``df`` for a join that sorts.

    Spark judges by bytes in files whether to send a table through the driver to all executors. Words that explode to
    dozens of rows, or rows that are much alike, have few, so that small files would fill the driver's memory.
    """
    return df.hint("merge")


def _exploded(words: DataFrame, also: Callable[[str], set[str]] | None = None) -> DataFrame:
    """(entry, word, n): every word under the hashes of its ``entries`` (words read: and of what ``also`` makes of them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 1000) for k in range(0, batch.num_rows, 1000)):
                entry, owner = [], []
                for i, w in enumerate(part.column(0).to_pylist()):
                    own = {xxhash.xxh3_64_intdigest(d) - (1 << 63) for d in entries(w, also is None) | (also(w) if also else set())}
                    entry += own
                    owner += [i] * len(own)
                at = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(entry, pa.int64()), part.column(0).take(at), part.column(1).take(at)], names=["entry", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "entry bigint, word string, n bigint")


def _corrections(reads: DataFrame, words: DataFrame) -> DataFrame:
    """(read, meant, n_read, n_meant) of ``reads`` (word, n) and lexicon words that confusions may turn into them."""
    # A word whose spelling is frequent in the corpus cannot be outweighed; the ratio decides, not a cap.
    known = words.where((F.col("n") >= RATIO / 2) & ~F.col("word").rlike(r"[-!|]") & (F.length("word") >= 2))
    a = _exploded(reads, undone).toDF("entry", "read", "n_read")
    b = _exploded(known).toDF("entry", "meant", "n_meant")
    near = F.abs(F.length("read") - F.length("meant")) <= 2
    pairs = a.join(_sorted(b), "entry").where((F.col("read") != F.col("meant")) & near & (F.col("n_meant") >= RATIO * F.greatest("n_read", F.lit(1)) / 2)).select("read", "meant", "n_read", "n_meant")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loose = {(x.lower(), y.lower()) for x, y in CONFUSIONS}
        seen: dict[tuple[str, str], bool] = {}
        for batch in batches:
            ok = []
            for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if pair not in seen:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen[pair] = (len(pair[1]) <= LONG or _alike(*pair)) and _explained(*pair, loose)
                ok.append(seen[pair])
            yield batch.filter(pa.array(ok, pa.bool_()))

    return pairs.mapInArrow(keep, "read string, meant string, n_read bigint, n_meant bigint").distinct()


def _explained(read: str, meant: str, loose: set[tuple[str, str]]) -> bool:
    """Whether confusions without regard to case turn ``meant`` into ``read``."""
    i = 0
    while i < min(len(read), len(meant)) and read[i] == meant[i]:
        i += 1
    j = 0
    while j < min(len(read), len(meant)) - i and read[-1 - j] == meant[-1 - j]:
        j += 1
    reach = {(max(0, i - 1), max(0, i - 1))}
    todo = list(reach)
    while todo:
        x, y = todo.pop()
        if x == len(meant) and y == len(read):
            return True
        steps = [(1, 1)] if x < len(meant) and y < len(read) and meant[x] == read[y] else []
        steps += [(a, b) for a in (1, 2) for b in (1, 2) if x + a <= len(meant) and y + b <= len(read) and (meant[x : x + a], read[y : y + b]) in loose]
        for a, b in steps:
            if (x + a, y + b) not in reach:
                reach.add((x + a, y + b))
                todo.append((x + a, y + b))
    return False


def _pair_counts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pair, n) of the neighbouring words whose hashes are ``wanted``, over all texts."""
    bits = texts.sparkSession.sparkContext.broadcast(Bits.of(wanted.select("pair"), Bits.size(wanted.count(), FILTER_BITS)))  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [np.array([x for raw in text.split() for x in _parts[raw][1]], np.uint64) for text in batch.column(0).to_pylist()]
            h = np.concatenate([np.empty(0, np.int64), *(_pairs(w[:-1], w[1:]) for w in texts if len(w) > 1)])
            values, n = np.unique(h[Bits.has(bits.value, h)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

    return texts.select("text").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def _hyphens(breaks: DataFrame, words: DataFrame) -> DataFrame:
    """The breaks that are put in: ``breaks`` (id, line, left, sign, next_line, right) but those at a compound's own hyphen.

    Special signs are always put in, and a text that uses them breaks words with no other. A plain hyphen is a
    compound's own if the corpus has the compound in more texts than the joined word or, having neither, has both
    halves as words far more often than breaks leave them.
    """
    parts = {"word": F.concat("left", "right"), "compound": F.concat_ws("-", "left", "right"), "l": F.col("left"), "r": F.col("right")}
    slots = breaks.select("id", "line", F.explode(F.array(*(F.struct(F.lit(k).alias("slot"), F.lower(v).alias("word")) for k, v in parts.items()))).alias("s")).select("id", "line", "s.*")
    looked = slots.groupBy("slot", "word").agg(F.count("*").alias("b")).join(_sorted(words.select("word", "n")), "word", "left").select("slot", "word", "b", F.coalesce("n", F.lit(0)).alias("n"))
    found = slots.join(_sorted(looked), ["slot", "word"]).groupBy("id", "line").agg(*(F.max(F.when(F.col("slot") == k, F.col(c))).alias(f"{c}_{k}") for k in parts for c in ("n", "b")))
    halves = (F.col("n_l") >= RATIO * F.col("b_l")) & (F.col("n_r") >= RATIO * F.col("b_r"))
    own = F.when(F.col("n_word") + F.col("n_compound") > 0, F.col("n_compound") > F.col("n_word")).otherwise(halves)
    special = breaks.groupBy("id").agg(F.max(F.col("sign").isin(*BREAK_SIGNS)).alias("special"))
    joined = breaks.join(_sorted(special), "id").join(_sorted(found.select("id", "line", own.alias("own"))), ["id", "line"])
    return joined.where(F.col("sign").isin(*BREAK_SIGNS) | (~F.col("special") & ~F.col("own"))).drop("special", "own")


def _found(df: DataFrame, id_col: str, text_col: str, type_col: str, pages_col: str) -> tuple[DataFrame, DataFrame]:
    """``findings``, and the scanned texts with their furniture."""
    rows = df.select(df[id_col].cast("string").alias("id"), df[type_col].alias("type"), df[pages_col].cast("int").alias("pages"), df[text_col].alias("text")).where("text IS NOT NULL")
    rows = spread(rows)
    pages = stage(_pages(rows.where("id IS NOT NULL AND pages >= 1 AND lower(type) = 'pdf'")), "pages")
    words = stage(lexicon(rows), "lexicon")
    sums = words.where("word = ''").first()  # one row, none for an empty table
    n_all, n_scanned = (sums["n"], sums["n_scanned"]) if sums else (0, 0)

    breaks = pages.select("id", F.explode("breaks").alias("b")).select("id", "b.*").distinct()
    hyphens = stage(_hyphens(breaks, words), "hyphens")

    # Corrections of the different words: those of scanned texts, and what joining the broken ones gives.
    joined = hyphens.select(F.lower(F.concat("left", "right")).alias("word")).distinct().join(_sorted(words.select("word")), "word", "left_anti").select("word", F.lit(0).cast("bigint").alias("n"))
    reads = words.where("n_scanned > 0 AND length(word) > 1 AND word NOT LIKE '%-%'").select("word", "n").unionByName(joined)
    corrections = stage(_corrections(reads, words), "corrections")
    read = stage(_suspects(pages, corrections.select("read").distinct()).distinct(), "suspects")
    # What a line break joined wrongly (a compound) is no word: joined words count only where the break was accepted.
    accepted = hyphens.select("id", F.col("line").alias("line_no")).distinct()
    read = read.where("left IS NULL").unionByName(read.where("left IS NOT NULL").join(_sorted(accepted), ["id", "line_no"], "left_semi"))

    # A word or number with a character of the other sort is misread if it stands in scans rather than elsewhere.
    odd = read.where("mixed IS NOT NULL").select("read", "mixed").distinct()
    odd = odd.join(_sorted(words.toDF("read", "n_read", "s_read")), "read", "left").join(_sorted(words.select(F.col("word").alias("mixed"), F.col("n").alias("n_meant"))), "mixed", "left").na.fill(0, ["n_read", "s_read", "n_meant"])
    there = F.greatest("s_read", F.lit(1)) * (n_all - n_scanned + 1)
    elsewhere = (F.col("n_read") - F.col("s_read") + 1) * (n_scanned + 1)
    odd = odd.select("read", F.col("mixed").alias("meant"), "n_read", "n_meant", F.log(there / elsewhere).alias("shape")).where("read <> meant")
    ways = corrections.withColumn("shape", F.lit(None).cast("double")).unionByName(odd)

    options = read.join(_sorted(ways), "read").withColumn("scored", _scored_udf("word", "before", "read", "meant", "after"))
    cost = F.when(F.col("shape").isNull(), F.col("scored.cost")).otherwise(0.0)
    options = stage(options.withColumn("cost", cost).where(F.col("cost") <= GREATEST_COST).withColumn("p", F.col("scored.pairs")).drop("scored", "mixed"), "options")
    # Counts of the four pairs of neighbours, in one join.
    asked = options.select("id", "line_no", "start", "meant", "shape", F.posexplode("p").alias("k", "pair"))
    wanted = stage(asked.select("pair").distinct(), "wanted")
    counts = _pair_counts(rows, wanted)
    near = asked.join(_sorted(counts), "pair").groupBy("id", "line_no", "start", "meant").agg(*(F.max(F.when(F.col("k") == k, F.col("n"))).alias(f"c{k}") for k in range(4)))
    scored = options.drop("p").join(_sorted(near), ["id", "line_no", "start", "meant"], "left")
    z = lambda k: F.coalesce(f"c{k}", F.lit(0))
    # The word's own occurrence is one of the counts of its context. What cannot be a word has no context of its own.
    as_read = F.when(F.col("shape").isNull(), F.greatest(z(0) - 1, F.lit(0)) + F.greatest(z(1) - 1, F.lit(0))).otherwise(0)
    score = F.log((F.col("n_meant") + 1) / F.greatest("n_read", F.lit(1))) + F.log((1 + z(2) + z(3)) / (1 + as_read)) - F.col("cost") * math.log(2)
    scored = scored.withColumn("score", score + F.coalesce("shape", F.lit(0.0))).where(F.col("score") >= math.log(RATIO))
    best = scored.groupBy("id", "line_no", "start").agg(F.min(F.struct((-F.col("score")).alias("worst"), "meant", "word", "left", "next_line")).alias("best"))
    marked = best.select("id", "line_no", "start", "best.*")
    in_left = F.col("left").isNull() | ~F.startswith(F.col("meant"), F.lower("left"))
    misread = marked.select(
        "id", F.when(in_left, F.col("line_no")).otherwise(F.col("next_line")).alias("line_no"), F.lit("misread").alias("kind"), "start", "word", F.col("meant").alias("repair"), "next_line",
        F.lit(None).cast("string").alias("right"), F.col("line_no").alias("word_line"),
    )

    empty = [F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("word", "string"), ("repair", "string"), ("next_line", "int"), ("right", "string"), ("word_line", "int"))]
    kinds = pages.select("id", F.explode("kinds").alias("k")).select("id", F.col("k.line").alias("line_no"), "k.kind", *empty).distinct()
    broken = hyphens.select("id", F.col("line").alias("line_no"), F.lit("hyphen").alias("kind"), empty[0], F.lower(F.concat("left", "right")).alias("word"), empty[2], "next_line", "right", empty[5])
    return kinds.unionByName(broken).unionByName(misread), pages


def findings(df: DataFrame, id_col: str, text_col: str, type_col: str, pages_col: str) -> DataFrame:
    """What is wrong in scanned texts: (id, line_no, kind, start, word, repair, next_line, right, word_line).

    ``kind`` is ``header``, ``page_number``, ``hyphen`` (``word`` the joined word, ``right`` its part in ``next_line``) or
    ``misread`` (``word`` as read from ``start`` in ``word_line`` on, ``repair`` as meant; ``line_no`` is the line of the part
    of a broken word that differs). Single characters and numbers of digits alone are never misread.
    The lexicon and the counts of word pairs come from the texts of all rows, scanned or not. Rows that aren't scanned
    (``is_scanned``), and rows with a null id, text or page count, have no findings. A row
    delivered again counts once in the result.
    """
    return _found(df, id_col, text_col, type_col, pages_col)[0].withColumnRenamed("id", id_col)


def _recased(word: str, repair: str) -> str:
    """``repair`` in the case of ``word``."""
    letters = [c for c in word if c.isalpha()]
    if len(letters) > 1 and sum(map(str.isupper, letters)) > len(letters) / 2:
        return repair.upper()
    return repair[:1].upper() + repair[1:] if word[:1].isupper() and not word[:2] == "I" + word[1:2].lower() or repair[:1].isupper() else repair


def paragraphs(text: str, found: list[dict]) -> list[str]:
    """The paragraphs of a text with ``found`` (rows of ``findings``) repaired.

    Furniture is left out, broken words are joined, misread ones replaced; lines are joined by spaces. A
    paragraph begins after a blank line, with an indent, and after a line that ends early before one with a capital.
    """
    lines = lines_of(text)
    drop = {f["line_no"] for f in found if f["kind"] in ("header", "page_number")}
    joined = {f["line_no"]: f for f in found if f["kind"] == "hyphen"}
    tails = {f["next_line"]: f["right"] for f in joined.values()}
    read: dict[int, list[dict]] = {}
    for f in found:
        if f["kind"] == "misread":
            read.setdefault(f["word_line"], []).append(f)
    width = max((len(x) for i, x in enumerate(lines) if i not in drop), default=0)
    out: list[str] = []
    fresh, last = True, ""
    for i, line in enumerate(lines):
        if i in drop:
            continue
        raw = line
        if not line.strip():
            fresh = True
            continue
        if i in joined:
            m = _END.search(line)
            line = line[: m.start(2)] + joined[i]["right"] if m else line
        for f in sorted(read.get(i, ()), key=lambda f: -f["start"]):
            at = f["start"]
            if line[at : at + len(f["word"])] == f["word"]:
                line = line[:at] + _recased(f["word"], f["repair"]) + line[at + len(f["word"]) :]
        if i in tails:
            line = line.lstrip()
            line = line[len(tails[i]) :] if line.startswith(tails[i]) else line
        early = len(last) < 0.75 * width and raw.strip()[:1].isupper() and i not in tails
        if fresh or (raw[:1].isspace() and i not in tails) or early:
            out.append(line.strip())
        else:
            own = _END.search(last)  # a compound's own hyphen, as the break was no other
            compound = own and own[2] == "-" and i not in tails and _FIRST.match(line)
            glue = "" if i in tails and line[:1] in ".,;:!?)" or compound or not line else " "
            out[-1] = f"{out[-1]}{glue}{line.strip()}"
        fresh, last = False, raw
    return [p for p in out if p]


def repair(df: DataFrame, id_col: str, text_col: str, type_col: str, pages_col: str) -> DataFrame:
    """(id, paragraph_no, paragraph): the continuous paragraphs of the scanned texts; other rows have none."""
    found, pages = _found(df, id_col, text_col, type_col, pages_col)
    # A text's findings are fewer than its words: a list of bounded size.
    lists = found.groupBy("id").agg(F.collect_list(F.struct("line_no", "kind", "start", "word", "repair", "next_line", "right", "word_line")).alias("found"))
    rows = pages.select("id", "text").distinct().join(_sorted(lists), "id", "left").select("id", "text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers, made = [], [], []
            for key, text, own in zip(*(c.to_pylist() for c in batch.columns)):
                for k, p in enumerate(paragraphs(text, own or [])):
                    keys.append(key), numbers.append(k), made.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(numbers, pa.int32()), pa.array(made, pa.string())], names=["id", "paragraph_no", "paragraph"])

    return rows.mapInArrow(run, "id string, paragraph_no int, paragraph string").withColumnRenamed("id", id_col)


@F.pandas_udf(T.StructType([T.StructField("cost", T.DoubleType()), T.StructField("pairs", T.ArrayType(T.LongType()))]))
def _scored_udf(word, before, read, meant, after):  # type: ignore[no-untyped-def]
    import pandas as pd

    b, r, m, a = (_hash(list(words)) for words in (before, read, meant, after))
    cost = [min(min(confusion_cost(w, c) for c in cased(x, w)), 1e9) for w, x in zip(word, meant)]
    return pd.DataFrame({"cost": cost, "pairs": np.column_stack([_pairs(b, r), _pairs(r, a), _pairs(b, m), _pairs(m, a)]).tolist()})
