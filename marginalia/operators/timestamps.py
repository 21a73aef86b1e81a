"""Points in time written in many formats, precisions, languages and zones, brought to UTC.

Every value gets all its valid interpretations as an array; for each source the sequence of interpretations
with the least cost over the record order is chosen (Viterbi): an interpretation against the conventions of
the row's locale and zone costs most, a change of format and a jump back in time cost a little.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.dialect import WS_CHARS

# Names of months in English, French, Spanish and German, and their usual short forms.
MONTHS = {
    1: "january jan janvier janv enero ene januar jänner",
    2: "february feb février févr fevrier febrero februar",
    3: "march mar mars marzo märz mär maerz",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juin junio juni",
    7: "july jul juillet juil julio juli",
    8: "august aug août aout agosto ago",
    9: "september sep sept septembre septiembre setiembre",
    10: "october oct octobre octubre oktober okt",
    11: "november nov novembre noviembre",
    12: "december dec décembre déc decembre diciembre dic dezember dez",
}
# Minutes east of UTC of zone abbreviations; where one has several, the first is the usual one.
ABBREVIATIONS = {
    "UTC": (0,), "UT": (0,), "GMT": (0,), "Z": (0,), "WET": (0,), "WEST": (60,), "BST": (60, 360), "CET": (60,), "CEST": (120,), "MEZ": (60,), "MESZ": (120,),
    "EET": (120,), "EEST": (180,), "MSK": (180,), "IST": (330, 120, 60), "NPT": (345,), "JST": (540,), "KST": (540,), "AWST": (480,), "ACST": (570,), "ACDT": (630,),
    "AEST": (600,), "AEDT": (660,), "NZST": (720,), "NZDT": (780,), "EST": (-300, 600), "EDT": (-240,), "CST": (-360, 480), "CDT": (-300,), "MST": (-420,), "MDT": (-360,),
    "PST": (-480,), "PDT": (-420,), "AKST": (-540,), "AKDT": (-480,), "HST": (-600,),
}

_MONTH = {name: n for n, names in MONTHS.items() for name in names.split()}
_M = "(?P<mon>" + "|".join(sorted(map(re.escape, _MONTH), key=len, reverse=True)) + r")\.?"
_DAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?(?:\s?(?P<ap>[ap]\.?m\.?))?(?:\s+uhr)?"
_ZONE = r"(?:\s?(?P<off>[+-]\d{2}:?(?:\d{2})?)|\s?(?P<z>z)|\s(?P<abb>[a-z]{2,5})|\s(?P<iana>[a-z_]+(?:/[a-z_+\-0-9]+)+))?"
_TAIL = rf"(?:(?:t|\s+|,\s*|\s+at\s+|\s+à\s+|\s+um\s+|\s+a\s+las\s+)(?:{_TIME}|(?P<hh>\d{{1,2}})\s?h\s?(?P<hm>\d{{2}})?){_ZONE})?"


def _form(name: str, date: str, tail: str = _TAIL) -> tuple[str, re.Pattern[str]]:
    return name, re.compile(date + tail, re.IGNORECASE)


#: Formats, each with what it reads; the groups y, m, d (or a, b for a pair in unknown order) make the date.
FORMS = [
    _form("iso", r"(?P<y>\d{4})-(?P<m>\d{2})-(?P<d>\d{2})"),
    _form("iso_slash", r"(?P<y>\d{4})/(?P<m>\d{1,2})/(?P<d>\d{1,2})"),
    _form("basic", r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})", r"(?:t(?P<h>\d{2})(?P<mi>\d{2})(?:(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?" + _ZONE + ")?"),
    _form("ordinal", r"(?P<y>\d{4})-(?P<doy>\d{3})"),
    _form("week", r"(?P<y>\d{4})-w(?P<w>\d{2})-(?P<wd>\d)"),
    _form("slash", r"(?P<a>\d{1,2})/(?P<b>\d{1,2})/(?P<y>\d{4})"),
    _form("dot", r"(?P<d>\d{1,2})\.(?P<m>\d{1,2})\.(?P<y>\d{4})"),
    _form("day_month", _DAY + rf"(?P<d>\d{{1,2}})(?:st|nd|rd|th|er|\.|º)?\s+(?:de\s+)?{_M}(?:\s+de)?,?\s+(?P<y>\d{{4}})"),
    _form("month_day", _DAY + rf"{_M}\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}})"),
    _form("ctime", _DAY + rf"{_M}\s+(?P<d>\d{{1,2}})\s+{_TIME}{_ZONE}\s+(?P<y>\d{{4}})", ""),
    _form("short", rf"(?P<a>\d{{1,2}})-{_M}-(?P<yy>\d{{2}})"),
    _form("short_year", rf"(?P<d>\d{{1,2}})-{_M}-(?P<y>\d{{4}})"),
    _form("month_year", rf"{_M}(?:\s+de)?,?\s+(?P<y>\d{{4}})", ""),
    _form("year_month", r"(?P<y>\d{4})-(?P<m>\d{2})", ""),
    _form("slash_year", r"(?P<m>\d{1,2})/(?P<y>\d{4})", ""),
    _form("year", r"(?P<y>\d{4})", ""),
    _form("epoch", r"(?P<epoch>\d{10}|\d{13}|\d{16})", ""),
]
_EPOCH = dt.datetime(1970, 1, 1)
_UNITS = {10: 1_000_000, 13: 1000, 16: 1}


class Reading(NamedTuple):
    """One interpretation; ``conform`` says that it follows the conventions of locale and zone."""

    utc_us: int
    form: str
    conform: bool


@lru_cache(64)
def zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:  # no such zone, or no name of one
        return None


def _us(t: dt.datetime) -> int:
    d = t - _EPOCH
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


def _local(t: dt.datetime, z: ZoneInfo) -> list[tuple[int, bool]]:
    """Instants of a local time: the first occurrence or, of a skipped time, the offset before the change."""
    found = [_us(t - t.replace(tzinfo=z, fold=k).utcoffset()) for k in (0, 1)]
    return [(found[0], True)] + ([(found[1], False)] if found[1] != found[0] else [])


def _dates(g: dict[str, str | None], form: str, locale: str | None) -> Iterator[tuple[int, int, int, str, bool]]:
    """Year, month, day, form and conformity of each way to read the date."""
    month = _MONTH[g["mon"].lower()] if g.get("mon") else int(g.get("m") or 1)
    if form == "slash":
        american, (a, b, y) = locale == "en-US", (int(g["a"]), int(g["b"]), int(g["y"]))
        yield y, b, a, "day/month", not american
        yield y, a, b, "month/day", american
    elif form == "short":
        a, yy = int(g["a"]), int(g["yy"])
        century = lambda x: 2000 + x if x < 69 else 1900 + x
        yield century(yy), month, a, "day-month-yy", True
        yield century(a), month, yy, "yy-month-day", False
    elif form == "ordinal":
        d = dt.date(int(g["y"]), 1, 1) + dt.timedelta(int(g["doy"]) - 1)
        if int(g["doy"]) and d.year == int(g["y"]):
            yield d.year, d.month, d.day, form, True
    elif form == "week":
        d = dt.date.fromisocalendar(int(g["y"]), int(g["w"]), int(g["wd"]))
        yield d.year, d.month, d.day, form, True
    else:
        yield int(g["y"]), month, int(g.get("d") or 1), form, True


def _clock(g: dict[str, str | None]) -> tuple[int, int, int, int] | None:
    """Hour, minute, second and microsecond; None for an hour that 12-hour time does not have."""
    h = int(g.get("h") or g.get("hh") or 0)
    if g.get("ap"):
        if not 1 <= h <= 12:
            return None
        h = h % 12 + 12 * (g["ap"][0].lower() == "p")
    return h, int(g.get("mi") or g.get("hm") or 0), int(g.get("s") or 0), int(((g.get("f") or "") + "000000")[:6])


@lru_cache(1 << 16)
def interpretations(value: str | None, zone_name: str | None, locale: str | None) -> tuple[Reading, ...]:
    """All valid interpretations of ``value``; none for null, blank, vague or impossible values."""
    text = (value or "").strip(WS_CHARS)
    found: dict[tuple[int, str], bool] = {}

    def add(us: int, form: str, conform: bool) -> None:
        found[us, form] = found.get((us, form), False) or conform

    own = zone(zone_name) if zone_name else None
    for form, pattern in FORMS:
        m = pattern.fullmatch(text)
        if not m:
            continue
        g = m.groupdict()
        if form == "epoch":
            add(int(g["epoch"]) * _UNITS[len(g["epoch"])], form, True)
            continue
        try:
            clock = _clock(g)
            for y, mo, d, name, conform in _dates(g, form, locale) if clock else ():
                try:
                    t = dt.datetime(y, mo, d, *clock)
                except ValueError:
                    continue
                if g.get("off"):
                    digits = g["off"][1:].replace(":", "").ljust(4, "0")
                    if int(digits[2:]) < 60 and int(digits[:2]) < 24:
                        shift = int(digits[:2]) * 60 + int(digits[2:])
                        add(_us(t) - (-1 if g["off"][0] == "-" else 1) * shift * 60_000_000, name, conform)
                elif g.get("z"):
                    add(_us(t), name, conform)
                elif g.get("abb"):
                    shifts = ABBREVIATIONS.get(g["abb"].upper(), ())
                    named = {t.replace(tzinfo=own, fold=k).utcoffset().total_seconds() // 60 for k in (0, 1) if t.replace(tzinfo=own, fold=k).tzname() == g["abb"].upper()} if own else set()
                    usual = next((s for s in shifts if s in named), shifts[0] if shifts else None)
                    for s in shifts:
                        add(_us(t) - s * 60_000_000, name, conform and s == usual)
                elif g.get("iana"):
                    if z := zone(g["iana"]):
                        for us, first in _local(t, z):
                            add(us, name, conform and first)
                elif own:
                    for us, first in _local(t, own):
                        add(us, name, conform and first)
                else:
                    add(_us(t), name, False)  # as if UTC: no convention says so
        except (ValueError, OverflowError):
            continue
    return tuple(Reading(us, form, conform) for (us, form), conform in found.items())


def choose(readings: Sequence[Sequence[Reading]], against: float = 100.0, switch: float = 1.0, backward: float = 1.0) -> list[Reading | None]:
    """The cheapest path through the interpretations of consecutive records; None where there are none.

    ``against`` is the cost of an interpretation against the conventions, ``switch`` of a change of format,
    ``backward`` of a time before that of the record before it. Of equal paths the first listed wins.
    """
    chosen: list[Reading | None] = [None] * len(readings)
    steps: list[tuple[int, Sequence[Reading], list[int]]] = []
    costs: list[float] = []
    for at, options in enumerate(readings):
        if not options:
            continue
        own = [0.0 if r.conform else against for r in options]
        if not steps:
            costs, back = own, [0] * len(options)
        else:
            before = steps[-1][1]
            back, new = [], []
            for r, c in zip(options, own):
                ways = [b + switch * (p.form != r.form) + backward * (p.utc_us > r.utc_us) for p, b in zip(before, costs)]
                k = min(range(len(ways)), key=ways.__getitem__)
                back.append(k)
                new.append(ways[k] + c)
            costs = new
        steps.append((at, options, back))
    k = min(range(len(costs)), key=costs.__getitem__) if costs else 0
    for at, options, back in reversed(steps):
        chosen[at] = options[k]
        k = back[k]
    return chosen


_OUT = "kind string, record_key string, pos int, utc_us bigint, form string, conform boolean"
_NAMES = ["kind", "record_key", "pos", "utc_us", "form", "conform"]
_TYPES = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]


def _rows(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _TYPES)], names=_NAMES)


def normalise_lists(df: DataFrame, kind: str, key_col: str, values_col: str, zone_col: str = "zone_name", locale_col: str = "locale") -> DataFrame:
    """Each entry of an array column as an instant: (kind, record_key, pos, utc_us, form, conform).

    The list is the source and its order the record order, so nothing is shuffled. ``utc_us`` and what
    follows are null for an entry that is null, vague or impossible; a null or empty list and a row with a null
    key have no rows. Repeated rows are repeated in the result.
    """
    rows = df.select(df[key_col].cast("string").alias("k"), df[values_col].alias("v"), df[zone_col].alias("z"), df[locale_col].alias("l")).where("k IS NOT NULL AND size(v) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key, values, z, loc in zip(*(c.to_pylist() for c in batch.columns)):
                for pos, r in enumerate(choose([interpretations(v, z, loc) for v in values])):
                    found.append((kind, key, pos, *(r or (None, None, None))))
            yield _rows(found)

    return rows.mapInArrow(run, _OUT)


def normalise_events(
    df: DataFrame, kind: str, key_col: str, value_col: str, source_col: str, order_col: str, zone_col: str = "zone_name", locale_col: str = "locale", block: int = 1024, halo: int = 64
) -> DataFrame:
    """One value a row as an instant, in the order of ``order_col`` within ``source_col``; columns as ``normalise_lists``, pos 0.

    A source is decided in blocks of ``block`` places, each seen with ``halo`` places of its neighbours, so the
    largest source is spread over many tasks; a record with one interpretation parts the path, so
    a block's decisions are those of the whole source unless ``halo`` ambiguous records follow one another.
    A row with a null source or place is decided by itself, one with a null key is left out; rows delivered
    again (equal in all columns read) count once; ties of place are ordered by key.
    """
    place = F.when(df[source_col].isNotNull(), df[order_col].cast("long"))
    rows = df.select(df[key_col].cast("string").alias("k"), df[value_col].alias("v"), df[zone_col].alias("z"), df[locale_col].alias("l"), df[source_col].cast("string").alias("source"), place.alias("place"))
    rows = rows.where("k IS NOT NULL").distinct()
    own = F.floor(F.col("place") / block)
    near = F.array_distinct(F.array(own, F.floor((F.col("place") - halo) / block), F.floor((F.col("place") + halo) / block)))
    alone = F.concat(F.lit("="), F.coalesce("source", F.lit("")), F.lit("="), F.col("k"))
    seen = rows.withColumn("own", own).withColumn("block", F.explode(F.when(F.col("place").isNull(), F.array(F.lit(0).cast("long"))).otherwise(near)))
    item = F.struct(F.coalesce("place", F.lit(0)).alias("place"), "k", "v", "z", "l", F.coalesce(F.col("own") == F.col("block"), F.lit(True)).alias("mine"))
    lists = seen.groupBy(F.when(F.col("place").isNull(), alone).otherwise(F.concat(F.lit("+"), "source")).alias("source"), "block").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for items in batch.column(0).to_pylist():
                for x, r in zip(items, choose([interpretations(x["v"], x["z"], x["l"]) for x in items])):
                    if x["mine"]:
                        found.append((kind, x["k"], 0, *(r or (None, None, None))))
            yield _rows(found)

    return lists.select("items").mapInArrow(run, _OUT)
