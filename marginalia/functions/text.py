"""Text functions as column expressions; offsets and lengths count code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.dialect import N, WS_CHARS, W, strip

#: Between the parts of a fingerprint and of a chunk's name.
SEPARATOR = "\x1f"
#: Two private characters, in no class that a pattern here has.
MARK, NO_MARK = "\ue000", "\ue001"
# Fixed value: the namespace of chunk ids.
CHUNK_NAMESPACE = "9d88b7ba-292c-52a3-92d8-2140592f8be9"


def words(text: Column) -> Column:
    """The maximal runs without white space, in order."""
    # One character for all white space lets the split go without a pattern.
    return F.array_remove(F.split(F.translate(text, WS_CHARS, " " * len(WS_CHARS)), " ", -1), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def character_count(text: Column) -> Column:
    return F.length(text).cast("long")


def has_content(text: Column) -> Column:
    """Whether there is anything but white space; false for null."""
    return F.coalesce(text.rlike(N), F.lit(False))


def sentences(text: Column) -> Column:
    """Stripped pieces that end in a full stop before white space or the end; a rest without one is no sentence."""
    pieces = F.split(text, rf"(?<=\.)(?=[{W}]|\z)", -1)
    return F.transform(F.filter(pieces, lambda p: F.endswith(p, F.lit("."))), strip)


def title_case(text: Column) -> Column:
    """Whether every run of cased letters starts with a capital and goes on in small letters, with at least one letter."""
    cased = r"[\p{Lu}\p{Ll}\p{Lt}]"
    return ~text.rlike(rf"(?<!{cased})\p{{Ll}}|(?<={cased})[\p{{Lu}}\p{{Lt}}]") & text.rlike(r"\p{L}")


def fingerprint(filename: Column, file_type: Column, text: Column) -> Column:
    """SHA-256 of name, type and text of a document; metadata doesn't matter."""
    return F.sha2(F.concat(filename, F.lit(SEPARATOR), file_type, F.lit(SEPARATOR), text), 256)


def uuid5(name: Column, namespace: str) -> Column:
    """The name-based (SHA-1) UUID of ``name``."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def chunk_id(print_: Column, start: Column, end: Column) -> Column:
    """The deterministic id of a document's chunk."""
    return uuid5(F.concat_ws(SEPARATOR, print_, start.cast("string"), end.cast("string")), CHUNK_NAMESPACE)


def spans(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` as array<struct<start, end, value>> in order; null for null.

    Offsets are sums of lengths, as positions that Java gives count UTF-16 units. What lies between the matches is
    parted at a mark set in place of each (``split`` by the pattern itself would compile it for every row); the mark's
    own occurrences become another private character first, of the same length.
    """
    marked = F.regexp_replace(F.translate(text, MARK, NO_MARK), pattern, MARK)
    gaps = F.transform(F.split(marked, MARK, -1), lambda g: F.length(g))
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    # Length of text before match i: gaps 0 to i and matches before i.
    pairs = F.zip_with(gaps, found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    pairs = F.filter(pairs, lambda p: p["value"].isNotNull())
    none = "cast(array() AS array<struct<start:int,end:int,value:string>>)"
    empty = F.expr(f"named_struct('at', 0, 'found', {none})")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + F.length(p["value"])
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(F.struct(start.alias("start"), end.alias("end"), p["value"].alias("value")))).alias("found"))

    def block(acc: Column, own: Column) -> Column:
        first = F.struct(acc["at"].alias("at"), F.expr(none).alias("found"))
        return let(F.aggregate(own, first, step), lambda b: F.struct(b["at"].alias("at"), F.concat(acc["found"], b["found"]).alias("found")))

    return F.when(text.isNotNull(), let(pairs, lambda p: F.aggregate(blocks(p), empty, block, lambda acc: acc["found"])))


def blocks(items: Column, size: int = 512) -> Column:
    """``items`` (evaluated for every block: use within ``let``) in arrays of ``size``.

    Appending to an array copies it, so long ones are put together block by block.
    """
    return F.when(F.size(items) == 0, F.slice(F.array(items), 1, 0)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int")), lambda i: F.slice(items, i * size + 1, F.lit(size))))


def overlaps(a: Column, b: Column) -> Column:
    """Whether half-open spans share a position."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, where a lambda within would evaluate it for every element."""
    return F.transform(F.array(value), use)[0]


def apart(spans_: Column, reserved: Column) -> Column:
    """The spans that share no position with any of ``reserved``."""
    return let(reserved, lambda taken: F.filter(spans_, lambda s: ~F.exists(taken, lambda r: overlaps(s, r))))


def merged(spans_: Column) -> Column:
    """Spans (start, end) joined where they overlap or touch, in order."""
    plain = F.array_sort(F.transform(spans_, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))))
    empty = F.expr("cast(array() AS array<struct<start:int,end:int>>)")

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]), joined).otherwise(F.concat(acc, F.array(s)))

    def safe(acc: Column, s: Column) -> Column:
        return F.when(F.size(acc) == 0, F.array(s)).otherwise(step(acc, s))

    def block(acc: Column, own: Column) -> Column:
        # The last span so far goes on into the block, which is joined by itself first.
        n = F.size(acc)
        return F.concat(F.slice(acc, 1, F.greatest(n - 1, F.lit(0))), F.aggregate(own, F.slice(acc, F.greatest(n, F.lit(1)), F.lit(1)), safe))

    return let(plain, lambda p: F.aggregate(blocks(p), empty, block))


def json_value(text: Column) -> Column:
    """``text`` as one JSON value, or null.

    The parser alone passes over what follows a value; in brackets and in braces nothing that follows can close both.
    """
    one = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    closed = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    return F.when(closed, let(one, lambda a: F.when(F.size(a) == 1, a[0])))


def json_metadata(text: Column, nested: bool = False) -> Column:
    """Whether a JSON text is an object of plain values (with ``nested`` also of objects of plain values)."""
    shape = F.schema_of_variant(json_value(text))
    name = r"(?:`[^`]*`|[^<>`:]+)"
    plain = r"(?:STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|DATE|TIMESTAMP(?:_NTZ)?|DECIMAL\(\d+,\d+\))"
    flat = rf"OBJECT<(?:{name}: {plain}(?:, |(?=>)))*>"
    value = rf"(?:{plain}|{flat})" if nested else plain
    return F.coalesce(shape.rlike(rf"^OBJECT<(?:{name}: {value}(?:, |(?=>)))*>$"), F.lit(False))


