"""One consistent form for texts that look the same but differ in their characters.

Compatibility forms and accents are composed one way, special spaces become spaces, characters that show
nothing are removed, letters of other alphabets that look like Latin ones become Latin, and for comparison
without case the text is fully case-folded. Work is done once for each distinct value of a batch.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.runtime import spread, stage

# Letters of other alphabets and, below each, the Latin letter that it looks like.
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυ"
GREEK_LATIN = "ABEZHIKMNOPTYXaivopu"
CYRILLIC = "АВЕЅІЈКМНОРСТУХҮԌԚԜӀаеѕіјорсухһԛԝӏԁ"
CYRILLIC_LATIN = "ABESIJKMHOPCTYXYGQWIaesijopcyxhqwld"
OTHER = "ɑɡıȷⲟⲣ"
OTHER_LATIN = "agijop"
LOOKALIKES = dict(zip(GREEK + CYRILLIC + OTHER, GREEK_LATIN + CYRILLIC_LATIN + OTHER_LATIN, strict=True))
#: Code points that show nothing (default-ignorable), as ranges.
IGNORABLE = (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF)
#: Spaces other than the plain one, tab and line ends.
SPACES = "\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

_IGNORABLE = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in IGNORABLE) + "]+")
_MAPPED = re.compile("[" + "".join(LOOKALIKES) + SPACES + "]")
_MAP = LOOKALIKES | dict.fromkeys(SPACES, " ")


def plain(text: str) -> str:
    """``text`` in its consistent form, case kept."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKD", _IGNORABLE.sub("", text))
    return unicodedata.normalize("NFC", _MAPPED.sub(lambda m: _MAP[m[0]], text))


def folded(text: str) -> str:
    """``plain(text)`` without differences of case; a fixed point of itself."""
    return unicodedata.normalize("NFKC", plain(text).casefold())


def confusables(lines: Iterable[str]) -> dict[str, str]:
    """Look-alikes from a public table of confusable characters: code points in hexadecimal, ``source ; target ; type # remark``.

    Taken are letters of other scripts that look like one Latin letter; for ``normalise(..., lookalikes=...)``.
    """
    found = {}
    for line in lines:
        fields = [f.strip() for f in line.split("#")[0].lstrip("\ufeff").split(";")]
        if len(fields) >= 2 and " " not in fields[0] and " " not in fields[1]:
            source, target = (chr(int(f, 16)) for f in fields[:2])
            if source.isalpha() and target.isascii() and target.isalpha() and not source.isascii():
                found[source] = target
    return found


def normalise(df: DataFrame, text_col: str = "text", out: str = "plain_text", fold_case: bool = False, lookalikes: dict[str, str] | None = None) -> DataFrame:
    """``df`` with the consistent form of ``text_col`` in a column ``out`` (replaced if it exists).

    ``lookalikes`` maps more letters (one to one), before those that are known here.

    Null stays null, empty stays empty; a text made of invisible characters alone becomes empty. Narrow.
    """
    make = folded if fold_case else plain
    more = str.maketrans(lookalikes or {})

    @F.pandas_udf("string")
    def run(texts):  # type: ignore[no-untyped-def]
        found = {t: make(t.translate(more) if more else t) for t in texts.dropna().unique()}
        return texts.map(found).astype(object).where(texts.notna(), None)

    return df.withColumn(out, run(df[text_col]))


def fingerprints(df: DataFrame, kind: str, key_col: str, text_col: str) -> DataFrame:
    """(kind, key, stored, plain, folded): keys with 128-bit hashes of the stored and of the consistent forms.

    Rows with a null key or text have none; a row delivered again counts once where it is grouped.
    """
    rows = spread(df.select(df[key_col].cast("string").alias("key"), df[text_col].alias("text")).where("key IS NOT NULL AND text IS NOT NULL"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            texts = coded.dictionary.to_pylist()
            forms = [plain(t) for t in texts]
            cols = [[xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in xs] for xs in (texts, forms, (unicodedata.normalize("NFKC", f.casefold()) for f in forms))]
            keys = batch.column(0)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(keys)), keys, *(pa.array(c, pa.binary()).take(coded.indices) for c in cols)], names=["kind", "key", "stored", "plain", "folded"])

    return rows.mapInArrow(run, "kind string, key string, stored binary, plain binary, folded binary")


def same_looking(marks: DataFrame) -> DataFrame:
    """Pairs (kind, key_a, key_b), key_a < key_b, of records stored differently with one consistent form.

    ``marks`` is what ``fingerprints`` gives. Forms are grouped without case first; within a group only
    texts whose form agrees with case are a pair. Different stored forms are paired, each once, and only
    pairs of forms become pairs of keys: copies stored alike, however many, never meet each other.
    """
    marks = stage(marks.distinct(), "marks")
    groups = marks.groupBy("kind", "folded", "plain").agg(F.min("stored").alias("a"), F.max("stored").alias("b")).where("a <> b")
    several = stage(marks.join(groups.select("kind", "folded", "plain"), ["kind", "folded", "plain"]), "several")
    forms = several.select("kind", "folded", "plain", "stored").distinct()
    pairs = forms.withColumnRenamed("stored", "stored_a").join(forms.withColumnRenamed("stored", "stored_b"), ["kind", "folded", "plain"]).where("stored_a < stored_b").select("kind", "stored_a", "stored_b")
    keys = several.select("kind", "stored", "key")
    found = pairs.join(keys.toDF("kind", "stored_a", "x"), ["kind", "stored_a"]).join(keys.toDF("kind", "stored_b", "y"), ["kind", "stored_b"])
    return found.where("x <> y").select("kind", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def classes(marks: DataFrame) -> DataFrame:
    """(kind, key, class_key, n_forms): every record with the least key of those of its consistent form.

    ``n_forms`` counts the different stored forms in the class. One row a record, linear in the records.
    """
    sums = marks.groupBy("kind", "plain").agg(F.min("key").alias("class_key"), F.countDistinct("stored").alias("n_forms"))
    return marks.select("kind", "plain", "key").distinct().join(sums, ["kind", "plain"]).select("kind", "key", "class_key", "n_forms")

