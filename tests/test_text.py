import random
import re
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions.dialect import S, WS_CHARS, W
from marginalia.operators import extract

ALPHABET = "aB.1 $%,-\n\t\r\x1c\x85\xa0　é😀#*'()[]https://:2024kg"


def texts(n=400, seed=1):
    rng = random.Random(seed)
    words = ["IBM", "Ada Lovelace", "is", "means", "refers to", "2024-01-02", "March 2020", "$1,200.5", "12%", "5 kg", "https://x.org/a.", "[d 1999](http://y.org)", "O'Brien-Smith Jones", "v2.0", "5%x", "1.2.3", "-5"]
    found = ["", " ", ".", "a.b. c.", "no stop"]
    for _ in range(n):
        found.append("".join(rng.choice([rng.choice(words), rng.choice(ALPHABET), rng.choice(" .\n")]) for _ in range(rng.randint(1, 40))))
    return found


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id int, text string")


def column(spark, values, make):
    return [r.v for r in frame(spark, values).select("id", make(F.col("text")).alias("v")).orderBy("id").collect()]


def test_white_space_is_that_of_unicode():
    spaces = {chr(c) for c in range(0x110000) if chr(c).isspace()}
    assert set(WS_CHARS) == spaces
    assert {c for c in map(chr, range(0x110000)) if re.match(S, c)} == spaces and W


def test_counts_and_content(spark):
    values = texts()
    assert column(spark, values, T.word_count) == [len(v.split()) for v in values]
    assert column(spark, values, T.character_count) == [len(v) for v in values]
    assert column(spark, values, T.has_content) == [bool(v.strip()) for v in values]
    assert column(spark, [None], T.has_content) == [False]


def test_sentences(spark):
    values = texts()
    expected = [[p.strip() for p in re.findall(r"(?s)(.*?\.)(?=\s|\Z)", v)] for v in values]
    assert column(spark, values, T.sentences) == expected


def test_spans_give_offsets_in_code_points(spark):
    values = [*texts(), "😀 5 kg 😀 12%"]
    for pattern in (extract.METRIC, extract.DATE, extract.URL, extract.LINK):
        plain = re.compile(pattern.replace("(?U)(?i)", "(?i)"))
        expected = [[(m.start(), m.end(), m[0]) for m in plain.finditer(v)] for v in values]
        assert [[tuple(s) for s in spans] for spans in column(spark, values, lambda c: T.spans(c, pattern))] == expected


def test_title_case(spark):
    values = ["Don't Stop", "A-B", "3Rd Place", "3rd Place", "Hello World", "hello", "123", "Über Alles", "McDonald", "X"]
    assert column(spark, values, T.title_case) == [v == v.title() and any(map(str.isalpha, v)) for v in values]


def test_uuid5_and_fingerprint(spark):
    import hashlib

    values = texts(50)
    space = uuid.UUID(T.CHUNK_NAMESPACE)
    assert column(spark, values, lambda c: T.uuid5(c, T.CHUNK_NAMESPACE)) == [str(uuid.uuid5(space, v)) for v in values]
    assert column(spark, values, lambda c: T.fingerprint(F.lit("f"), F.lit("txt"), c)) == [hashlib.sha256(f"f\x1ftxt\x1f{v}".encode()).hexdigest() for v in values]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 8)), max_size=8), min_size=1, max_size=8))
def test_merged_spans(spark, rows):
    lists = [[(a, a + n) for a, n in row] for row in rows]
    df = spark.createDataFrame([(i, row) for i, row in enumerate(lists)], "id int, spans array<struct<start:int,end:int>>")
    found = [[tuple(s) for s in r.v] for r in df.select("id", T.merged(F.col("spans")).alias("v")).orderBy("id").collect()]
    for row, mine in zip(lists, found):
        covered = sorted({p for a, b in row for p in range(a, b)})
        joined = []
        for a, b in sorted(row):
            if joined and a <= joined[-1][1]:
                joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
            else:
                joined.append((a, b))
        assert mine == joined and covered == [p for a, b in mine for p in range(a, b)]


def test_json_metadata(spark):
    values = ['{"a": 1, "b": "x", "c": null, "d": true, "e": 1.5}', "{}", '{"a": {"b": 1}}', '{"a": {"b": {"c": 1}}}', '{"a": [1]}', "[1]", "nonsense", "1", '{"a": 1}]', '{"a": 1}}', '{"a": 1}, {}', '{"a": 1} x']
    assert column(spark, values, T.json_metadata) == [True, True] + [False] * 10
    assert column(spark, values, lambda c: T.json_metadata(c, nested=True)) == [True, True, True] + [False] * 9


def test_many_matches_in_one_text(spark):
    """A hundred thousand matches, and as many spans to merge, in one text."""
    n = 100_000
    rows = frame(spark, ["12% é " * n]).select(T.spans(F.col("text"), extract.METRIC).alias("s"))
    r = rows.select(F.size("s").alias("n"), F.col("s")[n - 1]["start"].alias("last"), F.size(T.merged(F.col("s"))).alias("m")).first()
    assert (r.n, r.last, r.m) == (n, 6 * (n - 1), n)
