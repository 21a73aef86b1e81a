import random

import pytest

from marginalia.llm import spans


def brute(docs, span):
    where = {}
    for d, t in docs:
        for i in range(len(t or "") - span + 1):
            where.setdefault(t[i : i + span], set()).add(d)
    found = []
    for d in {d for d, _ in docs}:
        covered = set()
        for k, t in docs:
            if k == d:
                for i in range(len(t or "") - span + 1):
                    if len(where[t[i : i + span]]) > 1:
                        covered |= set(range(i, i + span))
        run = None
        for p in sorted(covered):
            if run and p == run[1]:
                run[1] = p + 1
            else:
                if run:
                    found.append((d, *run))
                run = [p, p + 1]
        if run:
            found.append((d, *run))
    return sorted(found)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé😀") for _ in range(rng.randint(1, 5)))
    passages = [" ".join(word() for _ in range(rng.randint(3, 30))) for _ in range(12)]
    return [(i, " ".join(rng.choice([word(), word(), rng.choice(passages)]) for _ in range(rng.randint(0, 25)))) for i in range(n)]


@pytest.mark.parametrize(("seed", "span", "hot"), [(1, 24, 20_000), (2, 40, 3), (3, 9, 2)])
def test_spans_are_those_of_brute_force(spark, seed, span, hot):
    docs = [*corpus(seed), (900, None), (901, ""), (902, "a" * 500), (903, "a" * 300), (904, "short")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    assert sorted(map(tuple, spans.shared_spans(df, span=span, hot=hot).collect())) == brute(docs, span)


def test_repeats_and_nulls(spark):
    text = "the quick brown fox jumps over the lazy dog and runs"
    one = spark.createDataFrame([("a", text, 1), ("a", text, 1), (None, text, 1)], "doc_id string, text string, gram int")
    assert spans.shared_spans(one, span=20).count() == 0  # one record, however often it is delivered
    two = spark.createDataFrame([("a", text), ("b", "x" + text)], "doc_id string, text string")
    assert sorted(map(tuple, spans.shared_spans(two, span=20).collect())) == [("a", 0, len(text)), ("b", 1, len(text) + 1)]
    assert spans.shared_spans(two.limit(0), span=20).count() == 0
    shares = {r.doc_id: r for r in spans.sharing(two.unionByName(spark.createDataFrame([("c", None), ("d", "")], two.schema)), span=20).collect()}
    assert shares["a"].share == 1.0 and shares["b"].shared_chars == len(text) and shares["c"].share is None and shares["d"].share is None


def test_a_text_longer_than_a_block(spark, monkeypatch):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh") for _ in range(3 * spans.BLOCK // 2))
    part = long[spans.BLOCK - 300 : spans.BLOCK + 300]
    df = spark.createDataFrame([(1, long), (2, part)], "doc_id bigint, text string")
    assert sorted(map(tuple, spans.shared_spans(df).collect())) == [(1, spans.BLOCK - 300, spans.BLOCK + 300), (2, 0, 600)]
