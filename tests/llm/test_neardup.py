import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from marginalia.llm import neardup, queries


def sets(text, words):
    w = text.lower().split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def brute(rows, words, t, least):
    docs = {(k, key): (doc, sets(x, words)) for k, key, doc, x in rows if x is not None and key is not None and len(x.split()) >= max(least, words)}
    found = set()
    for (k, a), (da, x) in docs.items():
        for (k2, b), (db, y) in docs.items():
            if k == k2 and a < b and da != db and len(x & y) * t.denominator >= len(x | y) * t.numerator:
                found.add((k, a, b))
    return found


def records(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 60))] for _ in range(25)]
    template = ["the", "report", "of", "this", "year", "shows", "that", "all", "went", "well"]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.4:
            w = template + w
        rows.append((rng.choice(["document", "chunk"]), f"k{i:03}", f"d{rng.randint(0, 60)}", " ".join(w).upper() if rng.random() < 0.2 else " ".join(w)))
    return [*rows, ("chunk", "k900", "d900", None), ("chunk", "k901", "d901", ""), ("chunk", "k902", "d902", "a " * 40), ("chunk", "k903", "d903", "a " * 50), ("chunk", None, "d904", "a " * 50)]


@pytest.mark.parametrize(
    ("seed", "words", "threshold", "frequent", "k", "counters"),
    [(1, 3, 0.7, 4, 2, 1 << 12), (2, 3, 0.7, 0, 2, 1 << 12), (3, 2, 0.5, 3, 3, 1 << 12), (4, 5, 0.8, 1, 2, 8), (5, 1, 0.5, 2, 2, 1), (6, 1, 0.34, 1, 3, 64)],
)
def test_pairs_are_those_of_brute_force(spark, monkeypatch, seed, words, threshold, frequent, k, counters):
    monkeypatch.setattr(neardup, "PART", 700)
    monkeypatch.setattr(neardup, "BUCKET", 500)
    monkeypatch.setattr(neardup, "HOT", max(frequent + 1, 3))
    rows = records(seed)
    least = 1 if words == 1 else 8
    if words == 1:
        rows += [(kind, f"s{i:03}", f"d{i}", x) for i, x in enumerate(("a", "a b", "b a", "b", "a b c", "c b", "a a a")) for kind in ("document", "chunk")]
    df = spark.createDataFrame([*rows, *rows[:10]], "kind string, key string, doc string, text string").repartition(3)
    found = neardup.near_duplicates(df, words=words, threshold=threshold, least_words=least, counters=counters, k=k, frequent=frequent, share=1.0)
    pairs = {tuple(r) for r in neardup.similar_pairs(*found).collect()}
    assert pairs == brute(rows, words, Fraction(str(threshold)), least)


def test_full_counters_make_no_larger_index():
    """The index holds the prefixes whatever the counters say; full ones only change the order."""
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, 80, dtype=np.uint64)) for _ in range(50)]
    t, seen = Fraction(7, 10), np.zeros(1 << 16, np.uint32)
    for s in sets:
        seen[(s % np.uint64(1 << 16)).astype(np.int64)] += 1
    template = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    many = seen.copy()
    many[(template % np.uint64(1 << 16)).astype(np.int64)] = 4_000_000
    for counts in (seen, seen + np.uint32(3_000_000), many + np.uint32(3_000_000)):
        assert [len(neardup.prefix(s, counts, float(counts.mean()), t)) for s in sets] == [len(s) - -(-len(s) * 7 // 10) + 2 for s in sets]
    # What stands out of the noise of full counters still comes last.
    with_template = np.unique(np.concatenate([sets[0][:60], template]))
    counts = many + rng.poisson(3_000_000, 1 << 16).astype(np.uint32)
    assert not set(neardup.prefix(with_template, counts, float(counts.mean()), t).tolist()) & set(template.tolist())


def test_combinations_do_their_part(spark, data):
    """Tokens of very many sets stay bounded in their bucket, and all their combinations are made."""
    rng = np.random.default_rng(3)
    tokens = np.unique(rng.integers(0, 1 << 62, 12, dtype=np.uint64)) & ~np.uint64(1)
    cls = np.arange(5000, dtype=np.int64)
    batch = neardup.packed(np.tile(tokens, 5000), np.repeat(cls, len(tokens)), np.full(5000 * len(tokens), 40), 2)
    here = [r for r in batch.to_pylist() if not r["known"]]
    assert sum(len(r["cls"]) // 8 for r in here) == neardup.HOT * len(tokens)
    met = neardup.meet(pa.Table.from_batches([batch]), Fraction(7, 10), 4, 0.01)
    assert met.num_rows == 5000 * len(tokens) and set(met.column("posting").to_pylist()) == set(met.column("token").to_pylist()) and set(met.column("token").to_pylist()) == set(tokens.view(np.int64).tolist())
    postings = {"alone": list(range(12)), "together": [5] * 12, "mixed": [1, 1, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9]}
    for name, own in postings.items():
        lists = pa.RecordBatch.from_pydict({"cls": [7], "n": [40], "tokens": [[{"posting": p, "token": i} for i, p in enumerate(own)]]})
        for k, all_ in ((2, 66), (3, 220), (4, 495)):
            found = [r for b in neardup.combined(iter([lists]), k) for r in b.to_pylist()]
            assert sum(r["weight"] for r in found) == all_ and len({r["sig"] for r in found}) == len(found)
            assert (name, len(found)) in {("alone", all_), ("together", 1)} or len(found) < all_


def test_frequent_tokens_have_their_share():
    sizes = np.array([1] * 900 + [2] * 100 + [7] * 10 + [30] * 2)  # 1,230 entries
    assert [neardup._limit(sizes, least, share) for least, share in ((0, 1.0), (4, 0.2), (4, 0.05), (0, 0.11), (0, 0.0), (200, 0.1))] == [0, 4, 7, 2, 30, neardup.HOT - 1]
    assert neardup._limit(np.array([500]), 4, 0.01) == neardup.HOT - 1 and neardup._limit(np.array([], int), 4, 0.01) == 4


def test_classes_and_links(spark):
    text = " ".join(f"w{i}" for i in range(100))
    edited = text.replace("w50", "other")
    df = spark.createDataFrame([("d", "a", "1", text), ("d", "b", "2", text), ("d", "c", "3", edited), ("d", "e", "4", "no " * 30)], "kind string, key string, doc string, text string")
    found = {r.key: r for r in neardup.classes(*neardup.near_duplicates(df)).collect()}
    assert found["a"].class_id == found["b"].class_id != found["c"].class_id
    assert [found[k].n_links for k in "abce"] == [1, 1, 1, 0]
    members, links = neardup.near_duplicates(df.limit(0))
    assert members.count() == links.count() == 0


def test_classes_have_every_record(spark):
    texts = {"a": "One two\tthree", "b": "one TWO three", "c": "one two", "d": "one two three four five", "e": "One two three  four five", "f": "", "g": " \n", "h": None, "i": "one two three four five six", "j": "three two one", "k": "x " * 19, "l": "x " * 12}
    rows = [("d", k, k, x) for k, x in texts.items()] + [("e", "a", "a", "one two three"), ("d", "h", "h", None), ("d", "a", "a", texts["a"]), ("d", None, "z", "one")]
    df = spark.createDataFrame(rows, "kind string, key string, doc string, text string").repartition(3)
    found = neardup.classes(*neardup.near_duplicates(df, least_words=0)).collect()
    assert sorted((r.kind, r.key) for r in found) == sorted({r[:2] for r in rows if r[1]})
    groups = {}
    for r in found:
        groups.setdefault(r.class_id, []).append(r.kind + r.key)
    assert sorted(map(sorted, groups.values())) == [["da", "db"], ["dc"], ["dd", "de"], ["df", "dg"], ["dh"], ["di"], ["dj"], ["dk", "dl"], ["ea"]]
    assert groups[None] == ["dh"] and not any(r.n_links for r in found)


def test_query_has_a_row_for_every_record(spark, data):
    records = {tuple(r) for r in queries._texts(spark, data).select("kind", "key").collect()}
    found = [tuple(r) for r in queries.p6_classes(spark, data).select("kind", "key").collect()]
    assert len(found) == len(records) and set(found) == records


def test_parity_maps_differ_at_most_as_the_sets():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
        b = np.unique(np.concatenate([a[30:], rng.integers(0, 1 << 63, 20, dtype=np.uint64)]))
        differ = sum(int(x).bit_count() for x in (neardup.parity(a).view(np.uint64) ^ neardup.parity(b).view(np.uint64)))
        assert differ <= len(np.setxor1d(a, b))
