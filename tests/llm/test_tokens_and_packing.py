import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import packing, tokens

ALPHABET = "ab's\n\t   　éß漢'\"!?.1293lldm<|endoftext|>zqQZ-—\r"


def texts(n=1500, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 120))) for _ in range(n)]


@pytest.fixture(scope="module")
def encoder():
    return tokens.encoder(tokens.TOKENIZERS, tokens.VOCABULARY)


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), np.int32).tolist()


def test_fragments_give_the_ids_of_the_whole_text(encoder):
    spaced = ["\u00e9 x", "\u00a0 x", "x\u2003y", "\u3000\u00e9", "\u0085 a", "a\u0085b", "\u00e9's", "!'s", "''s", "d'l l", "\u2029  z", "\x1c \x1f x", "\ud800 a"]
    for text in [*texts(), *spaced, "a" * 3000, "qz!x" * 800, "漢字" * 500, " " * 100, "\n \n", "x  y", "don't 'tis", "<|endoftext|>"]:
        assert ids(encoder, text) == encoder.direct.encode_ordinary(text)


def test_ids_are_those_of_the_other_library(encoder):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}.json")
    other.encode_special_tokens = True
    for text in texts(300, seed=2):
        assert ids(encoder, text) == other.encode(text, add_special_tokens=False).ids


def test_forced_pairs_lie_in_no_token(encoder):
    assert not any(encoder.forced[a, b] for t in list(encoder.direct._mergeable_ranks)[:5000] for a, b in zip(t, t[1:]))
    assert encoder.forced[ord("a"), ord(" ")] and not encoder.cuts[:, ord("'")].any()


def test_most_cuts_are_certain_ones(encoder, data):
    """Cuts by kind on real texts: pairs in no token, and white space after a character whose pair is in some token."""
    import pyarrow.parquet as pq

    kinds, longest = Counter(), 0
    for text in pq.read_table(f"{data}/documents.parquet", columns=["text"]).column(0).to_pylist():
        raw = (text or "").encode()
        at = encoder.certain(raw).tolist()
        kinds.update("forced" if encoder.forced[raw[i - 1], raw[i]] else "space" for i in at)
        kinds["words"] += len((text or "").split())
        longest = max([longest, *(j - i for i, j in zip([0, *at], [*at, len(raw)]))])
        assert ids(encoder, text) == encoder.direct.encode_ordinary(text or "")
    assert kinds["forced"] > 0.8 * kinds["words"] and kinds["forced"] > 5 * kinds["space"]


def test_frame(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (None, "a", "x")], "doc_id bigint, text string, ids string")
    found = tokens.encode_texts(df)
    assert found.schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"
    rows = sorted(((r.doc_id, r.ids) for r in found.collect()), key=str)
    assert rows == sorted([(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, []), (None, [64])], key=str)
    assert sorted(r.n_tokens for r in tokens.count_tokens(df).collect()) == [0, 0, 1, 2, 2]
    assert tokens.encode_texts(df.limit(0)).count() == 0


def item_by_item(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= s
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


def test_bulk_packing_is_item_by_item_packing():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.choice([10, 37, 64, 100])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 150))]
        runs = packing.best_fit_decreasing(Counter(sizes), capacity)
        fill = Counter()
        for s, n in Counter(sizes).items():
            own = [r for r in runs if r[0] == s]
            for k in range(n):
                _, first_rank, each, first = [r for r in own if r[1] <= k][-1]
                fill[first + (k - first_rank) // each] += s
        assert sorted(capacity - f for f in fill.values()) == item_by_item(sizes, capacity) and sorted(fill) == list(range(len(fill)))


@pytest.mark.parametrize("ranked", [3, 1000])
def test_pack(spark, ranked):
    rng = random.Random(4)
    sizes = [*(rng.choice([5, 5, 5, rng.randint(1, 40)]) for _ in range(300)), 0, None, 95, 100, 60]
    df = spark.createDataFrame(list(enumerate(sizes)), "id int, n int").withColumn("size", F.lit("clash"))
    rows = packing.pack(df, "id", "n", capacity=40, ranked=ranked).collect()
    fill, pieces = Counter(), Counter()
    for r in rows:
        if r.container_id is not None:
            fill[r.container_id] += r.size
        pieces[r.id] += r.size
    assert all(f <= 40 for f in fill.values()) and sorted(fill) == list(range(len(fill)))
    assert all(pieces[i] == (s or 0) for i, s in enumerate(sizes))
    assert all(sum(r.id == i for r in rows) == 1 for i, s in enumerate(sizes) if (s or 0) <= 40)
    whole = [x for s in sizes for x in ([40] * ((s or 0) // 40) + ([s % 40] if s and s % 40 else []))]
    assert sorted(40 - f for f in fill.values()) == item_by_item(whole, 40)
    assert [(r.piece_no, r.first_unit, r.size) for r in sorted(rows) if r.id == 302] == [(0, 0, 40), (1, 40, 40), (2, 80, 15)]
    assert packing.pack(df.limit(0), "id", "n").count() == 0
