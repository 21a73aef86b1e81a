"""Groups of near-duplicate records by prefixes of token combinations.

Records are sets of word sequences (shingles, the tokens of this index). Two sets whose similarity reaches the threshold
t have at least k tokens in common among the first |x| - ceil(t |x|) + k of each, in any order of tokens that is the
same for all. The order here is from rare to frequent. All tokens of these extended prefixes meet by token, which counts
exactly how many sets have each: one that few sets share brings these together by itself; frequent ones do so
only in combinations of k, so that a token of a template never brings together all records that use it. Either
a rare token is shared, or k frequent ones and so their combination. The matches counted in the index bound the
possible overlap, which leaves hardly any pair besides the true ones; these are verified on the whole sets.

Nothing here depends on the corpus being small: whether a token is rare is counted, not estimated. Only the
order is estimated (from counters of fixed size), and by how far a counter stands out above what chance puts there.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.sketch import Bits, merged, saturating_sum, slices
from marginalia.runtime import spread, stage

WORDS = 5
THRESHOLD = 0.8
LEAST_WORDS = 20
#: Tokens in a combination; the part of all prefix entries that may be of frequent tokens, and the sets that share a token
#: up to which it is rare in any case.
COMBINED, SHARE, FREQUENT = 2, 0.01, 4
#: Counters (32 bits each) of token frequencies, which decide the order of tokens and nothing else, and the most bits of
#: the filter of texts to verify, which lets more through when full. Both are of fixed size and only steer work.
COUNTERS = 1 << 23
FILTER_BITS = 1 << 28
#: Prefix tokens that one task sorts at once and, about, that meet in one bucket. Of the sets that have one
#: token in such a part, those after the first HOT don't travel to the token's bucket: it is proved frequent already.
PART, BUCKET, HOT = 1 << 20, 1 << 18, 128
#: Bits of each class's parity map.
PARITY_BITS = 1024
_MEMO = 300_000

_words: dict[str, int] = {}
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def shingles(text: str, kind: str, words: int = WORDS, least: int = LEAST_WORDS) -> np.ndarray | None:
    """Hashes of the different sequences of ``words`` lower-cased words, sorted; None below ``least`` words.

    A text of fewer than ``words`` words (none at all, too) that is not below ``least`` is the set of its whole sequence.
    """
    tokens = text.lower().split()
    if len(tokens) < least:
        return None
    if len(_words) > _MEMO:
        _words.clear()
    get, hashed = _words.get, xxhash.xxh3_64_intdigest
    values = []
    for w in tokens:
        h = get(w)
        if h is None:
            h = _words[w] = hashed(w.encode("utf-8", "surrogatepass"))
        values.append(h)
    w = np.array(values, np.uint64)
    n = max(1, len(w) - words + 1)
    h = np.full(n, xxhash.xxh3_64_intdigest(kind), np.uint64)
    for k in range(min(words, len(w))):
        h = _mix(h * _K[k % len(_K)] + w[k : k + n])
    return np.unique(h)


def _least_common(n: int, t: Fraction) -> int:
    """The least number of shingles that a set of n shares with any set similar to it."""
    return -(-n * t.numerator // t.denominator)


def prefix(tokens: np.ndarray, counts: np.ndarray, mean: float, t: Fraction, k: int = COMBINED) -> np.ndarray:
    """The extended prefix of a set: its first tokens from rare to frequent."""
    n = len(tokens)
    seen = counts[(tokens % np.uint64(len(counts))).astype(np.int64)]
    rank = np.log2(np.maximum(seen - (mean + 4 * math.sqrt(mean)), 0) + 1).astype(np.uint64)
    order = np.argsort((rank << np.uint64(56)) | (tokens >> np.uint64(8)), kind="stable")
    return tokens[order[: min(n, n - _least_common(n, t) + k)]]


def _planes(x: np.ndarray) -> bytes:
    """The bytes of integers, all first bytes first: those that are zero compress to nothing in the exchange."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _integers(planes: bytes, dtype: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


_PACKED = "bucket int, known boolean, tokens binary, cls binary, n binary"


def packed(tokens: np.ndarray, cls: np.ndarray, n: np.ndarray, bits: int) -> pa.RecordBatch:
    """Entries (token, class, size of the set) by bucket (the first ``bits`` bits of the token), sorted and packed.

    Tokens of more than HOT different classes are frequent: entries after these go on as ``known`` to be so, spread by class.
    """
    order = np.lexsort((cls, tokens))
    tokens, cls, n = tokens[order], cls[order], n[order]
    new = np.r_[True, (tokens[1:] != tokens[:-1]) | (cls[1:] != cls[:-1])]
    tokens, cls, n = tokens[new], cls[new], n[new]
    first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    place = np.arange(len(tokens)) - np.repeat(first, np.diff(np.r_[first, len(tokens)]))
    known = (place >= HOT) & (tokens & np.uint64(1) == 0)
    rows = []
    for flag, at in ((False, np.flatnonzero(~known)), (True, np.flatnonzero(known))):
        bucket = ((cls[at].view(np.uint64) if flag else tokens[at]) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(at), np.int64)
        if flag:
            order = np.argsort(bucket, kind="stable")
            at, bucket = at[order], bucket[order]
        for own in np.split(np.arange(len(at)), np.flatnonzero(np.diff(bucket)) + 1) if len(at) else ():
            i = at[own]
            step = np.diff(tokens[i], prepend=np.uint64(0))
            rows.append((int(bucket[own[0]]), flag, _planes(step), cls[i].tobytes(), _planes(n[i].astype(np.uint32))))
    columns = list(zip(*rows)) or [()] * 5
    types = [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), x) for c, x in zip(columns, types)], names=["bucket", "known", "tokens", "cls", "n"])


_MET = "a bigint, b bigint, n_a int, n_b int, hits bigint, token bigint, posting bigint"


def _limit(sizes: np.ndarray, frequent: int, share: float) -> int:
    """The sets that share a token up to which it is rare, so that frequent tokens have ``share`` of the entries.

    A bucket holds tokens by their hash, so its own sizes stand for those of the corpus. Entries that were held back from
    their bucket are of tokens with at least HOT others, which are always frequent.
    """
    entries = np.bincount(sizes, weights=sizes, minlength=2)
    above = entries.sum() - np.cumsum(entries)  # entries of tokens with more sets than the place says
    fitting = int(np.argmax(above <= share * entries.sum()))
    return min(max(frequent, fitting), HOT - 1)


def meet(table: pa.Table, t: Fraction, frequent: int, share: float) -> pa.Table:
    """What meets in one bucket: pairs of classes with the rare tokens that they share, and the entries of frequent tokens.

    The latter have the class as ``a``, its size as ``n_a``, the token and a hash of the classes that have it. Where some of
    these may not have come here (from HOT on) the token itself stands for them. A token with its lowest bit set is never frequent.
    """
    parts: list[list[np.ndarray]] = [[], [], []]
    sure: list[list[np.ndarray]] = [[], [], []]
    for known, tokens, cls, n in zip(*(table.column(c).to_pylist() for c in ("known", "tokens", "cls", "n"))):
        for own, x in zip(sure if known else parts, (np.cumsum(_integers(tokens, np.uint64)), np.frombuffer(cls, np.int64), _integers(n, np.uint32).astype(np.int64))):
            own.append(x)
    tokens, cls, n = (np.concatenate(x) if x else np.empty(0, d) for x, d in zip(parts, (np.uint64, np.int64, np.int64)))
    order = np.lexsort((cls, tokens))
    tokens, cls, n = tokens[order], cls[order], n[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (cls[1:] != cls[:-1])  # copies that other tasks sent
    tokens, cls, n = tokens[new], cls[new], n[new]
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    first = np.flatnonzero(new)
    sizes = np.diff(np.r_[first, len(tokens)])
    often = (sizes > _limit(sizes, frequent, share)) & (tokens[first] & np.uint64(1) == 0)
    p, q = t.numerator, t.denominator
    found: list[np.ndarray] = []
    for size in np.unique(sizes[~often & (sizes > 1)]).tolist():
        at = first[~often & (sizes == size)]
        for i in range(size):  # below HOT but for sets that are shorter than a combination
            for j in range(i + 1, size):
                x, y = at + i, at + j
                ok = (n[x] * q >= n[y] * p) & (n[y] * q >= n[x] * p)
                found.append(np.stack([cls[x], cls[y], n[x], n[y]], 1)[ok])
    pairs = np.concatenate(found) if found else np.empty((0, 4), np.int64)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:, 0] != pairs[:-1, 0]) | (pairs[1:, 1] != pairs[:-1, 1])
    start = np.flatnonzero(new)
    hits = np.diff(np.r_[start, len(pairs)])
    pairs = pairs[start]
    many = np.repeat(often, sizes)
    posting = np.add.reduceat(_mix(cls.view(np.uint64) * _K[3]), first) if len(first) else tokens
    posting = np.repeat(np.where(sizes < HOT, posting, tokens[first]), sizes)
    entries = [np.concatenate([x[many], *y]) for x, y in zip((tokens, cls, n, posting), (*sure, sure[0]))]
    none, gone = pa.nulls(len(entries[0]), pa.int64()), pa.nulls(len(pairs), pa.int64())
    columns = [
        pa.chunked_array([pa.array(pairs[:, 0]), pa.array(entries[1])]),
        pa.chunked_array([pa.array(pairs[:, 1]), none]),
        pa.chunked_array([pa.array(pairs[:, 2].astype(np.int32)), pa.array(entries[2].astype(np.int32))]),
        pa.chunked_array([pa.array(pairs[:, 3].astype(np.int32)), none.cast(pa.int32())]),
        pa.chunked_array([pa.array(hits.astype(np.int64)), none]),
        *(pa.chunked_array([gone, pa.array(entries[x].view(np.int64))]) for x in (0, 3)),
    ]
    return pa.table(columns, names=["a", "b", "n_a", "n_b", "hits", "token", "posting"])


def combined(lists: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(sig, cls, n, weight): the combinations of k of a set's frequent tokens; input (cls, n, [(posting, token)]).

    Tokens that the same sets have are shared together or not at all, so each such group is combined as one and
    ``weight`` tells how many combinations of tokens that is. All versions of one text have few groups, however long it is.
    """

    def rows(sigs: list[np.ndarray], weights: list[np.ndarray], cls: list[int], n: list[int]) -> pa.RecordBatch:
        each = [len(s) for s in sigs]
        columns = [np.concatenate(sigs).view(np.int64), np.repeat(np.array(cls, np.int64), each), np.repeat(np.array(n, np.int32), each), np.concatenate(weights).astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["sig", "cls", "n", "weight"])

    def parts(own: np.ndarray, m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # All combinations whose first k - 2 members are fixed come at once; a text's are never held together.
        for lead in combinations_with_replacement(range(len(own)), k - 2):
            taken = np.bincount(np.array(lead, np.int64), minlength=len(own))
            if (taken > m).any():
                continue
            least = lead[-1] if lead else 0
            i, j = np.triu_indices(len(own) - least)
            i, j = i + least, j + least
            ways = np.where(i == j, m[i] * (m[i] - 1) // 2, m[i] * m[j])
            if lead:  # which may take from these groups, too
                ways = np.array([math.prod(math.comb(int(m[x]), c) for x, c in Counter([*lead, a, b]).items()) for a, b in zip(i.tolist(), j.tolist())], np.int64)
            h = _mix(own[i] * _K[0] + own[j] * _K[1])
            for x in lead:
                h = _mix(h + own[x : x + 1] * _K[2])
            yield h[ways > 0], ways[ways > 0]

    sigs, weights, owners, sizes, held = [], [], [], [], 0
    for batch in lists:
        for cls, n, tokens in zip(*(c.to_pylist() for c in batch.columns)):
            own, m = np.unique(np.array([x["posting"] for x in tokens], np.int64).view(np.uint64), return_counts=True)
            for h, ways in parts(own, m):
                sigs.append(h), weights.append(ways), owners.append(cls), sizes.append(n)
                held += len(h)
                if held >= 100_000:
                    yield rows(sigs, weights, owners, sizes)
                    sigs, weights, owners, sizes, held = [], [], [], [], 0
    if sigs:
        yield rows(sigs, weights, owners, sizes)


def parity(tokens: np.ndarray) -> np.ndarray:
    """For each of PARITY_BITS parts of the hashes whether the set has an odd number in it, as 64-bit integers.

    Sets that differ in d shingles differ in at most d of these bits.
    """
    odd = np.bincount((tokens >> np.uint64(40)).astype(np.int64) % PARITY_BITS, minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


_SURVEYED = "kind string, key string, doc string, cls bigint, n int, mark bigint, bits array<bigint>, slice int, counts binary"


def _mark(text: str, kind: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed=len(kind)) - (1 << 63)


def _class(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def near_duplicates(
    records: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS, counters: int = COUNTERS, k: int = COMBINED, frequent: int = FREQUENT, share: float = SHARE
) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets and links between similar ones, of ``records`` (kind, key, doc, text).

    Returns members (kind, key, doc, cls, n), one for each record with at least ``least_words`` words, and links
    (a, b, inter, n_a, n_b) between the different classes a < b of a kind with a similarity of at least
    ``threshold``. Records with equal sets share a class and are nowhere expanded into pairs. Words are maximal runs
    without white space, lower-cased. Rows with a null key and texts with fewer words are no members; a row
    delivered again counts once. Ids of classes are 64-bit hashes of the sets. Where ``least_words`` is below ``words``,
    a shorter text is the set of its whole sequence: in a class with those of the same words, similar to no other.
    A null text is a member, of no class (null), only if ``least_words`` is 0.

    ``k`` (2 or more) tokens make a combination. Tokens are frequent from the most frequent on as long as they have no
    more than ``share`` of the prefix entries, but not with ``frequent`` sets or fewer, and always with HOT or more.
    A set with c groups of frequent tokens (``combined``) in its prefix has about C(c, k) combinations.
    """
    if k < 2:
        raise ValueError("a combination has at least two tokens")
    t = Fraction(str(threshold))
    # Sets so small that two similar ones may share fewer than k tokens also meet by single tokens, among themselves.
    small = int((k - 1) / t)
    spark = records.sparkSession
    rows = spread(records.select("kind", "key", "doc", "text").where("key IS NOT NULL AND text IS NOT NULL"))

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, done = np.zeros(counters, np.uint32), set()
        types = [pa.string()] * 3 + [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
        names = [f.split()[0] for f in _SURVEYED.split(", ")]
        make = lambda found: pa.RecordBatch.from_arrays([pa.array(list(c), x) for c, x in zip(list(zip(*found)) or [()] * 9, types)], names=names)
        for batch in batches:
            found, sets = [], []
            for kind, key, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                s = shingles(text, kind, words, least_words)
                if s is not None:
                    cls, bits = _class(s), None
                    if cls not in done:  # copies in one task are counted once
                        bits = parity(s)
                        sets.append(s)
                        if len(done) < _MEMO:
                            done.add(cls)
                    found.append((kind, key, doc, cls, len(s), _mark(text, kind), bits, None, None))
            if sets:
                at, n = np.unique((np.concatenate(sets) % np.uint64(counters)).astype(np.int64), return_counts=True)
                own[at] = saturating_sum(own[at], n.astype(np.uint32), np.empty(len(at), np.uint32))
            yield make(found)
        yield make([(*[None] * 7, i, part) for i, part in slices(own)])

    surveyed = stage(rows.mapInArrow(survey, _SURVEYED), "surveyed")
    counts = merged(surveyed.where("slice IS NOT NULL").select("slice", F.col("counts").alias("n")), counters, "uint32", saturating_sum)
    total = float(counts.sum(dtype=np.float64))
    mean = total / counters
    shared = spark.sparkContext.broadcast(counts)  # of fixed size
    bits = max(0, math.ceil(math.log2(max(1.0, total * float(1 - t) / BUCKET))))

    indexed = surveyed.where("slice IS NULL").drop("slice", "counts")
    members = indexed.select("kind", "key", "doc", "cls", "n").distinct()
    if least_words <= 0:
        unknown = records.where("key IS NOT NULL AND text IS NULL").select("kind", "key", "doc").distinct()
        members = members.unionByName(unknown.select("*", F.lit(None).cast("bigint").alias("cls"), F.lit(0).alias("n")))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        tokens, cls, sizes, held = [], [], [], 0

        def part() -> pa.RecordBatch:
            each = [len(x) for x in tokens]
            return packed(np.concatenate(tokens), np.repeat(np.array(cls, np.int64), each), np.repeat(np.array(sizes, np.int64), each), bits)

        for batch in batches:
            for kind, text in zip(*(c.to_pylist() for c in batch.columns)):
                s = shingles(text, kind, words, least_words)
                if s is None or (own := _class(s)) in done:
                    continue
                if len(done) < _MEMO:
                    done.add(own)
                found = prefix(s, shared.value, mean, t, k) & ~np.uint64(1)
                if 1 < small and len(s) <= small:
                    found = np.concatenate([found, s | np.uint64(1)])
                tokens.append(found), cls.append(own), sizes.append(len(s))
                held += len(found)
                if held >= PART:
                    yield part()
                    tokens, cls, sizes, held = [], [], [], 0
        if tokens:
            yield part()

    entries = rows.select("kind", "text").mapInArrow(index, _PACKED)
    met = stage(entries.groupBy("bucket").applyInArrow(lambda table: meet(table, t, frequent, share), _MET), "met")
    p, q = t.numerator, t.denominator
    # The frequent tokens of a set are at most its prefix.
    often = met.where("token IS NOT NULL").groupBy(F.col("a").alias("cls"), F.col("n_a").alias("n")).agg(F.collect_set(F.struct("posting", "token")).alias("tokens")).where(F.size("tokens") >= k)
    sigs = often.mapInArrow(lambda batches: combined(batches, k), "sig bigint, cls bigint, n int, weight bigint")
    sized = (F.col("a") < F.col("b")) & (F.col("n_a") * q >= F.col("n_b") * p) & (F.col("n_b") * q >= F.col("n_a") * p)
    together = sigs.toDF("sig", "a", "n_a", "weight").join(sigs.toDF("sig", "b", "n_b", "same_weight"), "sig").where(sized).groupBy("a", "b", "n_a", "n_b").agg(F.lit(0).cast("bigint").alias("hits"), F.sum("weight").alias("combinations"))
    met = met.where("token IS NULL").select("a", "b", "n_a", "n_b", "hits", F.lit(0).cast("bigint").alias("combinations")).unionByName(together)
    met = met.groupBy("a", "b", "n_a", "n_b").agg(F.sum("hits").alias("rare"), F.sum("combinations").alias("combinations"))
    # x common frequent tokens have C(x, k) >= (x - k + 1)^k / k! combinations. Of the tokens after a prefix (of
    # all but ceil(t n) - k) every one may be common.
    common = F.col("rare") + (k - 1) + F.floor(F.pow(F.col("combinations") * math.factorial(k), F.lit(1.0 / k)) + 1e-6)
    after = F.greatest(*(F.ceil(F.col(n) * p / F.lit(float(q)) - 1e-9) - k for n in ("n_a", "n_b")))
    bound = (F.col("n_a") + F.col("n_b")) * p  # overlap * (p + q) >= bound
    met = met.where((common + F.greatest(after, F.lit(0))) * (p + q) >= bound).select("a", "b", "n_a", "n_b")
    # The parity maps' difference is at most that of the sets, which is at most (n_a + n_b) (q - p) / (q + p).
    maps = indexed.where("bits IS NOT NULL").select("cls", "bits").dropDuplicates(["cls"])
    met = met.join(maps.toDF("a", "bits_a"), "a").join(maps.toDF("b", "bits_b"), "b")
    differ = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    candidates = stage(met.where(differ * (p + q) <= (F.col("n_a") + F.col("n_b")) * (q - p)).select("a", "b", "n_a", "n_b"), "candidates")

    needed = stage(candidates.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "needed")
    marks = indexed.groupBy("cls").agg(F.min("mark").alias("mark")).join(needed, "cls").select("mark")
    wanted = spark.sparkContext.broadcast(Bits.of(marks, Bits.size(needed.count(), FILTER_BITS)))  # of bounded size

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            cls, found = [], []
            kinds, texts = (c.to_pylist() for c in batch.columns)
            marks = [_mark(text, kind) for kind, text in zip(kinds, texts)]
            for i in np.flatnonzero(Bits.has(wanted.value, np.array(marks, np.int64))).tolist():
                if marks[i] not in done and (s := shingles(texts[i], kinds[i], words, least_words)) is not None:
                    if len(done) < _MEMO:
                        done.add(marks[i])
                    cls.append(_class(s))
                    found.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(found, pa.binary())], names=["cls", "shingles"])

    whole = rows.select("kind", "text").mapInArrow(sets, "cls bigint, shingles binary").join(needed, "cls", "left_semi").dropDuplicates(["cls"])
    both = candidates.join(whole.select(F.col("cls").alias("a"), F.col("shingles").alias("s_a")), "a").join(whole.select(F.col("cls").alias("b"), F.col("shingles").alias("s_b")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            n = [len(np.intersect1d(np.frombuffer(i, np.uint64), np.frombuffer(j, np.uint64), assume_unique=True)) for i, j in zip(x, y)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n, pa.int32())], names=["a", "b", "n_a", "n_b", "inter"])

    checked = both.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(verify, "a bigint, b bigint, n_a int, n_b int, inter int")
    links = checked.where(F.col("inter") * q >= (F.col("n_a") + F.col("n_b") - F.col("inter")) * p)
    return members, links


def similar_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs (kind, key_a, key_b), key_a < key_b, of records of different ``doc`` in one class or in linked ones."""
    links = stage(links.select("a", "b"), "links")
    m = members.select("kind", "key", "doc", "cls")
    a = m.select("kind", F.col("key").alias("key_a"), F.col("doc").alias("doc_a"), F.col("cls").alias("a"))
    b = m.select("kind", F.col("key").alias("key_b"), F.col("doc").alias("doc_b"), F.col("cls").alias("b"))
    within = a.join(b.withColumnRenamed("b", "a"), ["kind", "a"]).where("key_a < key_b AND NOT (doc_a <=> doc_b)").select("kind", "key_a", "key_b")
    across = a.join(links, "a").join(b, ["kind", "b"]).where("NOT (doc_a <=> doc_b)").select("kind", F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"))
    return within.unionByName(across).distinct()


def classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, key, class_id, n_links): each record's class of equal sets (null for a null text) and the number of similar other classes."""
    ends = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    return members.join(ends, "cls", "left").select("kind", "key", F.col("cls").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
