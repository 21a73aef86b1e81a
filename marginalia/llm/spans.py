"""Long exact spans shared between records, found by level-wise doubling.

A position of a text is shared if it lies in a window of ``span`` characters that occurs verbatim in
another record. Windows of full length at every position are far too many to exchange, so the search climbs
lengths span/4, span/2, span. At each level every window of ``span`` characters is represented by the least
hash among its grams of the level's length (equal windows choose the same gram, and neighbouring windows
mostly share theirs, so one row stands for dozens of windows). Windows whose gram occurs in one record
alone end there; the others are extended to twice the length. At the last level the few windows that are
left are compared as a whole, group by group of their last gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.sketch import Bits
from marginalia.runtime import spread, stage

SPAN = 200
#: Rows of one gram above which its windows are exchanged one by one instead of within one task.
HOT = 20_000
#: Most bits of the filter of texts to extend; a full one only lets more through.
FILTER_BITS = 1 << 28
#: Characters handled at once; positions within a block fit into POSITION_BITS.
POSITION_BITS = 20
BLOCK = 1 << 18

_BASE = 6364136223846793005
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(2 * n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def gram_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each run of ``length`` code points."""
    n = len(codes)
    if n < length:
        return np.empty(0, np.uint64)
    up, down = _power(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) * up, out=sums[1:])
    h = (sums[length:] - sums[: n - length + 1]) * down[: n - length + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def blocks(texts: list[str | None], span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined to blocks: code points, valid window starts, their text's index and offset in it.

    A text longer than a block is continued in the next; every window of ``span`` lies in exactly one block.
    """
    parts: list[tuple[int, int, str]] = []
    size = 0

    def make():
        codes = np.frombuffer("".join(p[2] for p in parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(p[2]) for p in parts])
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(parts)), lengths)
        at = np.arange(len(codes))
        ok = np.flatnonzero(at + span <= ends[owner])
        own = owner[ok]
        offset = ok - (ends - lengths)[own] + np.array([p[1] for p in parts])[own]
        return codes, ok, np.array([p[0] for p in parts])[own], offset

    for i, t in enumerate(texts):
        if t is None or len(t) < span:
            continue
        for lo in range(0, len(t) - span + 1, BLOCK):
            piece = t[lo : lo + BLOCK + span - 1]
            parts.append((i, lo, piece))
            size += len(piece)
            if size >= BLOCK:
                yield make()
                parts, size = [], 0
    if parts:
        yield make()


def representatives(texts: list[str | None], span: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same least gram: gram hash, text index, first and last window start."""
    found: list[list[np.ndarray]] = [[], [], [], []]
    mask = np.uint64((1 << POSITION_BITS) - 1)
    for codes, ok, text, offset in blocks(texts, span):
        h = gram_hashes(codes, length)
        key = (h & ~mask) | np.arange(len(h)).astype(np.uint64)
        least = (sliding_minimum(key, span - length + 1)[ok] & mask).astype(np.int64)
        new = np.ones(len(ok), bool)
        new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(ok)) - 1
        for k, x in enumerate((h[least[first]].view(np.int64), text[first], offset[first], offset[last])):
            found[k].append(x)
    if not found[0]:
        return tuple(np.empty(0, np.int64) for _ in found)  # type: ignore[return-value]
    return tuple(np.concatenate(x) for x in found)  # type: ignore[return-value]


def _repeated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose gram occurs in two records or more (and few others), and these grams (gram, n) with their numbers of rows."""
    grams = stage(rows.groupBy("gram").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).where("a < b").select("gram", "n"), "repeated")
    bits = rows.sparkSession.sparkContext.broadcast(Bits.of(grams.select("gram"), Bits.size(grams.count(), FILTER_BITS)))  # of bounded size
    at = rows.columns.index("gram")

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(Bits.has(bits.value, batch.column(at).to_numpy())))

    return rows.mapInArrow(some, rows.schema), grams


def shared_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, hot: int = HOT) -> DataFrame:
    """Maximal runs of shared positions: (``id_col``, start_char, end_char), 0-based, end excluded.

    Every window of ``span`` code points counts; texts that are null, empty or shorter than ``span`` have no
    rows; rows with a null id cannot be named and are left out; rows with the same id are one record,
    whose repeated rows share nothing with each other. Columns other than the two are not read.

    Spans within one gram's group are compared in one task up to ``hot`` rows; the windows of a larger
    group are exchanged by their own hash with partial aggregation, so that no group is collected.
    """
    if span < 4:
        raise ValueError("span must be at least 4 characters")
    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text")).where("id IS NOT NULL").where(F.length("text") >= span)
    id_type = docs.schema["id"].dataType.simpleString()
    lengths = [span // 4, span // 2]

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, text, lo, hi = representatives(batch.column(1).to_pylist(), span, lengths[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram, pa.int64()), batch.column(0).take(pa.array(text)), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["gram", "id", "lo", "hi"]
            )

    def next_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, ranges = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            cut, owner, base = [], [], []
            for k, (t, found) in enumerate(zip(texts, ranges)):
                held: list[int] | None = None
                for r in [*sorted((x["lo"], x["hi"]) for x in found), None]:
                    if held and r and r[0] <= held[1] + 1:
                        held[1] = max(held[1], r[1])
                        continue
                    if held:
                        cut.append(t[held[0] : held[1] + span])
                        owner.append(k)
                        base.append(held[0])
                    held = list(r) if r else None
            gram, text, lo, hi = representatives(cut, span, lengths[1])
            pieces = [cut[i][a : b + span] for i, a, b in zip(text.tolist(), lo.tolist(), hi.tolist())]
            start = np.array(base, np.int64)[text] if len(text) else text
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram, pa.int64()), ids.take(pa.array(np.array(owner, np.int64)[text] if len(text) else text)), pa.array(lo + start, pa.int32()), pa.array(pieces, pa.string())],
                names=["gram", "id", "lo", "piece"],
            )

    def whole_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Input: rows sorted by gram, all of a gram in this task."""
        held: pa.Table | None = None

        def compare(t: pa.Table) -> pa.RecordBatch:
            ids = t.column(1).combine_chunks().dictionary_encode()
            code = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            grams, base = t.column(0).to_numpy().view(np.uint64), t.column(2).to_numpy().astype(np.int64)
            keys, row, at = [], [], []
            for codes, ok, text, offset in blocks(t.column(3).to_pylist(), span):
                keys.append(gram_hashes(codes, span)[ok] ^ (grams[text] * np.uint64(0x9E3779B97F4A7C15)))
                row.append(text)
                at.append(offset)
            key, row_, at_ = np.concatenate(keys), np.concatenate(row), np.concatenate(at)
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
            who = code[row_][order]
            several = np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)
            shared = np.zeros(len(key), bool)
            shared[order] = np.repeat(several, np.diff(np.r_[first, len(key)]))
            row_, at_ = row_[shared], at_[shared] + base[row_[shared]]
            new = np.r_[True, (row_[1:] != row_[:-1]) | (at_[1:] > at_[:-1] + span)] if len(row_) else np.empty(0, bool)
            lo = np.flatnonzero(new)
            hi = np.append(lo[1:], len(row_)) - 1
            if not len(lo):
                hi = lo
            return pa.RecordBatch.from_arrays(
                [t.column(1).combine_chunks().take(pa.array(row_[lo])), pa.array(at_[lo], pa.int32()), pa.array(at_[hi] + span, pa.int32())], names=["id", "start_char", "end_char"]
            )

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            grams = held.column(0).to_numpy()
            whole = int(np.searchsorted(grams, grams[-1], side="left")) if len(grams) else 0
            if whole:
                yield compare(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield compare(held)

    def each_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, base = batch.column(0).to_numpy(), batch.column(2).to_numpy().astype(np.int64)
            for codes, ok, text, offset in blocks(batch.column(3).to_pylist(), span):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[text], pa.int64()), batch.column(1).take(pa.array(text)), pa.array(offset + base[text], pa.int32()), pa.array(gram_hashes(codes, span)[ok].view(np.int64))],
                    names=["gram", "id", "lo", "window"],
                )

    grams = stage(spread(docs).mapInArrow(first_level, f"gram bigint, id {id_type}, lo int, hi int"), "grams")
    some, repeated = _repeated(grams)
    ranges = stage(some.join(repeated.select("gram"), "gram", "left_semi").groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), "ranges")
    # Only texts with windows that go on are exchanged.
    named = ranges.select(F.xxhash64("id").alias("hash"))
    bits = df.sparkSession.sparkContext.broadcast(Bits.of(named, Bits.size(named.count(), FILTER_BITS)))  # of bounded size

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(Bits.has(bits.value, batch.column(2).to_numpy()))).select([0, 1])

    longer = docs.select("id", "text", F.xxhash64("id").alias("hash")).mapInArrow(go_on, f"id {id_type}, text string").join(ranges.hint("shuffle_hash"), "id").select("id", "text", "ranges").mapInArrow(next_level, f"gram bigint, id {id_type}, lo int, piece string")
    left, repeated = _repeated(stage(longer, "pieces"))
    # Pieces go by their gram to where they are compared; grams with very many, of which there are few, otherwise.
    crowded = repeated.where(F.col("n") > hot).select("gram")
    cold = left.join(crowded, "gram", "left_anti") if not crowded.isEmpty() else left
    found = cold.select("gram", "id", "lo", "piece").repartition("gram").sortWithinPartitions("gram").mapInArrow(whole_windows, f"id {id_type}, start_char int, end_char int")
    large = left.join(crowded, "gram", "left_semi").select("gram", "id", "lo", "piece").mapInArrow(each_window, f"gram bigint, id {id_type}, lo int, window bigint")
    several = large.groupBy("gram", "window").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("gram", "window")
    found = found.unionByName(large.join(several, ["gram", "window"]).select("id", F.col("lo").alias("start_char"), (F.col("lo") + span).alias("end_char")))
    return merge_spans(found).withColumnRenamed("id", id_col)


def merge_spans(spans: DataFrame) -> DataFrame:
    """Overlapping and touching (id, start_char, end_char) of each id joined to maximal ones."""
    by_id = Window.partitionBy("id").orderBy("start_char", "end_char")
    before = F.max("end_char").over(by_id.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start_char") <= before, 0).otherwise(1)
    island = F.sum("new").over(by_id.rowsBetween(Window.unboundedPreceding, 0))
    rows = spans.distinct().withColumn("new", new).withColumn("island", island)
    return rows.groupBy("id", "island").agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char")).drop("island")


def sharing(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """For every row its length, its shared characters and their share: (id, n_chars, shared_chars, share).

    Null texts have null ``n_chars``, no shared characters and a null share; empty texts a null share.
    """
    spans = shared_spans(df, id_col, text_col, span)
    total = spans.groupBy(id_col).agg(F.sum(F.col("end_char") - F.col("start_char")).alias("shared"))
    rows = df.select(df[id_col], F.length(df[text_col]).cast("long").alias("n_chars"))
    shared = F.coalesce("shared", F.lit(0)).cast("long")
    return rows.join(total, id_col, "left").select(id_col, "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).alias("share"))
