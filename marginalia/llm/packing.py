"""Filling containers of fixed capacity by best-fit decreasing.

Sizes are integers up to the capacity, so a corpus of any size has at most ``capacity`` different sizes.
Best-fit decreasing treats items of one size one after the other and alike; it is therefore run on the
histogram of sizes (bounded by the capacity, not by the data), moving whole groups of equal bins at once. The
result, a bounded table of runs (size, ranks, bins), is then looked up by every item's rank among those of
its size. The outcome is that of the item-by-item algorithm over the whole corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marginalia.runtime import stage

CAPACITY = 2048
#: Items of one size that are ranked within one task.
RANKED = 200_000


class OpenBins:
    """Segment tree over remaining capacities: which of them some open bin has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.leaves)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, first: int, count: int) -> None:
        """Bins ``first`` to before ``first + count`` have ``room`` left."""
        if count and room:
            if not self.bins[room]:
                self._mark(room, True)
            self.bins[room].append((first, count))

    def take(self, room: int, most: int) -> tuple[int, int]:
        """Up to ``most`` consecutive bins with ``room`` left, no longer open at that room."""
        first, count = self.bins[room].pop()
        used = min(most, count)
        if used < count:
            self.bins[room].append((first + used, count - used))
        if not self.bins[room]:
            self._mark(room, False)
        return first, used

    def tightest(self, size: int) -> int:
        """The least room of an open bin that holds ``size``; 0 if there is none. Logarithmic in the capacity."""
        node = size + self.leaves
        if self.tree[node]:
            return size
        while node > 1:
            if not node & 1 and self.tree[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return 0

    def _mark(self, room: int, value: bool) -> None:
        node = room + self.leaves
        self.tree[node] = value
        while node > 1:
            node >>= 1
            value = self.tree[2 * node] or self.tree[2 * node + 1]
            if self.tree[node] == value:
                return
            self.tree[node] = value


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Runs (size, first rank, items in a bin, first bin) that place the items of a histogram of sizes.

    The item of rank r of a size, in the run with the greatest first rank not above r, lies in bin
    ``first bin + (r - first rank) // items in a bin``.
    """
    bins, opened, runs = OpenBins(capacity), 0, []
    for size in sorted((s for s, n in histogram.items() if n > 0 and s > 0), reverse=True):
        rank, left = 0, histogram[size]
        while left:
            room = bins.tightest(size)
            fresh = not room
            room = room or capacity
            each = room // size
            # An item leaves its bin the tightest one that still holds the size: bins fill up one by one.
            whole, part = divmod(left, each)
            if fresh:
                first, used = opened, whole + bool(part)
                opened += used
            else:
                first, used = bins.take(room, whole + bool(part))
            placed = min(left, used * each)
            full = placed // each
            bins.add(room - each * size, first, full)
            bins.add(room - (placed - full * each) * size, first + full, used - full)
            runs.append((size, rank, each, first))
            rank += placed
            left -= placed
    return runs


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY, ranked: int = RANKED) -> DataFrame:
    """Assign every row of ``items`` to containers: (id, piece_no, first_unit, size, container_id).

    An item above ``capacity`` is split into pieces of ``capacity`` and a rest, the pieces in order
    (``first_unit`` counts from 0); no other item is split. An item of size 0 or null takes no room: it has
    one piece of size 0 and a null container. Rows with equal ids are items of their own. Ties of size are
    ranked by id, then piece. Container ids run from 0 without gaps.

    The driver holds one count for each different size (at most ``capacity``) and the runs made from them.
    Ranks within a size are counted in buckets of about ``ranked`` items, so a size held by a third of all
    rows is spread over many tasks.
    """
    size = F.coalesce(F.col(size_col).cast("long"), F.lit(0))
    last = F.greatest(F.lit(0), F.floor((size - 1) / capacity)).cast("int")
    pieces = (
        items.select(F.col(id_col).alias("id"), size.alias("whole"), F.explode(F.sequence(F.lit(0), last)).alias("piece_no"))
        .withColumn("first_unit", (F.col("piece_no").cast("long") * capacity))
        .withColumn("size", F.least(F.lit(capacity), F.col("whole") - F.col("first_unit")).cast("int"))
        .drop("whole")
    )
    pieces = stage(pieces, "pieces")  # read three times: counts by size, counts by bucket, ranks
    histogram = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most capacity + 1 rows
    histogram.pop(0, None)
    buckets = max(1, max(histogram.values(), default=0) // ranked + 1)
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece_no"), F.lit(buckets)).cast("int"))
    # Rank = items of the size in earlier buckets + place in the own bucket.
    counts = bucketed.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("size", "bucket", F.coalesce(earlier, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("id", "piece_no"))
    ranks = bucketed.withColumn("place", place).join(offsets, ["size", "bucket"]).withColumn("rank", F.col("before") + F.col("place") - 1)
    by_size: dict[int, list] = {}
    for s, first_rank, each, first_bin in best_fit_decreasing(histogram, capacity):
        by_size.setdefault(s, []).append((first_rank, each, first_bin))
    schema = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("runs", T.ArrayType(T.StructType([
        T.StructField("first_rank", T.LongType()), T.StructField("each", T.IntegerType()), T.StructField("first_bin", T.LongType())])))])
    plan = items.sparkSession.createDataFrame(sorted(by_size.items()), schema)
    run = F.element_at(F.filter("runs", lambda r: r["first_rank"] <= F.col("rank")), -1)
    # One row a size, at most ``capacity`` rows: a broadcast of bounded size.
    placed = ranks.join(F.broadcast(plan), "size", "left").withColumn("run", F.when(F.col("runs").isNotNull(), run))
    container = (F.col("run.first_bin") + F.floor((F.col("rank") - F.col("run.first_rank")) / F.col("run.each"))).cast("long")
    return placed.select(F.col("id").alias(id_col), "piece_no", "first_unit", "size", container.alias("container_id"))
