"""Arrays of fixed size that are summed (or joined bit by bit) over all tasks.

Their size is a parameter and doesn't grow with the data, so what the driver receives and broadcasts is bounded.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A task's array travels in so many slices, so that summing is spread over as many tasks.
SLICES = 16


def saturating_sum(a: np.ndarray, b: np.ndarray, out: np.ndarray) -> np.ndarray:
    """``a + b`` in ``out``, unsigned entries staying at their greatest value."""
    most = np.iinfo(a.dtype).max
    np.add(np.minimum(a, most - b), b, out=out)
    return out


def slices(own: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The parts of a task's array that hold anything, compressed, with their numbers."""
    width = -(-len(own) // SLICES)
    for k in range(SLICES):
        part = own[k * width : (k + 1) * width]
        if part.any():
            yield k, zlib.compress(part.tobytes(), 1)


def merged(parts: DataFrame, size: int, dtype: str, merge: Callable[..., np.ndarray] = np.add) -> np.ndarray:
    """One array of ``size`` entries from the ``slices`` (slice, n) of all tasks; each slice is merged in one task."""
    width = -(-size // SLICES)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, n in zip(*(c.to_pylist() for c in batch.columns)):
                own = sums.setdefault(k, np.zeros(width, dtype))
                x = np.frombuffer(zlib.decompress(n), dtype)
                merge(own[: len(x)], x, out=own[: len(x)])
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "n"])

    out = np.zeros(width * SLICES, dtype)
    for r in parts.select("slice", "n").repartition(SLICES, "slice").mapInArrow(total, "slice int, n binary").collect():  # SLICES rows
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["n"], dtype)
    return out[:size]


def gather(df: DataFrame, add: Callable[[np.ndarray, pa.RecordBatch], None], size: int, dtype: str, merge: Callable[..., np.ndarray] = np.add) -> np.ndarray:
    """The arrays that ``add`` fills from the batches of each task, merged: one array of ``size`` entries.

    ``merge`` must not depend on order (``saturating_sum`` stays at the greatest value). Each task sends its array
    once, in compressed slices; the driver gets ``size`` entries altogether.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, dtype)
        for batch in batches:
            add(own, batch)
        for k, part in slices(own):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.binary())], names=["slice", "n"])

    return merged(df.mapInArrow(fill, "slice int, n binary"), size, dtype, merge)


class Bits:
    """A set of 64-bit hashes as single bits: what was put in is found again, little else is."""

    @staticmethod
    def size(wanted: int, most: int) -> int:
        """Bits for so many hashes: 16 for each, in a power of two from 2**16 to ``most``, the bound of what is broadcast."""
        return min(most, 1 << max(16, (16 * wanted).bit_length()))

    @staticmethod
    def of(hashes: DataFrame, bits: int) -> np.ndarray:
        """The bits of the only (bigint) column of ``hashes``."""

        def put(own: np.ndarray, batch: pa.RecordBatch) -> None:
            at = batch.column(0).to_numpy().view(np.uint64) % np.uint64(bits)
            np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), (np.uint64(1) << (at & np.uint64(7))).astype(np.uint8))

        return gather(hashes, put, bits // 8, "uint8", np.bitwise_or)

    @staticmethod
    def has(own: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Which of ``hashes`` (64-bit integers) may have been put in."""
        at = hashes.view(np.uint64) % np.uint64(8 * len(own))
        return (own[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
