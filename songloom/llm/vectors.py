"""Tables of vectors: the rows that count, batches as matrices, and keys along Hilbert curves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of vectors that are worked on at once.
SLAB = 4096
#: Vectors that a curve's projection is scaled by.
SAMPLE = 1024
#: Bits per coordinate of a key.
BITS = 16


def usable(df: DataFrame, vector: str = "embedding", row_id: str = "vec_id", others: tuple[str, ...] = ()) -> DataFrame:
    """``vec_id``, ``vector`` and the columns ``others`` of the rows that can be compared.

    Rows without an id or a vector, with a null or non-finite component, or with another
    number of components than most rows (of equally many, the smaller number) are left out.
    Of several rows with one id the smallest by ``others``, then vector, counts.
    """
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.filter(F.col(row_id).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad).select(
        F.col(row_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"), *others
    )
    sizes = rows.groupBy(F.size("vector").alias("size")).count()
    common = sizes.orderBy(F.desc("count"), "size").first()
    if common:
        rows = rows.filter(F.size("vector") == common["size"])
    if rows.groupBy("vec_id").count().filter("count > 1").isEmpty():
        return rows
    first = F.row_number().over(W.partitionBy("vec_id").orderBy(*others, "vector"))
    return rows.withColumn("_first", first).filter("_first = 1").drop("_first")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long vectors as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def slabs(batches: Iterator[pa.RecordBatch], rows: int = SLAB) -> Iterator[pa.Table]:
    """Batches joined until there are ``rows`` rows; short last one included."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(len(b) for b in waiting) >= rows:
            yield pa.Table.from_batches(waiting)
            waiting = []
    if sum(len(b) for b in waiting):
        yield pa.Table.from_batches(waiting)


def hilbert(cells: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Positions of grid cells along the Hilbert curve, as keys that sort by their bytes.

    ``cells`` holds a row of coordinates below 2^bits per point. Coordinates are turned level
    by level into those of the curve's own frame (Skilling's transposed form), whose bits,
    interleaved, are the position.
    """
    x = cells.astype(np.uint32).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for i in range(dims):
            upper = (x[i] & bit) != 0
            swap = np.where(upper, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(upper, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], dtype=np.uint32)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] & np.uint32(1 << level)) != 0, np.uint32((1 << level) - 1), np.uint32(0))
    x ^= flip
    levels = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    interleaved = (x.T[:, None, :] >> levels[None, :, None]) & np.uint32(1)  # point, level, coordinate
    packed = np.packbits(interleaved.reshape(x.shape[1], -1).astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


class Curves:
    """Hilbert orderings of projected vectors: each its own projection and shift of the grid.

    Projections are random and orthonormal, scaled by a bounded sample of the vectors; the
    grid is twice as wide as the scaled range, so a shift moves no point out of it.
    """

    def __init__(self, sample: np.ndarray, curves: int, dims: int, seed: int = 12):
        rng = np.random.default_rng(seed)
        size = sample.shape[1]
        self.frames = []
        for _ in range(curves):
            turn = np.linalg.qr(rng.standard_normal((size, size)))[0][:, : min(dims, size)]
            seen = sample @ turn
            spread = seen.std(axis=0)
            spread[~(spread > 0)] = 1.0
            self.frames.append((turn, seen.mean(axis=0), spread, rng.random(turn.shape[1]) / 2))

    def keys(self, vectors: np.ndarray, curve: int) -> list[bytes]:
        turn, centre, spread, shift = self.frames[curve]
        within = np.tanh(((vectors @ turn) - centre) / (2 * spread)) / 4 + 0.25  # 0 to 1/2, steepest in the middle
        return hilbert(np.clip((within + shift) * 2**BITS, 0, 2**BITS - 1))


def fitted(vectors: DataFrame, curves: int, dims: int) -> Curves | None:
    """Curves scaled by the SAMPLE vectors whose ids have the smallest hashes; None without rows."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()
    return Curves(matrix(sample.column("vector")), curves, dims) if len(sample) else None
