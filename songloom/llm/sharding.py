"""Contiguous shards whose largest is as small as atomic groups allow.

Groups of equal texts stay together and keep an order (their smallest ``doc_id``). The
smallest feasible capacity is found by binary search; each candidate is checked by greedy
filling over the ordered group sizes, and the greedy cuts at the answer are the shards.

The group sizes stay in Spark. The driver holds at most ``blocks`` block sums at first and
asks for finer sums only of the blocks in which a cut may fall, so what it gathers is
bounded by parameters whatever the number of groups. A capacity is decided from block sums
alone where the bounds of the greedy walk agree.

Null texts count as empty ones; null ids come first; repeated rows are members of their
group; an empty table gives no rows; columns of the input other than the two named are not
read, so their names cannot clash.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.llm.tables import saved, with_positions

BLOCKS = 8192
PIECES = 512


@dataclass(frozen=True)
class Block:
    """Consecutive groups: first position, position after the last, number, bytes, largest."""

    start: int
    stop: int
    groups: int
    size: int
    largest: int


class GroupSizes:
    """Ordered group sizes, seen through blocks that are refined on demand."""

    def __init__(self, groups: DataFrame, rows: int, blocks: int = BLOCKS, pieces: int = PIECES):
        self._groups, self._pieces = groups, pieces
        self.blocks = self._sums([Block(0, max(rows, 1), 0, 0, 0)], blocks)
        self._index()

    def _sums(self, parents: list[Block], pieces: int) -> list[Block]:
        """Sums of up to ``pieces`` equal stretches of each parent: one job for all of them."""
        pos, stretch, wanted = F.col("pos"), F.lit(None).cast("long"), F.lit(False)
        for p in parents:
            width = -(-(p.stop - p.start) // pieces)
            inside = (pos >= p.start) & (pos < p.stop)
            stretch = F.when(inside, F.floor((pos - p.start) / width) * width + p.start).otherwise(stretch)
            wanted = wanted | inside
        found = (
            self._groups.filter(wanted)
            .groupBy(stretch.alias("stretch"))
            .agg(F.min("pos"), F.max("pos"), F.count("*"), F.sum("bytes"), F.max("bytes"))
        )
        return sorted((Block(a, b + 1, n, s, m) for _, a, b, n, s, m in found.collect()), key=lambda x: x.start)

    def _index(self) -> None:
        self.ends, total = [0], 0
        for b in self.blocks:
            total += b.size
            self.ends.append(total)
        self.total, self.largest = total, max((b.largest for b in self.blocks), default=0)

    def refine(self, at: set[int]) -> None:
        finer = self._sums([self.blocks[i] for i in sorted(at)], self._pieces)
        self.blocks = sorted([b for i, b in enumerate(self.blocks) if i not in at] + finer, key=lambda x: x.start)
        self._index()

    def reach(self, size: int) -> tuple[int, int, int | None]:
        """Bounds of the last group end not above ``size``; the block that leaves it open."""
        if size >= self.total:
            return self.total, self.total, None
        i = bisect_right(self.ends, size) - 1
        if self.ends[i] == size or self.blocks[i].groups == 1:
            return self.ends[i], self.ends[i], None
        return self.ends[i], size, i


def _walk(sizes: GroupSizes, shards: int, capacity: int) -> tuple[list[tuple[int, int]], set[int]]:
    """Bounds of the greedy cuts, and the blocks that keep them apart."""
    low = high = 0
    cuts, unclear = [], set()
    for _ in range(shards):
        (low, _, a), (_, high, b) = sizes.reach(low + capacity), sizes.reach(high + capacity)
        unclear |= {x for x in (a, b) if x is not None}
        cuts.append((low, high))
    return cuts, unclear


def minimax_cuts(sizes: GroupSizes, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and the position at which each later shard starts."""
    floor = max(sizes.largest, -(-sizes.total // shards))
    low, high = floor, floor + sizes.largest  # the upper end always suffices
    while low < high:
        middle = (low + high) // 2
        cuts, unclear = _walk(sizes, shards, middle)
        if cuts[-1][0] >= sizes.total:
            high = middle
        elif cuts[-1][1] < sizes.total:
            low = middle + 1
        else:
            sizes.refine(unclear)
    while True:
        cuts, unclear = _walk(sizes, shards, low)
        if not unclear:
            break
        sizes.refine(unclear)
    start_at = dict(zip(sizes.ends, (b.start for b in sizes.blocks)))
    after = sizes.blocks[-1].stop if sizes.blocks else 0
    return low, [start_at.get(cut, None if cut < sizes.total else after) for cut, _ in cuts[:-1]]


def shard_documents(docs: DataFrame, shards: int = 8, blocks: int = BLOCKS, pieces: int = PIECES) -> DataFrame:
    """Each document's shard and gapless slot: doc_id, size, text_crc32, shard, slot."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        F.md5(text).alias("key"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    # Only texts that repeat are joined; written first, so that the join splits a hot one.
    repeated = saved(
        rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n"),
        "shard-repeated",
    )
    rows = rows.join(repeated, "key", "left").withColumn("first", F.coalesce("least", "doc_id")).drop("least")
    order = [F.col("first").asc_nulls_first(), F.col("key"), F.col("doc_id").asc_nulls_first()]
    placed = with_positions(rows, order, "shard-rows")
    groups = placed.groupBy("key").agg(F.min("pos").alias("pos"), F.sum("size").alias("bytes"))
    _, starts = minimax_cuts(GroupSizes(groups, placed.count(), blocks, pieces), shards)
    shard, start = F.lit(0), F.lit(0)
    for number, at in enumerate(starts, 1):
        # where several shards start at one position, those before the last are empty
        shard = F.when(F.col("pos") >= at, number).otherwise(shard)
        start = F.when(F.col("pos") >= at, at).otherwise(start)
    return placed.select(
        "doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), (F.col("pos") - start).cast("long").alias("slot")
    )
