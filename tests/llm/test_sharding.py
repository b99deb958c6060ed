import random
import zlib
from collections import Counter, defaultdict

import pytest
from cases import DOCS, no_docs, odd_docs

from songloom.llm.sharding import GroupSizes, minimax_cuts, shard_documents


def best_capacity(sizes, shards):
    """The smallest capacity by trying all of them."""
    for capacity in range(max(sizes), sum(sizes) + 1):
        used, room = 1, capacity
        for s in sizes:
            if s > room:
                used, room = used + 1, capacity
            room -= s
        if used <= shards:
            return capacity


@pytest.mark.parametrize("blocks,pieces", [(3, 2), (5, 3), (1000, 10)])
def test_capacity_is_the_smallest_even_through_coarse_blocks(spark, blocks, pieces):
    rnd = random.Random(blocks)
    sizes = [rnd.choice([1, 3, 9, 40]) for _ in range(60)]
    # positions leave gaps, as groups of several rows do
    at, rows = 0, []
    for s in sizes:
        rows.append((at, s))
        at += rnd.randint(1, 3)
    groups = spark.createDataFrame(rows, "pos long, bytes long").repartition(3)
    capacity, starts = minimax_cuts(GroupSizes(groups, at, blocks, pieces), 5)
    assert capacity == best_capacity(sizes, 5)
    positions = [p for p, _ in rows]
    assert all(s in positions or s >= at - 3 for s in starts)
    bounds = [0, *starts, at + 9]
    loads = [sum(s for p, s in rows if a <= p < b) for a, b in zip(bounds, bounds[1:])]
    assert max(loads) == capacity and sum(loads) == sum(sizes)


def brute(rows, shards):
    first, size = {}, defaultdict(int)
    key = lambda t: t or ""
    for i, t in rows:
        first[key(t)] = min(first.get(key(t), i), i)
        size[key(t)] += len(key(t).encode()) + 1
    order = sorted(first, key=lambda t: first[t])
    capacity, shard, room, of = best_capacity([size[t] for t in order], shards), 0, None, {}
    room = capacity
    for t in order:
        if size[t] > room:
            shard, room = shard + 1, capacity
        room -= size[t]
        of[t] = shard
    out, slots = {}, Counter()
    for i, t in sorted(rows, key=lambda r: (first[key(r[1])], r[0])):
        out[i] = (len(key(t).encode()) + 1, zlib.crc32(key(t).encode()), of[key(t)], slots[of[key(t)]])
        slots[of[key(t)]] += 1
    return out


def test_documents_against_brute_force(spark):
    rnd = random.Random(4)
    texts = ["é" * rnd.randint(0, 30) for _ in range(25)] + ["hot"]
    rows = [(i, rnd.choice(texts) if rnd.random() < 0.6 else "hot") for i in range(0, 300, 2)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    got = {r["doc_id"]: (r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in shard_documents(df, 4, blocks=4, pieces=2).collect()}
    assert got == brute(rows, 4)


def test_odd_rows_and_empty_table(spark):
    rows = shard_documents(odd_docs(spark), 8).collect()
    assert len(rows) == 13
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert len({r["shard"] for r in rows if r["text_crc32"] == 0}) == 1  # null and empty texts are equal
    assert shard_documents(no_docs(spark), 8).collect() == []
