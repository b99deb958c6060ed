import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from songloom.llm import hard_negatives as h

VECTORS = "vec_id long, embedding array<float>, label int"


def mined(df, **more):
    return sorted(map(tuple, h.mine(df, F.col("vec_id") % 100 == 0, F.col("label"), **more).collect()))


def brute(rows):
    """All pairs, whole numbers of any length, scores held to the range of a long."""
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        key = (label, [np.float32(x) for x in v])
        kept[i] = min(kept.get(i, key), key)
    common = max({len(v) for _, v in kept.values()}, key=lambda n: (sum(len(v) == n for _, v in kept.values()), -n), default=0)
    usable = {i: (label, [math.floor(256 * float(x)) for x in v]) for i, (label, v) in kept.items() if len(v) == common}
    out = []
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    for a, (label, v) in usable.items():
        if a % 100:
            continue
        scored = sorted((-clip(sum(x * y for x, y in zip(v, w))), i, other == label) for i, (other, w) in usable.items() if i != a)
        for minus, i, _ in [x for x in scored if x[2]][:5]:
            hard = [(s, j) for s, j, same in scored if not same and -80 * minus <= -100 * s <= -100 * minus][:5]
            out += [(a, i, rank + 1, j, -minus, -s) for rank, (s, j) in enumerate(hard)]
    return sorted(out)


def made(spark, n, seed, labels=4, near=False):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, 12))
    x = centres[r.integers(0, 6, n)] + r.normal(size=(n, 12)) * (0.05 if near else 1)
    rows = [(int(i) * 5, [float(np.float32(c)) for c in v], int(lab)) for i, v, lab in zip(range(n), x, r.integers(0, labels, n))]
    return spark.createDataFrame(rows, VECTORS), rows


@pytest.mark.parametrize("near", [False, True])
def test_equals_all_pairs(spark, monkeypatch, near):
    monkeypatch.setattr(h, "SLICE", 300)  # several slices
    df, rows = made(spark, 1500, 5, near=near)
    got = mined(df)
    assert got == brute(rows) and len(got) > 100


def test_bounds_save_products(spark):
    """With near anchors and a narrow window most rows are never scored at a child."""
    r = np.random.default_rng(2)
    anchors = np.floor(256 * (np.ones(16) + r.normal(size=(200, 16)) * 0.01))
    rows = np.floor(256 * r.normal(size=(5000, 16)))
    order, parent, edge = h.spanning_tree(anchors)
    tree = {"vec_id": order, "parent": parent, "edge": edge, "vector": anchors[order]}
    low = 256 * 256 * 12
    scored, found = 0, {}
    for place, at, exact in h._walk(tree, h.Products(rows), lambda p, lo, hi: hi >= low):
        scored += len(at)
        found[place] = set(at[exact >= low].tolist())
    for place in range(200):
        assert found[place] == set(np.flatnonzero(rows @ tree["vector"][place] >= low).tolist())
    assert scored < 0.1 * 200 * 5000


def test_spanning_tree_is_minimal():
    x = np.array([[0.0, 0], [10, 0], [1, 0], [11, 0], [5, 0]])
    order, parent, edge = h.spanning_tree(x)
    assert sorted(order.tolist()) == [0, 1, 2, 3, 4] and sum(edge) == pytest.approx(11)
    for place in range(1, 5):
        assert parent[place] < place
        assert edge[place] == pytest.approx(np.abs(x[order[place]] - x[order[parent[place]]]).sum())


def test_ties_copies_and_repeated_rows(spark):
    r = random.Random(1)
    pool = [[float(r.randrange(-2, 3)) for _ in range(4)] for _ in range(6)]
    rows = [(r.randrange(0, 40) * 25, r.choice(pool), r.randrange(2)) for _ in range(120)]
    assert mined(spark.createDataFrame(rows, VECTORS)) == brute(rows) != []


def test_nulls_huge_numbers_and_other_lengths(spark):
    rows = [
        (0, [1.0, 2.0, 3.0], 1), (1, [1.0, 2.0, 2.5], 1), (2, [1.0, 2.0, 2.4], 2), (3, None, 1), (4, [1.0, None, 2.0], 1),
        (5, [1.0, float("nan"), 2.0], 2), (6, [float("inf"), 1.0, 1.0], 2), (7, [9.0, 9.0], 2), (None, [1.0, 2.0, 2.4], 2),
        (8, [1.0, 2.0, 2.4], None), (100, [1e30, 1e30, 2.0], 1), (9, [1e30, 1e30, 2.5], 1), (10, [9e29, 9e29, 2.5], 2),
        (200, [0.0, 0.0, 0.0], 3), (11, [1.0, 1.0, 1.0], 3), (300, [-1.0, 0.0, 0.0], 5), (12, [1.0, 0.0, 0.0], 5), (400, [1.0, 1.0, 1.0], 9),
    ]
    df = spark.createDataFrame(rows, VECTORS).withColumns({n: F.lit("x") for n in ("slice", "place", "vector", "tree", "_label", "key")})
    got = mined(df)
    assert got == brute(rows) and {x[0] for x in got} >= {0, 100, 200}
    assert mined(df.limit(0)) == []
    assert mined(spark.createDataFrame([(5, [1.0], 1)], VECTORS)) == []  # no anchor
