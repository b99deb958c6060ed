import numpy as np
import pytest
from pyspark.sql import functions as F

from songloom.llm import nearest as n
from songloom.llm import queries as q
from songloom.llm import vectors as v

VECTORS = "vec_id long, embedding array<float>, label int"


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in row], 0) for i, row in zip(ids, x)], VECTORS)


def brute(ids, x, k=10, every=100):
    ids, x = np.asarray(ids), np.asarray(x, dtype=np.float32).astype(np.float64)
    out = []
    for i in np.flatnonzero(ids % every == 0):
        far = np.sqrt(np.cumsum((x - x[i]) ** 2, axis=1)[:, -1])
        order = [j for j in np.lexsort((ids, far)) if j != i][:k]
        out += [(int(ids[i]), rank + 1, int(ids[j]), float(far[j])) for rank, j in enumerate(order)]
    return sorted(out)


def found(df, **more):
    return sorted(map(tuple, n.search(df, F.col("vec_id") % 100 == 0, **more).collect()))


def recall(got, want):
    return len({x[::2] for x in got} & {x[::2] for x in want}) / len(want)


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = 2**bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims), axis=-1).reshape(-1, dims)
        keys = v.hilbert(cells, bits)
        walk = cells[sorted(range(len(keys)), key=keys.__getitem__)]
        assert len(set(keys)) == len(cells)
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_small_tables_are_searched_whole(spark):
    x = np.random.default_rng(1).normal(size=(500, 8))
    assert found(frame(spark, range(500), x)) == brute(range(500), x)


@pytest.mark.parametrize("clusters", [0, 40])
def test_recall_against_brute_force(spark, clusters):
    r = np.random.default_rng(7)
    x = r.normal(size=(6000, 24))
    if clusters:
        x = r.normal(size=(clusters, 24))[r.integers(0, clusters, 6000)] * 5 + x * 0.3
    ids = np.arange(6000) * 20  # a fifth are queries
    df = frame(spark, ids, x)
    got, want = found(df), brute(ids, x)
    exact = {(a, b): s for a, _, b, s in want}
    assert len(got) == len(want) and all(exact.get((a, b), s) == s for a, _, b, s in got)
    assert recall(got, want) >= 0.9
    rows = v.usable(df)
    points = n._points(rows, F.col("vec_id") % 100 == 0, 10)
    reach = n.fit_reach(points, n.ordered(points, v.fitted(points, n.CURVES, n.DIMS)), 10)
    assert (reach < 6000 / 8) if clusters else reach < 6000 / 2  # clusters need short windows only


def test_query_on_the_table(spark, data_dir):
    table = spark.read.parquet(f"{data_dir}/embeddings.parquet").toPandas()
    got = sorted(map(tuple, q.QUERIES["op12_nearest"](spark, data_dir).collect()))
    want = brute(table["vec_id"], np.stack(table["embedding"]))
    assert recall(got, want) >= 0.9 and len(got) == len(want)


def test_copies_ties_and_repeated_rows(spark):
    r = np.random.default_rng(3)
    x = np.concatenate((np.ones((900, 4)), r.integers(-2, 3, (300, 4))))
    x = x[r.permutation(len(x))]
    keep = np.abs(x).sum(axis=1) > 0
    ids, x = np.arange(len(x))[keep], x[keep]
    df = frame(spark, ids, x)
    assert found(df.union(df.filter("vec_id < 50"))) == brute(ids, x)


def test_windows_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(n, "PROBES", 7)
    monkeypatch.setattr(n, "WINDOW_BYTES", 1 << 12)
    monkeypatch.setattr(n, "WINDOW", 16)
    x = np.random.default_rng(4).normal(size=(900, 6))
    ids = np.arange(900) * 20
    assert recall(found(frame(spark, ids, x)), brute(ids, x)) >= 0.9


def test_odd_rows_and_empty_tables(spark):
    rows = [
        (0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1), (2, None, 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1),
        (5, [float("inf"), 1.0], 1), (6, [0.0, 0.0], 1), (7, [1.0, 2.0, 3.0], 1), (None, [1.0, 0.0], 1), (100, [3e38, -3e38], 1),
    ]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ("vector", "ids", "pos", "curve", "block", "asked", "key")})
    far = float(np.sqrt(np.cumsum(np.square(np.float64(np.float32([3e38, -3e38])) - [1, 0.5]))[-1]))
    got = found(df)
    assert [x[:3] for x in got] == [(0, 1, 1), (0, 2, 100), (100, 1, 0), (100, 2, 1)]
    assert got[0][3] == 0.5 and got[2][3] == far
    assert found(df.limit(0)) == []
    assert found(spark.createDataFrame([(0, [1.0], 1)], VECTORS)) == []
    assert found(spark.createDataFrame([(1, [1.0], 1), (2, [2.0], 1)], VECTORS)) == []  # no query
