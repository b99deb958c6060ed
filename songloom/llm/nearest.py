"""Approximate nearest neighbours along shifted Hilbert curves.

1. Equal vectors become one point, which keeps the smallest ids it may have to report.
2. Each point gets a key on each of several curves: the vectors are projected at random, the
   grid is shifted, and the cell's place on the Hilbert curve is the key. Spark range-partitions
   and sorts (curve, key) and numbers the points of each curve.
3. The reach of the windows is fitted: for a bounded sample of queries the true neighbours
   are found by a pass over all points, and the reach is the smallest at which the nearer
   of the curves brings them in as often as ``recall`` asks. Nothing else is sampled; every
   row is indexed.
4. Each curve is cut into windows. A query is compared with the windows within reach of its own
   on each curve, and the results of all windows and curves merge into its nearest, ranked by
   exact distances on the original vectors.

What is found is exact in score and order, and complete but for neighbours beyond the reach on
every curve. A table whose points fit two windows is searched whole.

Euclidean distance in double precision, components added in their order; of equally near rows
the smaller id comes first. Vectors that are null or zero, or hold null or non-finite
components, take no part, nor do rows without an id or with another number of components than
most. Rows that repeat an id count once (the smallest vector). A query with fewer candidates
gets them all; an empty table gives no rows. Only the id and the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from songloom.llm.tables import saved, with_positions
from songloom.llm.vectors import Curves, fitted, matrix, slabs, usable

CURVES, DIMS = 8, 16
#: Queries that the reach is fitted on, and the recall it is fitted to.
FITTED_ON, RECALL = 256, 0.95
#: Fewest rows of a window; most bytes of its vectors; queries that meet a window in one group.
WINDOW, WINDOW_BYTES, PROBES = 256, 1 << 24, 2048


def distances(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances, components added one after the other."""
    return np.sqrt(np.cumsum((points - query) ** 2, axis=1)[:, -1])


def closest(queries: np.ndarray, points: np.ndarray, ids: list[list[int]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per query the (ids, distances) of the k nearest rows, nearest first, ties to smaller ids.

    A product of matrices says which points may be among them; these are measured exactly.
    """
    squares = (points**2).sum(axis=1)
    step = max(1, (1 << 22) // max(1, len(points)))
    for at in range(0, len(queries), step):
        part = queries[at : at + step]
        own = (part**2).sum(axis=1)
        with np.errstate(over="ignore", invalid="ignore"):
            rough = own[:, None] + squares[None, :] - 2 * (part @ points.T)
        if np.isfinite(rough).all():
            limit = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(points) > k else np.full(len(part), np.inf)
            limit = limit + 1e-9 * (own + squares.max())
        else:  # squares beyond the range of doubles
            rough, limit = np.zeros(rough.shape), np.zeros(len(part))
        for query, row, most in zip(part, rough, limit):
            near = np.flatnonzero(row <= most)
            with np.errstate(over="ignore"):
                measured = distances(points[near], query)
            listed = np.array([i for n in near for i in ids[n]], dtype=np.int64)
            measured = np.repeat(measured, [len(ids[n]) for n in near])
            order = np.lexsort((listed, measured))[:k]
            yield listed[order], measured[order]


def _points(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """One row per distinct vector: ``vec_id`` (the smallest), its k + 1 smallest ids, ``asked``.

    Row numbers up to a limit are cut before the shuffle, so a vector that very many rows share
    sends a few rows per task.
    """
    marked = rows.withColumn("asked", is_query)
    place = F.row_number().over(W.partitionBy("vector", "asked").orderBy("vec_id"))
    few = marked.withColumn("place", place).filter(F.col("place") <= k + 1)
    points = few.groupBy("vector").agg(
        F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"), F.max("asked").alias("asked")
    )
    return saved(points.select(F.col("ids")[0].alias("vec_id"), "ids", "asked", "vector"), "points")


def ordered(points: DataFrame, curves: Curves) -> DataFrame:
    """``curve, vec_id, asked, pos``: every point's place on every curve, places from 0."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches):
            vectors = matrix(slab.column("vector"))
            for c in range(len(curves.frames)):
                columns = [pa.array([c] * len(slab), pa.int32()), pa.array(curves.keys(vectors, c), pa.binary())]
                columns += [slab.column(n).combine_chunks() for n in ("vec_id", "asked")]
                yield pa.RecordBatch.from_arrays(columns, names=["curve", "key", "vec_id", "asked"])

    schema = "curve int, key binary, vec_id long, asked boolean"
    keys = points.select("vec_id", "asked", "vector").mapInArrow(keyed, schema)
    total = points.count()
    placed = with_positions(keys, [F.col("curve"), F.col("key"), F.col("vec_id")], "curve-order").drop("key")
    return placed.withColumn("pos", F.col("pos") - F.col("curve") * F.lit(total))


def nearest_of_few(points: DataFrame, few: pd.DataFrame, k: int) -> DataFrame:
    """``query, vec_id``: the k nearest other points of a bounded set of points, by a whole pass."""
    wanted = np.stack(few["vector"].to_numpy()).astype(np.float64)
    names = few["vec_id"].to_numpy()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_ids = [np.empty(0, np.int64) for _ in names]
        best = [np.empty(0) for _ in names]
        for slab in slabs(batches):
            own = [[i] for i in slab.column("vec_id").to_pylist()]
            for n, (ids, far) in enumerate(closest(wanted, matrix(slab.column("vector")), own, k + 1)):
                ids, far = np.concatenate((best_ids[n], ids)), np.concatenate((best[n], far))
                order = np.lexsort((ids, far))[: k + 1]
                best_ids[n], best[n] = ids[order], far[order]
        columns = [np.repeat(names, [len(x) for x in best]), np.concatenate(best_ids), np.concatenate(best)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "vec_id", "score"])

    found = points.select("vec_id", "vector").mapInArrow(search, "query long, vec_id long, score double")
    place = F.row_number().over(W.partitionBy("query").orderBy("score", "vec_id"))
    return found.filter("query != vec_id").withColumn("place", place).filter(F.col("place") <= k).select("query", "vec_id")


def fit_reach(points: DataFrame, places: DataFrame, k: int, recall: float = RECALL, queries: int = FITTED_ON) -> int:
    """Places to look left and right of a query, so that a share ``recall`` of neighbours is met."""
    few = points.filter("asked").orderBy(F.xxhash64("vec_id"), "vec_id").limit(queries).select("vec_id", "vector").toPandas()
    if few.empty:
        return 1
    pairs = saved(nearest_of_few(points, few, k), "true-neighbours")  # at most queries * k rows
    needed = pairs.select("vec_id").union(pairs.select("query")).distinct()
    found = places.join(F.broadcast(needed), "vec_id").select("curve", "vec_id", "pos").toPandas()
    pairs = pairs.toPandas()
    if pairs.empty:
        return 1
    at = found.pivot(index="vec_id", columns="curve", values="pos")
    apart = np.abs(at.loc[pairs["query"]].to_numpy() - at.loc[pairs["vec_id"]].to_numpy()).min(axis=1)
    return max(1, int(np.quantile(apart, recall, method="higher")))


def search(
    vectors: DataFrame, is_query: Column, k: int = 10, curves: int = CURVES, dims: int = DIMS, recall: float = RECALL,
    vector: str = "embedding", row_id: str = "vec_id",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows found of each row that ``is_query``.

    ``is_query`` is an expression over the column ``vec_id``.
    """
    rows = usable(vectors, vector, row_id).filter(F.exists("vector", lambda x: x != 0))
    points = _points(rows, is_query, k)
    form = fitted(points, curves, dims)
    if form is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    total = points.count()
    places = saved(ordered(points, form), "curve-places")
    reach = fit_reach(points, places, k, recall)
    most = max(WINDOW, WINDOW_BYTES // (8 * form.frames[0][0].shape[0]))
    width = min(max(reach, WINDOW), most)
    around, last = ceil(reach / width), (total - 1) // width
    asked = points.filter("asked").count()
    parts = ceil((2 * around + 1) * width * asked / total / PROBES) or 1  # queries of a window, dealt by hash
    block = F.floor(F.col("pos") / width)
    part = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    met = F.sequence(F.greatest(block - around, F.lit(0)), F.least(block + around, F.lit(last)))
    whole = places.join(points.drop("asked"), "vec_id")
    windows = whole.withColumn("block", block).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    probes = whole.filter("asked").withColumn("block", F.explode(met)).withColumn("part", part)
    keys = ["curve", "block", "part"]

    def compare(window: pa.Table, queries: pa.Table) -> pa.Table:
        ids, scores = [], []
        if len(window) and len(queries):
            own = window.column("ids").to_pylist()
            for found, far in closest(matrix(queries.column("vector")), matrix(window.column("vector")), own, k + 1):
                ids.append(found)
                scores.append(far)
        point = queries.column("vec_id").combine_chunks() if ids else pa.array([], pa.int64())
        columns = [point, pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))]
        return pa.Table.from_arrays(columns, names=["point", "ids", "scores"])

    own_columns = probes.select(*(F.col(c).alias(c) for c in (*keys, "vec_id", "vector")))  # both sides are the same table
    near = (
        windows.select(*keys, "ids", "vector").groupBy(*keys)
        .cogroup(own_columns.groupBy(*keys))
        .applyInArrow(compare, "point long, ids array<long>, scores array<double>")
    )
    pairs = near.select("point", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select(
        "point", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score")
    )
    place = F.row_number().over(W.partitionBy("point").orderBy("score", "vec_id"))
    # a row is met once on each curve at most; so many repeats are kept, and all in one shuffle
    few = pairs.withColumn("place", place).filter(F.col("place") <= (k + 1) * curves)
    once = few.dropDuplicates(["point", "vec_id"])
    best = once.withColumn("place", place).filter(F.col("place") <= k + 1).drop("place")
    of = points.filter("asked").select(F.col("vec_id").alias("point"), "vector")
    queries = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "vector").join(of, "vector").drop("vector")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    others = queries.join(best, "point").filter("query_id != vec_id")
    return others.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
