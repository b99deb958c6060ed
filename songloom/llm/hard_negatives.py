"""Hard negatives: rows of other labels that score nearly as high as an anchor's positives.

Scores are inner products of integer vectors. Anchors are joined into spanning trees, and the
tree saves products:

1. Anchors are put in the order of a Hilbert curve per label and cut into trees of at most 512
   near ones; in each, Prim's algorithm finds the minimum spanning tree.
2. Rows are dealt into slices, anchors into bundles of trees; every slice meets every bundle in a
   group of its own, and a group takes its rows in slabs.
3. A tree's root is scored against all rows. At a child the score of a row differs from the one
   at its parent by at most the edge's length times the row's norm. If this interval misses
   what the anchor is looking for, the row is not scored there, and the interval, wider by each
   edge, goes on to the child's children; else it is scored and the interval is a point again.

Two passes: the first looks for an anchor's best rows of its own label (what it looks for: scores
of at least the fifth best so far), the second for rows of other labels within the window of
each positive (0.8 of its score up to its score). Scores of all results are exact.

Products are exact whole numbers of any length; a score that leaves the range of a long is the end
of it that it passes, in comparisons too. Equal scores go by the smaller id. Rows take no part if their id, label or vector
is null, if a component is null or not finite, or if they have another number of components than
most rows. Rows that repeat an id count once (smallest label, then vector). An anchor without
another row of its label has no positives, and a positive without a row in its window gives
no rows; an empty table gives none. Only id, label and vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from songloom.llm.tables import saved, with_positions
from songloom.llm.vectors import SLAB, fitted, matrix, slabs, usable

#: Anchors of a tree, and of a bundle of trees.
TREE, BUNDLE = 512, 4096
#: Fewest and most rows of a slice.
SLICE, LARGEST_SLICE = 8192, 1 << 18
#: Fixed value: components are counted in parts of 256.
PARTS = 256
_LONG = (1 << 63) - 1


def whole(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors as whole numbers (in doubles, which hold them without loss)."""
    return np.floor(PARTS * matrix(column))


class Products:
    """Exact inner products of the rows of a slab with anchors."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.largest = float(np.abs(rows).max(initial=0.0))
        squares = (rows / max(self.largest, 1.0)) ** 2
        self.norms = np.sqrt(squares.sum(axis=1)) * max(self.largest, 1.0)

    def __call__(self, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores of the rows at ``at``; whole numbers, as doubles as long as these hold them."""
        rows = self.rows if len(at) == len(self.rows) else self.rows[at]
        if len(anchor) * self.largest * np.abs(anchor).max(initial=0.0) < 2**53:
            return rows @ anchor
        by = np.array([int(x) for x in anchor], dtype=object)
        return np.array([[int(x) for x in row] for row in rows], dtype=object).reshape(len(rows), len(by)) @ by


def spanning_tree(anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge): anchors with parents first, each one's parent's place in the order
    (its own at the root) and the length of the edge to it."""
    size = len(anchors)
    scale = max(1.0, float(np.abs(anchors).max(initial=0.0)))
    x = anchors / scale

    def lengths(i: int) -> np.ndarray:
        return np.sqrt(((x - x[i]) ** 2).sum(axis=1))

    order, parent, edge = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size)
    near, by = lengths(0), np.zeros(size, np.int64)
    near[0] = np.inf
    for place in range(1, size):
        nxt = int(np.argmin(near))
        order[place], parent[place], edge[place] = nxt, by[nxt], near[nxt] * scale
        far = lengths(nxt)
        closer = (far < near) & np.isfinite(near)
        near[closer], by[closer] = far[closer], place
        near[nxt] = np.inf
    return order, parent, edge


def trees(anchors: DataFrame) -> DataFrame:
    """``bundle, tree, place, parent, edge`` and the anchors' ``vec_id, label, vector``."""
    curves = fitted(anchors, 1, 16)
    if curves is None:
        return anchors.sparkSession.createDataFrame([], _TREES)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches):
            key = pa.array(curves.keys(matrix(slab.column("vector")), 0), pa.binary())
            columns = [slab.column(n).combine_chunks() for n in ("vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*columns, key], names=["vec_id", "label", "key"])

    keys = anchors.mapInArrow(keyed, "vec_id long, label long, key binary")
    placed = with_positions(keys, [F.col("label"), F.col("key"), F.col("vec_id")], "anchor-order").select("vec_id", "pos")
    near = anchors.join(placed, "vec_id").withColumn("tree", F.floor(F.col("pos") / TREE)).drop("pos")

    def joined(group: pa.Table) -> pa.Table:
        group = group.sort_by("vec_id")
        order, parent, edge = spanning_tree(whole(group.column("vector")))
        group = group.take(order)
        tree = pa.array(group.column("tree"))
        bundle = pa.array(tree.to_numpy() // (BUNDLE // TREE))
        columns = [bundle, tree, pa.array(np.arange(len(group))), pa.array(parent), pa.array(edge)]
        columns += [pa.array(group.column(n).combine_chunks()) for n in ("vec_id", "label")]
        vector = pa.array(matrix(group.column("vector")).tolist(), pa.list_(pa.float64()))
        return pa.Table.from_arrays([*columns, vector], names=_TREE_COLUMNS)

    # a tree holds anchors of one label
    return saved(near.groupBy("tree", "label").applyInArrow(joined, _TREES), "anchor-trees")


_TREES = "bundle long, tree long, place long, parent long, edge double, vec_id long, label long, vector array<double>"
_TREE_COLUMNS = [c.split()[0] for c in _TREES.split(", ")]


def _walk(tree: dict, slab: Products, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, rows, exact scores) of the rows of the slab that ``wanted(place, low, high)`` marks.

    ``low`` and ``high`` bound the scores of all rows at the anchor of this place.
    """
    size = len(slab.rows)
    every = np.arange(size)
    score, slack = np.empty((len(tree["vec_id"]), size)), np.empty((len(tree["vec_id"]), size))
    for place, anchor in enumerate(tree["vector"]):
        if place:
            up = tree["parent"][place]
            score[place] = score[up]
            slack[place] = slack[up] + tree["edge"][place] * slab.norms * (1 + 1e-9) + 1e-9
            rounding = 1e-9 * np.abs(score[place])
            low = np.clip(score[place] - slack[place] - rounding, -(2.0**63), 2.0**63)
            high = np.clip(score[place] + slack[place] + rounding, -(2.0**63), 2.0**63)
            at = np.flatnonzero(wanted(place, low, high))
        else:
            at = every
        exact = slab(anchor, at)
        score[place, at] = exact.astype(np.float64)
        slack[place, at] = 0.0
        if len(at):
            yield place, at, _longs(exact) if exact.dtype == object else exact


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(scores) > 8 * k and scores.dtype != object:
        high = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[-k])
        ids, scores = ids[high], scores[high]
    order = np.lexsort((ids, -scores)) if scores.dtype != object else sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))
    return ids[order[:k]], scores[order[:k]]


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate((a, b)) if a.dtype == b.dtype else np.concatenate((_longs(a), _longs(b)))


def _longs(scores: np.ndarray) -> np.ndarray:
    return np.array([max(-_LONG - 1, min(_LONG, int(x))) for x in scores], dtype=object)


def _trees_of(anchors: pa.Table) -> Iterator[dict]:
    anchors = anchors.sort_by([("tree", "ascending"), ("label", "ascending"), ("place", "ascending")])
    starts = [i for i, place in enumerate(anchors.column("place").to_pylist()) if place == 0]
    for a, b in zip(starts, [*starts[1:], len(anchors)]):
        part = anchors.slice(a, b - a)
        tree = {n: part.column(n).to_numpy() for n in ("vec_id", "parent", "edge")}
        tree |= {"label": part.column("label")[0].as_py(), "vector": whole(part.column("vector"))}
        yield tree | {"windows": part.column("windows").to_pylist()} if "windows" in part.column_names else tree


def _by_slab(rows: pa.Table, tree: dict, same: bool) -> Iterator[tuple[np.ndarray, Products]]:
    """Ids and vectors of the rows that have the tree's label, or have not."""
    labels = rows.column("label").to_numpy() == tree["label"]
    take = np.flatnonzero(labels if same else ~labels)
    for at in range(0, len(take), SLAB):
        part = rows.take(take[at : at + SLAB])
        yield part.column("vec_id").to_numpy(), Products(whole(part.column("vector")))


def _positives(k: int):
    def search(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = {"anchor_id": [], "ids": [], "scores": []}
        for tree in _trees_of(anchors) if len(rows) else ():
            best = [(np.empty(0, np.int64), np.empty(0)) for _ in tree["vec_id"]]
            for ids, slab in _by_slab(rows, tree, same=True):
                for place, at, exact in _walk(
                    tree, slab, lambda p, low, high: high >= (float(best[p][1][-1]) if len(best[p][1]) == k else -np.inf)
                ):
                    other = ids[at] != tree["vec_id"][place]
                    found, scores = _best(ids[at][other], exact[other], k)
                    best[place] = _best(np.concatenate((best[place][0], found)), _joined(best[place][1], scores), k)
            for anchor, (found, scores) in zip(tree["vec_id"].tolist(), best):
                if len(found):
                    for column, value in zip(out.values(), (anchor, found.tolist(), _longs(scores).tolist())):
                        column.append(value)
        return pa.Table.from_pydict(out, schema=_FOUND)

    return search


def _negatives(k: int, least: int, most: int):
    """Rows of other labels with ``least`` to ``most`` hundredths of each window's score."""

    def bounds(p: int) -> tuple[int, int]:
        return -(-least * p // 100), most * p // 100

    def search(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = {"anchor_id": [], "window": [], "ids": [], "scores": []}
        for tree in _trees_of(anchors) if len(rows) else ():
            windows = [[(p, *bounds(p)) for p in w or [] if bounds(p)[0] <= bounds(p)[1]] for w in tree["windows"]]
            lowest = [float(min((w[1] for w in x), default=np.inf)) for x in windows]
            highest = [float(max((w[2] for w in x), default=-np.inf)) for x in windows]
            best = [{w[0]: (np.empty(0, np.int64), np.empty(0)) for w in x} for x in windows]
            for ids, slab in _by_slab(rows, tree, same=False):
                for place, at, exact in _walk(tree, slab, lambda p, low, high: (high >= lowest[p]) & (low <= highest[p])):
                    for p, low, high in windows[place]:
                        inside = (exact >= low) & (exact <= high)
                        if inside.any():
                            found, scores = _best(ids[at][inside], exact[inside], k)
                            had = best[place][p]
                            best[place][p] = _best(np.concatenate((had[0], found)), _joined(had[1], scores), k)
            for anchor, found in zip(tree["vec_id"].tolist(), best):
                for p, (near, scores) in found.items():
                    if len(near):
                        for column, value in zip(out.values(), (anchor, p, near.tolist(), _longs(scores).tolist())):
                            column.append(value)
        return pa.Table.from_pydict(out, schema=_FOUND.insert(1, pa.field("window", pa.int64())))

    return search


_FOUND = pa.schema([("anchor_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64()))])


def _meet(rows: DataFrame, anchors: DataFrame, bundles: int, slices: int, search, schema: str) -> DataFrame:
    """Every slice of rows with every bundle of anchors, each pair in a group of its own."""
    piece = F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int")
    left = rows.withColumn("slice", piece).withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1)))).withColumn(
        "bundle", F.col("bundle").cast("long")
    )
    right = anchors.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return left.groupBy("slice", "bundle").cogroup(right.groupBy("slice", "bundle")).applyInArrow(search, schema)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of each anchor (and window) over all groups."""
    each = found.select(*keys, F.explode(F.arrays_zip("ids", "scores")).alias("x")).select(*keys, "x.*")
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("scores"), "ids"))
    return each.withColumn("rank", place).filter(F.col("rank") <= k)


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5,
    least: int = 80, most: int = 100, vector: str = "embedding", row_id: str = "vec_id",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is an expression over the column ``vec_id``; ``label`` one over the columns of
    ``vectors``. A negative has ``least`` to ``most`` hundredths of the positive's score.
    """
    labelled = vectors.withColumns({"_label": label.cast("long")}).filter("_label is not null")
    rows = saved(
        usable(labelled, vector, row_id, ("_label",)).select("vec_id", F.col("_label").alias("label"), "vector"), "negatives-rows"
    )
    total = rows.count()
    anchors = trees(rows.filter(is_anchor))
    bundles = (anchors.agg(F.max("bundle")).first()[0] or 0) + 1
    slices = max(1, -(-total // max(SLICE, min(LARGEST_SLICE, total // 1000))))
    first = _meet(rows, anchors, bundles, slices, _positives(positives), "anchor_id long, ids array<long>, scores array<long>")
    best = saved(
        _first(first, ["anchor_id"], positives).select(
            "anchor_id", F.col("ids").alias("positive_id"), F.col("scores").alias("positive_score")
        ),
        "positives",
    )
    windows = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("positive_score").alias("windows"))
    schema = "anchor_id long, window long, ids array<long>, scores array<long>"
    second = _meet(rows, anchors.join(windows, "vec_id", "left"), bundles, slices, _negatives(negatives, least, most), schema)
    hard = _first(second, ["anchor_id", "window"], negatives).select(
        "anchor_id", F.col("window").alias("positive_score"), "rank", F.col("ids").alias("negative_id"), F.col("scores").alias("negative_score")
    )
    return best.join(hard, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


#: DuckDB SQL for ``mine`` of the table {embeddings}: anchors divisible by 100, labels moved where
#: ids are divisible by 7.
MINE_SQL = """
with usable as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from {embeddings}
    where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (
    select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, list_dot_product(a.v, r.v)::bigint as score
    from usable a join usable r on a.vec_id % 100 = 0 and a.vec_id != r.vec_id
),
positives as (
    select anchor_id, vec_id as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id)::int as rank,
    vec_id as negative_id, positive_score, score as negative_score
from positives p join scored s on p.anchor_id = s.anchor_id and not same
    and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify rank <= 5
"""
