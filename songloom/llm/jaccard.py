"""Near duplicates: pairs of texts whose sets of word 5-grams have a Jaccard similarity of 0.8.

1. Every text gets its MinHash values. Equal texts are one from here on.
2. Texts that agree in a band of values meet in a bucket. A bucket of any size is cut into
   blocks, and pairs of blocks are compared in tasks of their own.
3. A pair is compared value by value, in steps. After each step, if the probability that its
   similarity reaches the threshold, given the matches so far, is below a tolerance, it is
   dropped (Bayesian pruning; uniform prior). A pair that meets in several buckets is compared
   in the first only.
4. The rest is verified exactly on the texts. Texts of large buckets are bundled, and pairs
   travel as lists between bundles, so a group of very many near copies makes few rows; each
   bundle's links are counted and reduced to a spanning forest where they are found.
5. Classes are the connected components of the links.

A pair above the threshold is missed by the bands with a probability below 4e-6 (24 bands of
4 values at 0.8), by the pruning with one of about the tolerance.

Words are runs of letters and digits, A-Z in lower case. A text of fewer than five words is
one gram of all its words; null texts and texts without words link with nothing and are
classes of their own unless they are equal. Rows with equal texts are one text however often
they come. Null ids count as larger than all others. An empty table gives no rows. Only doc_id
and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.llm.tables import saved, unused

GRAM, THRESHOLD = 5, 0.8
BANDS, ROWS, VALUES = 24, 4, 128
STEP, TOLERANCE = 16, 1e-6
#: Members of a block of a bucket, and of a bundle for verification.
BLOCK, BUNDLE = 256, 64

#: Fixed value: what stands between words once A-Z are lower case.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_ODD = np.random.default_rng(20).integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(21).integers(0, 1 << 63, VALUES, dtype=np.uint64)


class Grams:
    """Sets of hashed word grams; hashes of words are kept between texts, up to a bound."""

    def __init__(self, kept: int = 100_000):
        self._kept, self._known = kept, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = _WORD.findall((text or "").translate(_LOWER))
        known = self._known
        try:
            hashes = [known[w] for w in words]
        except KeyError:
            if len(known) > self._kept:
                known.clear()
            known.update((w, xxhash.xxh64_intdigest(w)) for w in set(words) if w not in known)
            hashes = [known[w] for w in words]
        h = np.array(hashes, dtype=np.uint64)
        size = min(GRAM, len(h))
        if not size:
            return h
        grams = np.zeros(len(h) - size + 1, dtype=np.uint64)
        for j in range(size):
            grams = (grams ^ h[j : len(h) - size + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            grams ^= grams >> np.uint64(29)
        return np.unique(grams)


def min_hashes(grams: np.ndarray) -> np.ndarray:
    """VALUES MinHash values of 32 bits; grams are taken in stretches, so memory is bounded."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(grams), 4096):
        part = grams[at : at + 4096]
        np.minimum(least, (part[None, :] * _ODD[:, None] + _ADD[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Grams()
    for batch in batches:
        n, bands, values = [], [], []
        for text in batch.column("text").to_pylist():
            found = grams(text)
            n.append(len(found))
            if len(found):
                mins = min_hashes(found)
                bands.append([int.from_bytes(xxhash.xxh32_digest(mins[b * ROWS : (b + 1) * ROWS].tobytes())) for b in range(BANDS)])
                values.append((mins & np.uint32(0xFF)).astype(np.uint8).tobytes())
            else:
                bands.append([])
                values.append(b"")
        columns = [batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int32()), pa.array(bands, pa.list_(pa.int64())), pa.array(values, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "n", "bands", "values"])


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, fewest matches with which a pair goes on) after each step.

    With a uniform prior the similarity after m matches of n is Beta(m + 1, n - m + 1); that it
    reaches t has the probability that at most m of n + 1 trials with chance t succeed.
    """
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def _pruned(a: list[dict], b: list[dict] | None, band: int, limits: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of one bucket that may reach the threshold; within ``a`` if no ``b``."""
    other = a if b is None else b
    n1, n2 = (np.array([r["n"] for r in x]) for x in (a, other))
    small, large = np.minimum(n1[:, None], n2[None, :]), np.maximum(n1[:, None], n2[None, :])
    near = small >= THRESHOLD * large  # a set of another size cannot be similar
    if b is None:
        near &= np.triu(np.ones(near.shape, dtype=bool), 1)
    i, j = np.nonzero(near)
    if band and len(i):
        bands1, bands2 = (np.array([r["bands"][:band] for r in x], dtype=np.int64) for x in (a, other))
        first = ~(bands1[i] == bands2[j]).any(axis=1)
        i, j = i[first], j[first]
    values1, values2 = (np.frombuffer(b"".join(r["values"] for r in x), np.uint8).reshape(len(x), VALUES) for x in (a, other))
    matches, done = np.zeros(len(i), dtype=np.int64), 0
    for n, least in limits:
        matches += (values1[i, done:n] == values2[j, done:n]).sum(axis=1)
        go = matches >= least
        i, j, matches, done = i[go], j[go], matches[go], n
    return i, j


_PAIRS = pa.schema([("bundle1", pa.binary()), ("bundle2", pa.binary()), ("keys1", pa.list_(pa.binary())), ("keys2", pa.list_(pa.binary()))])
_PAIRS_SQL = "bundle1 binary, bundle2 binary, keys1 array<binary>, keys2 array<binary>"


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal ``names`` of a sorted partition."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for key, group in groupby(rows, key=lambda r: tuple(r[n] for n in names)):
        yield key, list(group)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    limits, out = least_matches(), []
    for (band, _, one, two), rows in _groups(batches, ["band", "value", "block1", "block2"]):
        if one == two:
            a, b = rows, None
        else:
            a, b = ([r for r in rows if r["block"] == x] for x in (one, two))
        if len(rows) < 2 or (b is not None and not (a and b)):
            continue
        i, j = _pruned(a, b, band, limits)
        lists: dict[tuple, tuple[list, list]] = {}
        for x, y in zip(i.tolist(), j.tolist()):
            p, q = sorted((a[x], (a if b is None else b)[y]), key=lambda r: (r["bundle"], r["key"]))
            one_list, two_list = lists.setdefault((p["bundle"], q["bundle"]), ([], []))
            one_list.append(p["key"])
            two_list.append(q["key"])
        out += [{"bundle1": k[0], "bundle2": k[1], "keys1": v[0], "keys2": v[1]} for k, v in lists.items()]
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, schema=_PAIRS)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_PAIRS)


_LINKS = pa.schema([("key", pa.binary()), ("n_links", pa.int64()), ("root", pa.binary())])


def _root(parent: dict, x: bytes) -> bytes:
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact similarities of the pairs of two bundles: per text its links and its root."""
    grams, out = Grams(), []
    for _, rows in _groups(batches, ["bundle1", "bundle2"]):
        sets = {r["key"]: grams(r["text"]) for r in rows if r["key"] is not None}
        links: dict[bytes, int] = {}
        parent: dict[bytes, bytes] = {}
        for row in rows:
            for one, two in zip(row["keys1"] or (), row["keys2"] or ()):
                a, b = sets[one], sets[two]
                shared = len(np.intersect1d(a, b, assume_unique=True))
                if shared >= THRESHOLD * (len(a) + len(b) - shared) - 1e-9:
                    links[one] = links.get(one, 0) + 1
                    links[two] = links.get(two, 0) + 1
                    roots = sorted((_root(parent, one), _root(parent, two)))
                    parent[roots[1]] = roots[0]
        out += [{"key": k, "n_links": n, "root": _root(parent, k)} for k, n in links.items()]
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, schema=_LINKS)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_LINKS)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, key (digest of the text), n (grams), bands and low bytes of the MinHash values."""
    rows = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"), "text")
    return rows.mapInArrow(_signed, "doc_id long, key binary, n int, bands array<long>, values binary")


def candidates(texts: DataFrame) -> DataFrame:
    """Lists of pairs that passed the pruning, by bundles; ``texts`` has one row per text."""
    banded = texts.filter("n > 0").select("key", F.posexplode("bands").alias("band", "value"))
    buckets = saved(banded.groupBy("band", "value").count().filter("count > 1"), "jaccard-buckets")
    members = saved(banded.join(buckets, ["band", "value"]), "jaccard-members")
    # texts of a large bucket are bundled by their largest one; the others are bundles of one
    largest = members.groupBy("key").agg(F.max(F.struct("count", "band", "value")).alias("b"))
    parts = F.ceil(F.col("b.count") / BUNDLE)
    of_bucket = F.unhex(F.md5(F.concat_ws(":", "b.band", "b.value", F.pmod(F.xxhash64("key"), parts))))
    bundled = texts.join(largest.select("key", F.when(F.col("b.count") >= BUNDLE, of_bucket).otherwise(F.col("key")).alias("bundle")), "key")
    blocks = F.ceil(F.col("count") / BLOCK)
    rows = members.join(bundled.select("key", "n", "bands", "values", "bundle"), "key")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), blocks))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.select(
        "band", "value", F.least("block", "other").alias("block1"), F.greatest("block", "other").alias("block2"),
        "block", "key", "bundle", "n", "bands", "values",
    )
    place = ["band", "value", "block1", "block2"]
    compared = rows.repartition(*place).sortWithinPartitions(*place, "key").mapInArrow(_compared, _PAIRS_SQL)
    return saved(compared, "jaccard-candidates")


def links(docs: DataFrame, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """key, n_links and root of every text in a link, once per two bundles it has links in."""
    place = ["bundle1", "bundle2"]
    # all pairs of two bundles in one row, whatever buckets they met in
    both = F.collect_list(F.struct("keys1", "keys2"))
    pairs = pairs.groupBy(*place).agg(both.alias("lists")).select(
        *place, *[F.flatten(F.col(f"lists.{c}")).alias(c) for c in ("keys1", "keys2")]
    )
    pairs = saved(pairs, "jaccard-pairs")
    wanted = pairs.select(*place, F.explode(F.array_distinct(F.concat("keys1", "keys2"))).alias("key"))
    wanted = saved(wanted, "jaccard-wanted")
    # one row per needed text: the row of its smallest id
    needed = saved(wanted.select("key").distinct().join(texts.select("key", F.col("first").alias("doc_id")), "key"), "jaccard-needed")
    rows = docs.select("doc_id", F.unhex(F.md5("text")).alias("key"), "text")
    same = F.col("rows.key").eqNullSafe(F.col("needed.key")) & F.col("rows.doc_id").eqNullSafe(F.col("needed.doc_id"))
    # merged at every size: the texts are the large side of any input
    found = rows.alias("rows").join(needed.alias("needed").hint("merge"), same, "left_semi").select("key", "text").dropDuplicates(["key"])
    sent = wanted.join(found, "key").withColumns({"keys1": F.lit(None).cast("array<binary>"), "keys2": F.lit(None).cast("array<binary>")})
    lists = pairs.withColumns({"key": F.lit(None).cast("binary"), "text": F.lit(None).cast("string")})
    both = sent.unionByName(lists).repartition(*place).sortWithinPartitions(*place)
    return saved(both.mapInArrow(_verified, "key binary, n_links long, root binary"), "jaccard-links")


def components(edges: DataFrame) -> DataFrame:
    """key and label (the smallest key) of the connected components of edges (a, b).

    In each round every key points to its smallest neighbour. These pointers lead to pairs of
    keys that point to each other, the smaller of which is the smallest key of all that lead
    to it. All of them become this one key, and links within it vanish. A key with a link left
    is never alone, so at least half of the keys vanish a round, whatever the shape of a
    component; rounds end when no link is left. The labels are then read back from the last
    round to the first.
    """
    pairs = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = saved(pairs.distinct(), "edges")
    keys = both.select(F.col("a").alias("key")).distinct()
    live = both.filter("a <> b")
    rounds = []
    while not live.isEmpty():
        rounds.append(_roots(saved(live.groupBy("a").agg(F.min("b").alias("b")), "least")))
        one, two = (rounds[-1].select(F.col("key").alias(c), F.col("root").alias(f"root_{c}")) for c in ("a", "b"))
        moved = live.join(one, "a").join(two, "b").filter("root_a <> root_b")
        live = saved(moved.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "edges")
    if not rounds:
        return keys.withColumn("label", F.col("key"))
    labels = rounds.pop()
    while rounds:
        # the keys of a round are roots of the round before, or were settled by it
        further = labels.select(F.col("key").alias("root"), F.col("root").alias("further"))
        labels = saved(rounds.pop().join(further, "root", "left").select("key", F.coalesce("further", "root").alias("root")), "labels")
    return keys.join(labels, "key", "left").select("key", F.coalesce("root", "key").alias("label"))


def _roots(least: DataFrame) -> DataFrame:
    """key and root of the trees of pointers from a to b, by following pointers of pointers."""
    over = least.select(F.col("a").alias("b"), F.col("b").alias("c"))
    # a key that is pointed back to is the root if it is the smaller; no other key has c = a
    first = F.when(F.col("c") == F.col("a"), F.least("a", "b")).otherwise(F.least("b", "c"))
    roots = saved(least.join(over, "b").select(F.col("a").alias("key"), first.alias("root")), "roots")
    while True:
        over = roots.select(F.col("key").alias("root"), F.col("root").alias("further"))
        moved = saved(roots.join(over, "root").select("key", F.col("further").alias("root"), F.col("root").alias("before")), "roots")
        roots = moved.select("key", "root")
        if moved.filter("root <> before").isEmpty():
            return roots


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, class_id (smallest doc_id of its class), n_links, n_copies, and the
    digests of its text and class.

    ``n_links`` counts the other texts that are similar enough, ``n_copies`` the other rows with
    the same text.
    """
    signed = saved(signatures(docs), "jaccard-signatures")
    texts = saved(
        signed.groupBy("key").agg(
            F.min("doc_id").alias("first"), F.count("*").alias("rows"), F.first("n").alias("n"),
            F.first("bands").alias("bands"), F.first("values").alias("values"),
        ),
        "jaccard-texts",
    )
    found = links(docs, texts, candidates(texts))
    counted = found.groupBy("key").agg(F.sum("n_links").alias("n_links"))
    labels = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    named = texts.select("key", "first", "rows").join(counted, "key", "left").join(labels, "key", "left")
    named = saved(named.withColumn("label", F.coalesce("label", "key")), "jaccard-named")
    firsts = named.groupBy("label").agg(F.min("first").alias("class_id"))
    classes = saved(named.join(firsts, "label"), "jaccard-classes")
    return signed.select("doc_id", "key").join(classes, "key").select(
        "doc_id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.col("rows") - 1).alias("n_copies"), "key", F.col("label").alias("class_key"),
    )


def one_per_class(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: the one of the smallest id."""
    found = near_duplicates(docs)
    # rows that repeat id and text count as one
    rows_of = found.groupBy("class_key", "doc_id", "key").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key", "n")).alias("k")
    kept = rows_of.groupBy("class_key").agg(least).select("k.doc_id", F.col("k.key").alias("_key"), "k.n")
    kept = saved(kept, "jaccard-kept")
    key = unused(docs, "_key")
    rows = docs.withColumn(key, F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    same = rows["doc_id"].eqNullSafe(kept["doc_id"]) & (rows[key] == kept["_key"])
    chosen = rows.join(kept, same, "left_semi")
    if not kept.filter("n > 1").isEmpty():
        chosen = chosen.dropDuplicates(["doc_id", key])
    return chosen.drop(key)
