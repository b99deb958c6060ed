"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct words of a text and their beginnings, hashed. The score of a set of
terms is ``bias + sum of weights + sum over pairs of <v_i, v_j>``, so that two terms may mean
more together than apart (an insult next to the mention of a group), which no additive
weights express. The pair sum takes one pass per factor.

Training: labelled rows outside the held-out fold, at most ``max_per_label`` of each label,
chosen by a hash of their ids. Tasks hash their terms; the driver gets these sets and fits the
machine to all terms that more than one text holds. None is left out for telling little alone;
such a term has a smaller value, so that a hundred thousand of them do not drown the others
in chance. Scoring is one pass over all whole texts with a model of bounded size (2^20 hashed terms).

Null and empty texts have no terms and get the score of the bias. Labels other than 0 and 1,
and labels without a document, are not learnt from; a document with several equal ids is
learnt from once per label. Without labels of both kinds every score is 0. Very long texts are
scored whole. Every row gives one row; an empty table gives none. Columns of other names are not
read here, and ``harmless`` hands them on whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.llm.tables import saved, unused

BITS = 20
FACTORS = 4
#: Bound of the training sample: documents per label. Terms are bounded by their hashes.
MAX_PER_LABEL = 4000
#: A term that one text alone holds says nothing of others.
MIN_TEXTS = 2
#: Beginnings of words that are terms of their own.
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.3
#: Passes over the sample, documents of a step, and fewest steps, however few rows there are.
EPOCHS, BATCH, STEPS = 20, 128, 1200
#: Chi-square from which a term counts in full, and the least value of a term.
CLEAR, LEAST_VALUE = 20.0, 0.005
#: Decay of weights and of factors.
DECAY = (1e-5, 1e-3)

_WORD = re.compile(r"[^\W\d_]+")


def word_terms(word: str) -> list[int]:
    """Hashed terms of a lower-case word: itself and its beginnings."""
    mask = (1 << BITS) - 1
    terms = [xxhash.xxh64_intdigest(word, 1) & mask]
    terms += [xxhash.xxh64_intdigest(word[:n], 2) & mask for n in BEGINNINGS if len(word) >= n]
    return terms


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


@dataclass
class Model:
    """Bias, and for each kept term its weight and factors."""

    bias: float = -50.0
    terms: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    factors: np.ndarray = field(default_factory=lambda: np.empty((0, FACTORS)))

    def margin(self, rows: list[int]) -> float:
        """Margin of a set of row numbers of the kept terms."""
        v = self.factors[rows].astype(np.float64)
        summed = v.sum(axis=0)
        return float(self.bias + self.weights[rows].sum(dtype=np.float64) + 0.5 * (summed @ summed - (v * v).sum()))


def _sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def evidence(sets: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The value of each term, 0 to 1: how well its presence alone tells the labels apart.

    The square of its chi-square in relation to ``CLEAR``; ``LEAST_VALUE`` at least, so that a term
    that says little alone is learnt too, but slowly, and by itself weighs little.
    """
    toxic, clean = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for terms, label in zip(sets, labels):
        (toxic if label else clean)[terms] += 1
    seen, share = toxic + clean, labels.mean()
    spread = seen * share * (1 - seen / len(labels)) * (1 - share)
    chi = (toxic - seen * share) ** 2 / np.maximum(spread, 1e-9)
    return np.clip((chi / CLEAR) ** 2, LEAST_VALUE, 1.0)


def train(sets: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> Model:
    """Fit to all terms of at least ``MIN_TEXTS`` texts by Adam on the logistic loss, with decay.

    Terms have values by their :func:`evidence`, which end up in the weights and factors. Batches
    are whole documents; a step touches the terms of its batch only.
    """
    if not len(labels) or labels.min() == labels.max():
        return Model()
    sets = [np.unique(s).astype(np.int64) for s in sets]
    seen = np.bincount(np.concatenate(sets), minlength=1 << BITS)
    terms = np.flatnonzero(seen >= MIN_TEXTS)
    row_of = np.full(1 << BITS, -1, dtype=np.int32)
    row_of[terms] = np.arange(len(terms), dtype=np.int32)
    kept = [r[r >= 0] for r in (row_of[s] for s in sets)]
    value_of = evidence(sets, labels)[terms].astype(np.float32)[:, None]
    rng = np.random.default_rng(seed)
    bias, w = np.zeros(1), np.zeros((len(terms), 1), dtype=np.float32)
    v = rng.normal(0, 0.05, (len(terms), FACTORS)).astype(np.float32)
    moments = {name: (np.zeros_like(x), np.zeros_like(x)) for name, x in (("bias", bias), ("w", w), ("v", v))}
    step = 0

    def move(name: str, value: np.ndarray, at: np.ndarray | slice, slope: np.ndarray) -> None:
        m, s = moments[name]
        m[at] += 0.1 * (slope - m[at])
        s[at] += 0.001 * (slope**2 - s[at])
        value[at] -= 0.03 * (m[at] / (1 - 0.9**step)) / (np.sqrt(s[at] / (1 - 0.999**step)) + 1e-8)

    batches = max(1, len(labels) // BATCH)
    for _ in range(max(epochs, STEPS // batches)):
        order = rng.permutation(len(labels))
        for batch in np.array_split(order, batches):
            sizes = np.array([len(kept[i]) for i in batch])
            touched, rows = np.unique(np.concatenate([kept[i] for i in batch]), return_inverse=True)
            doc = np.repeat(np.arange(len(batch)), sizes)
            worth = value_of[touched]
            wr, vr = (w[touched] * worth)[rows, 0], (v[touched] * worth)[rows]
            summed = np.stack([np.bincount(doc, vr[:, f], len(batch)) for f in range(FACTORS)], axis=1)
            squares = np.bincount(doc, (vr * vr).sum(axis=1), len(batch))
            margin = bias[0] + np.bincount(doc, wr, len(batch)) + 0.5 * ((summed**2).sum(axis=1) - squares)
            slope = (_sigmoid(margin) - labels[batch]) / len(batch)
            each = slope[doc, None] * (summed[doc] - vr)
            step += 1
            move("bias", bias, slice(None), np.array([slope.sum()]))
            move("w", w, touched, worth * np.bincount(rows, slope[doc], len(touched))[:, None] + DECAY[0] * w[touched])
            by_factor = [np.bincount(rows, each[:, f], len(touched)) for f in range(FACTORS)]
            move("v", v, touched, worth * np.stack(by_factor, axis=1) + DECAY[1] * v[touched])
    return Model(float(bias[0]), terms, (w * value_of)[:, 0], v * value_of)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique([t for w in words(x) for t in word_terms(w)]).astype("<u4").tobytes() for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sets, pa.binary())], names=["doc_id", "label", "terms"])


def training_sets(docs: DataFrame, labels: DataFrame, max_per_label: int = MAX_PER_LABEL) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed terms and labels of the training sample: at most ``max_per_label`` documents each.

    Tasks hash the terms where the texts lie; rows with one id and label are reduced to one.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).filter((fold != 2) & F.col("label").isin(0, 1)).distinct()
    ranked = [
        known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_label) for k in (0, 1)
    ]
    chosen = saved(ranked[0].unionByName(ranked[1]), "toxicity-sample")  # bounded by the parameter
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    hashed = texts.select("doc_id", "label", "text").mapInArrow(_hashed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, terms binary")
    rows = hashed.groupBy("doc_id", "label").agg(F.min("terms").alias("terms")).collect()  # at most twice the parameter
    rows.sort(key=lambda r: (r["doc_id"], r["label"]))
    return [np.frombuffer(r["terms"], "<u4") for r in rows], np.array([r["label"] for r in rows], dtype=float)


def _scorer(model: Model, name: str = "score", kept: int = 100_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_of = dict(zip(model.terms.tolist(), range(len(model.terms))))
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            scores = []
            for text in batch.column(batch.schema.names.index("text")).to_pylist():
                found: set[int] = set()
                for word in words(text or ""):
                    rows = known.get(word)
                    if rows is None:
                        if len(known) >= kept:
                            known.clear()
                        rows = known[word] = tuple(row_of[t] for t in word_terms(word) if t in row_of)
                    found.update(rows)
                scores.append(float(_sigmoid(model.margin(sorted(found)))))
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*names, name])

    return score


def scored(docs: DataFrame, model: Model, columns: list[str], name: str = "score") -> DataFrame:
    """``columns`` of ``docs`` with the scores of its texts in the new column ``name``."""
    rows = docs.select(*dict.fromkeys([*columns, "text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{name}` double"
    return rows.mapInArrow(_scorer(model, name), schema).select(*columns, name)


def fit(docs: DataFrame, labels: DataFrame, max_per_label: int = MAX_PER_LABEL) -> Model:
    """Learn from labelled rows outside the held-out fold."""
    return train(*training_sets(docs, labels, max_per_label))


def harmless(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those whose score reaches the threshold."""
    name = unused(docs, "_toxicity")
    return scored(docs, fit(docs, labels), docs.columns, name).filter(F.col(name) < THRESHOLD).drop(name)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    rows = scored(docs, fit(docs, labels), ["doc_id"])
    return rows.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
