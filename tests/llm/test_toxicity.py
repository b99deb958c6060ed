import os
import zlib

import numpy as np
from cases import DOCS, no_docs, odd_docs
from pyspark.sql import functions as F

from songloom.llm import toxicity as t


def hashed(texts):
    return [np.unique([h for w in t.words(x) for h in t.word_terms(w)]).astype(np.int64) for x in texts]


def scores(model, texts):
    row = {int(h): i for i, h in enumerate(model.terms)}
    return np.array([t._sigmoid(model.margin([row[h] for h in s.tolist() if h in row])) for s in hashed(texts)])


def corpus(seed, n=1500):
    """Toxic where an insult meets a group; either alone is harmless."""
    rnd = np.random.default_rng(seed)
    filler = [f"word{i}" for i in range(300)]
    texts, labels = [], []
    for _ in range(n):
        insult, group = rnd.random() < 0.4, rnd.random() < 0.4
        words = list(rnd.choice(filler, 12)) + ["vermin"] * insult + ["neighbours"] * group
        texts.append(" ".join(rnd.permutation(words)))
        labels.append(float(insult and group))
    return texts, np.array(labels)


def test_pairs_are_learnt_that_single_weights_miss():
    texts, labels = corpus(1)
    model = t.train(hashed(texts), labels)
    held, truth = corpus(2, 400)
    assert ((scores(model, held) >= t.THRESHOLD) == truth).mean() > 0.99
    additive = t.Model(model.bias, model.terms, model.weights, np.zeros_like(model.factors))
    assert ((scores(additive, held) >= t.THRESHOLD) == truth).mean() < 0.99


def test_many_weak_terms_mean_much_together():
    """60 insults and 60 groups; each word alone says almost nothing, whatever it stands beside."""

    def texts_of(seed, n):
        rnd = np.random.default_rng(seed)
        filler, insults, groups = ([f"{p}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(k)] for p, k in (("word", 300), ("insult", 60), ("group", 60)))
        out, labels = [], []
        for _ in range(n):
            kind = rnd.random()
            words = list(rnd.choice(filler, 10))
            if kind < 0.7:  # an insult, a group, or both
                words += [rnd.choice(insults)] * (kind < 0.25 or kind >= 0.45) + [rnd.choice(groups)] * (kind >= 0.25)
            out.append(" ".join(rnd.permutation(words)))
            labels.append(float(0.45 <= kind < 0.7))
        return out, np.array(labels)

    texts, labels = texts_of(1, 8000)
    model = t.train(hashed(texts), labels)
    held, truth = texts_of(2, 1000)
    assert ((scores(model, held) >= t.THRESHOLD) == truth).mean() >= 0.99


def test_scores_by_every_pair(spark, data_dir):
    """Training, folds and scores of the query, with the margin summed pair by pair."""
    docs, labels = (spark.read.parquet(f"{data_dir}/{n}.parquet") for n in ("documents", "labels"))
    model = t.fit(docs, labels)
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in rows}
    told = {(r["doc_id"], r["toxic"]) for r in labels.collect() if r["doc_id"] in rows and not fold[r["doc_id"]] and r["toxic"] in (0, 1)}
    sets, given = t.training_sets(docs, labels)
    assert len(sets) == len(told) and sorted(given) == sorted(float(x) for _, x in told)
    place = {int(h): i for i, h in enumerate(model.terms)}
    got = {r["doc_id"]: r for r in t.classify(docs, labels).collect()}
    for i in sorted(rows)[:40]:
        found = sorted({place[h] for w in t.words(rows[i]) for h in t.word_terms(w) if h in place})[:400]
        if len({h for w in t.words(rows[i]) for h in t.word_terms(w) if h in place}) > 400:
            continue
        f = model.factors[found].astype(float)
        margin = model.bias + model.weights[found].astype(float).sum() + sum((f[a] * f[a + 1 :]).sum() for a in range(len(found)))
        assert got[i]["held_out"] == fold[i] and abs(got[i]["score"] - t._sigmoid(margin)) < 1e-6
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.3)


def test_repeated_ids_are_learnt_from_once(spark):
    docs = spark.createDataFrame([(1, f"bad words here {i}", "en", "s", 1) for i in range(50)] + [(3, "fine words", "en", "s", 1)], DOCS)
    labels = spark.createDataFrame([(1, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    sets, given = t.training_sets(docs, labels, max_per_label=1)
    assert given.tolist() == [1.0, 0.0] and len(sets) == 2


def test_margin_is_the_sum_over_pairs():
    rnd = np.random.default_rng(3)
    model = t.Model(0.5, np.arange(6), rnd.normal(size=6), rnd.normal(size=(6, t.FACTORS)))
    rows = [0, 2, 3, 5]
    pairs = sum(model.factors[i] @ model.factors[j] for i in rows for j in rows if i < j)
    assert abs(model.margin(rows) - (0.5 + model.weights[rows].sum() + pairs)) < 1e-9
    assert model.margin([]) == 0.5


def test_held_out_accuracy_on_the_corpus(spark, data_dir):
    docs, labels = (spark.read.parquet(f"{data_dir}/{n}.parquet") for n in ("documents", "labels"))
    got = t.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(got) > 5 and np.mean([r["predicted"] == r["toxic"] for r in got]) >= 0.9


def test_toxic_documents_are_caught_and_clean_ones_left(spark, data_dir):
    """Held out rows of a larger table: most toxic ones are found, hardly a clean one."""
    folder = os.path.join(os.path.dirname(data_dir), "sf0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    got = t.classify(docs, labels).join(labels, "doc_id").filter("held_out")
    rate = {r["toxic"]: r["p"] for r in got.groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()}
    assert rate[1] > 0.8 and rate[0] < 0.01


def test_odd_rows_odd_labels_and_empty_tables(spark):
    schema = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 0, 1), (2, 0, 1), (None, 1, 1), (99, 1, 0), (4, None, None), (5, 1, 7)], schema)
    got = t.classify(odd_docs(spark), labels).collect()
    assert len(got) == 13 and all(0 <= r["score"] <= 1 for r in got)
    none = t.classify(odd_docs(spark), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {t._sigmoid(-50.0)} and not any(r["predicted"] for r in none)
    assert t.classify(no_docs(spark), labels).collect() == []
