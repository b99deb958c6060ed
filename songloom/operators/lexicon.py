"""Words of scripts written without blanks (Thai, Lao, Khmer, Burmese), learnt from the lines themselves.

No dictionary is at hand, so one is learnt, as unigram models of text are:

1. Lines are cut into runs of these scripts and runs into *clusters*, a letter with its vowels and
   marks, which no word border divides. Equal runs (refrains, copies) are counted and kept once.
2. Sequences of up to ``longest`` clusters are candidates if they come often enough, if what
   stands before and after them varies (branching entropy on either side), and if, wherever they
   are cut, the parts come together far more often than by chance (else they are two words).
3. Hard expectation-maximisation: runs are cut along the most likely path through the
   candidates, and the counts of the words on these paths are the next weights.

Candidates are counted with map-side combination. The lexicon is bounded by ``size`` entries (the
most frequent), which is what tasks hold to find paths; runs are never gathered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import CLUSTER, LINE_RUN, line_clusters, tokens_by
from ..session import cut

#: Entries of a lexicon, clusters of a word, least occurrences of a candidate, least entropy (in
#: nats) of what stands on either side, least pointwise information (in nats) of its parts, rounds
#: of estimation.
SIZE, LONGEST, LEAST, ENTROPY, COHESION, ROUNDS = 100_000, 6, 3, 0.8, 1.5, 4


def distinct_runs(lines: DataFrame, column: str) -> DataFrame:
    """``run, n``: runs of the scripts in all lines, with their number."""
    runs = F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(LINE_RUN), F.lit(0))
    return lines.select(F.explode(runs).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


def _grams(runs: DataFrame, longest: int) -> DataFrame:
    """``gram, length, before, after, n``: all sequences of up to ``longest`` clusters.

    ``before`` and ``after`` are null at the ends of a run.
    """
    c = F.col("c")
    split = runs.select("n", line_clusters("run").alias("c"))
    split = split.select("n", "c", F.posexplode("c").alias("at", "_")).select(
        "n", "c", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(c) - F.col("at")))).alias("length")
    )
    gram = F.array_join(F.slice(c, F.col("at") + 1, F.col("length")), "")
    before = F.when(F.col("at") > 0, F.get(c, F.col("at") - 1))
    return split.select(gram.alias("gram"), "length", before.alias("before"), F.get(c, F.col("at") + F.col("length")).alias("after"), "n")


def _entropy(grams: DataFrame, side: str) -> DataFrame:
    """Entropy of the neighbours of each gram on one side; every end of a run is one of its own."""
    near = grams.groupBy("gram", side).agg(F.sum("n").alias("x"))
    known = F.when(F.col(side).isNotNull(), F.col("x") * F.log(F.col("x").cast("double"))).otherwise(0.0)
    total = F.sum("x")
    return near.groupBy("gram").agg((F.log(total.cast("double")) - F.sum(known) / total).alias(f"h_{side}"))


def _script(c: str) -> Column:
    """Number of the block of 128 characters that a text begins in: one or two per script."""
    return F.floor(F.ascii(c) / 128)


def _cohesion(words: DataFrame, often: DataFrame, totals: DataFrame) -> DataFrame:
    """``word, cohesion``: the least pointwise information between the parts of a word, over its cuts.

    ``totals`` are the clusters of each script (``script, clusters``).
    """
    c = F.col("c")
    cut_at = words.select("word", "n", line_clusters("word").alias("c")).filter(F.size(c) > 1)
    cut_at = cut_at.select("word", "n", "c", F.explode(F.sequence(F.lit(1), F.size(c) - 1)).alias("i"))
    parts = cut_at.select(
        "word", "n", F.array_join(F.slice(c, F.lit(1), F.col("i")), "").alias("a"), F.array_join(F.slice(c, F.col("i") + 1, F.size(c)), "").alias("b")
    )
    count = lambda name: often.select(F.col("gram").alias(name), F.col("total").alias(f"n_{name}"))
    known = parts.join(count("a"), "a").join(count("b"), "b")  # a part comes at least as often as the whole
    known = known.withColumn("script", _script("word")).join(totals, "script")
    chance = F.col("n_a").cast("double") * F.col("n_b") / F.col("clusters")
    return known.groupBy("word").agg(F.min(F.log(F.col("n") / chance)).alias("cohesion"))


def candidates(
    runs: DataFrame, longest: int = LONGEST, least: int = LEAST, entropy: float = ENTROPY, cohesion: float = COHESION
) -> DataFrame:
    """``word, n``: sequences that may be words."""
    grams = cut(_grams(runs, longest).groupBy("gram", "length", "before", "after").agg(F.sum("n").alias("n")))
    often = cut(grams.groupBy("gram").agg(F.sum("n").alias("total")).filter(F.col("total") >= least))
    totals = grams.filter("length = 1").groupBy(_script("gram").alias("script")).agg(F.sum("n").alias("clusters"))
    varied = often.join(_entropy(grams, "before"), "gram").join(_entropy(grams, "after"), "gram")
    varied = varied.filter((F.col("h_before") >= entropy) & (F.col("h_after") >= entropy))
    words = varied.select(F.col("gram").alias("word"), F.col("total").cast("double").alias("n"))
    bound = words.join(_cohesion(words, often, totals), "word", "left")
    return bound.filter(F.coalesce(F.col("cohesion") >= cohesion, F.lit(True))).select("word", "n")


class Paths:
    """Most likely words of a run under a lexicon of ``{word: count}``."""

    def __init__(self, counts: dict[str, float], longest: int = LONGEST):
        total = math.log(sum(counts.values()) + 1.0)
        self.costs = {w: total - math.log(n) for w, n in counts.items() if n > 0}
        self.unknown = total + 3.0  # a cluster that no entry holds
        self.longest = longest

    def __call__(self, run: str) -> list[str]:
        clusters = CLUSTER.findall(run)
        best, start = [0.0], [0]
        for end in range(1, len(clusters) + 1):
            cost, back = best[end - 1] + self.unknown, end - 1
            word = ""
            for begin in range(end - 1, max(-1, end - 1 - self.longest), -1):
                word = clusters[begin] + word
                known = self.costs.get(word)
                if known is not None and best[begin] + known < cost:
                    cost, back = best[begin] + known, begin
            best.append(cost)
            start.append(back)
        words, end = [], len(clusters)
        while end:
            words.append("".join(clusters[start[end] : end]))
            end = start[end]
        return words[::-1]


def _counted(runs: DataFrame, paths: Paths) -> DataFrame:
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, int] = {}
            for run, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word in paths(run):
                    found[word] = found.get(word, 0) + n
            yield pa.RecordBatch.from_pydict({"word": list(found), "n": list(found.values())}, schema=_COUNTS)

    counted = runs.select("run", "n").mapInArrow(walk, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").cast("double").alias("n"))


_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def _most_frequent(words: DataFrame, size: int) -> dict[str, float]:
    return {r["word"]: r["n"] for r in words.orderBy(F.desc("n"), "word").limit(size).collect()}


def learn_lexicon(
    lines: DataFrame, column: str, size: int = SIZE, longest: int = LONGEST, least: int = LEAST,
    entropy: float = ENTROPY, cohesion: float = COHESION, rounds: int = ROUNDS,
) -> dict[str, float]:
    """Words with their expected counts in ``lines``, at most ``size`` of them.

    Lines that are null or hold none of the scripts teach nothing; without any the lexicon is empty.
    """
    runs = cut(distinct_runs(lines, column))
    counts = _most_frequent(candidates(runs, longest, least, entropy, cohesion), size)
    for _ in range(rounds if counts else 0):
        found = _most_frequent(_counted(runs, Paths(counts, longest)), size)
        counts = {w: n for w, n in found.items() if w in counts}
    return counts


def segment_lines(lines: DataFrame, column: str, lexicon: dict[str, float], name: str = "tokens", longest: int = LONGEST) -> DataFrame:
    """F17 with a lexicon: ``lines`` and an array of (text, isWord).

    Lines without these scripts are cut as by :func:`line_tokens`; only the others visit Python.
    """
    paths = Paths(lexicon, longest) if lexicon else None

    @F.pandas_udf("array<array<string>>")
    def cut_runs(runs):
        return runs.map(lambda listed: [paths(r) if paths else CLUSTER.findall(r) for r in listed])

    def of_run(runs: Column) -> Column:
        return F.when(F.size(runs) > 0, cut_runs(runs))

    return tokens_by(lines, column, name, of_run)
