"""Quality by weak supervision: rules vote or abstain, and their accuracies are estimated.

Every rule looks at figures of a text and votes good (1), bad (-1) or abstains (0). Nobody
tells which votes are right: expectation-maximisation finds the share of good documents and,
per rule, how often good and bad ones get each vote, so that the votes of all documents
become likeliest. A document is kept if it is good with a probability of a half or
more under these estimates.

Only DataFrame functions are used. Votes are counted by pattern, of which there are at most
three to the number of rules; the estimation is one expression over the array of patterns,
and the posterior comes back to the documents by a join on the pattern.

Null and empty texts have no words, fail the base rule and are not kept; every row of the
input gives one row, whatever its id; an empty table gives none. Only doc_id and text are
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.llm.tables import saved

#: Characters between words, symbol characters, the window of repeated words.
_BETWEEN = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"
_SYMBOLS = r"[#*$%&|<>]"
REPEAT_WINDOW = 8

ROUNDS = 40


def figures(docs: DataFrame) -> DataFrame:
    """doc_id and the figures of each text: words, characters, symbols, repeats, case, marks."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = df.select(
        "doc_id", "text",
        F.array_remove(F.split("text", _BETWEEN), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(_WORD)).alias("lines"),
    )
    k = REPEAT_WINDOW
    windows = F.transform(F.sequence(F.lit(1), F.size("words") - (k - 1)), lambda i: F.xxhash64(F.slice("words", i, k)))
    df = df.withColumn("hashes", F.when(F.size("words") >= k, windows).otherwise(F.array().cast("array<long>")))
    # most texts repeat no window; only those that do sort theirs
    at = F.sequence(F.lit(0), F.size("hashes") - 1)
    pairs = F.array_sort(F.zip_with("hashes", at, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("pairs", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), pairs))

    def repeated(i: Column) -> Column:
        here = F.get("pairs", i)
        return F.when(here["h"].eqNullSafe(F.get("pairs", i - 1)["h"]) | here["h"].eqNullSafe(F.get("pairs", i + 1)["h"]), here["i"])

    starts = F.array_sort(F.array_compact(F.transform(F.sequence(F.lit(0), F.size("pairs") - 1), repeated)))
    df = df.withColumn("starts", F.when(F.col("pairs").isNotNull(), starts)).drop("pairs", "hashes")
    # consecutive starts overlap: each adds the words up to the next one, the last all of its own
    steps = F.zip_with("starts", F.slice("starts", 2, F.size("starts")), lambda a, b: F.least(F.coalesce(b, a + k) - a, F.lit(k)))
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda x, y: x + y)
    without = lambda pattern: F.char_length("text") - F.char_length(F.regexp_replace("text", pattern, ""))
    return df.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        without(_SYMBOLS + "+").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.size("starts") > 0, total), F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        without(r"\p{Lu}+").cast("long").alias("n_upper"),
        without(r"[!?]+").cast("long").alias("n_exclaims"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.size(F.filter("words", lambda w: w.rlike(r"^[\p{L}\p{N}]+(['’-][\p{L}\p{N}]+)*[.,;:]?$"))).cast("long").alias("n_plain"),
    )


def votes() -> list[Column]:
    """The rules' votes on figures.

    Defects speak against a text, and their absence says nothing; length, plain words and
    lines of prose can speak for one.
    """
    n = F.greatest("n_words", F.lit(1))
    per_word = lambda c: F.col(c) / n
    width, lines = per_word("word_chars"), F.greatest("n_lines", F.lit(1))
    against = lambda bad: F.when(bad, -1).otherwise(0)
    either = lambda good, bad: F.when(bad, -1).when(good, 1).otherwise(0)
    return [
        either(F.col("n_words") >= 50, F.col("n_words") < 20),
        either(per_word("n_plain") >= 0.9, per_word("n_plain") < 0.6),
        either((F.col("n_repeat_words") == 0) & (F.col("n_words") >= 50), per_word("n_repeat_words") > 0.3),
        against(per_word("n_symbols") > 0.1),
        against(F.col("n_dup_lines") / lines > 0.3),
        against(~width.between(2, 12)),
        against(F.col("n_upper") / F.greatest("word_chars", F.lit(1)) > 0.4),
        against(per_word("n_exclaims") > 0.3),
        against((F.col("n_words") >= 30) & (per_word("n_distinct") < 0.2) & (F.col("n_words") < 1000)),
    ]


def _fitted(rules: int, rounds: int) -> Column:
    """Expectation-maximisation over ``ps``, an array of (votes, n): quality of each pattern.

    The state ``ws`` is the probability of good per pattern; it starts from the
    balance of votes. A round takes from it, per rule, how often good and bad documents get each vote
    (an abstention is a vote of 0; one made-up document per vote keeps all possible) and the
    share of good ones, and from these the probabilities anew.
    """

    def total(condition: str, weight: str) -> str:
        each = f"zip_with(ps, ws, (p, w) -> if({condition}, p.n * {weight}, 0D))"
        return f"aggregate({each}, 0D, (x, y) -> x + y)"

    shares = {
        name: f"transform(sequence(-1, 1), k -> (1 + {total('p.votes[j] = k', weight)}) / (3 + {total('true', weight)}))"
        for name, weight in (("good", "w"), ("bad", "(1 - w)"))
    }
    found = f"""named_struct(
        'odds', ln((1 + {total('true', 'w')}) / (1 + {total('true', '(1 - w)')})),
        'rules', transform(sequence(0, {rules - 1}), j -> named_struct('good', {shares['good']}, 'bad', {shares['bad']})))"""
    score = """s.odds + aggregate(
        zip_with(p.votes, s.rules, (v, r) -> ln(r.good[v + 1] / r.bad[v + 1])), 0D, (x, y) -> x + y)"""
    following = f"element_at(transform(array({found}), s -> transform(ps, p -> 1 / (1 + exp(-({score}))))), 1)"
    # to begin with, a vote against weighs three votes for: few texts have defects by chance
    start = "transform(ps, p -> 1 / (1 + exp(-aggregate(p.votes, 0D, (x, v) -> x + if(v < 0, -1.5D, 0.5D * v)))))"
    return F.expr(f"aggregate(sequence(1, {rounds}), {start}, (ws, i) -> {following})")


def posteriors(votes_table: DataFrame, rules: int, rounds: int = ROUNDS) -> DataFrame:
    """votes and the probability that a document with these votes is good."""
    counted = votes_table.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    # at most 3 ** rules patterns, sorted so that sums do not depend on the order of arrival
    gathered = counted.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("ps"))
    fitted = gathered.select(F.col("ps.votes").alias("votes"), _fitted(rules, rounds).alias("quality"))
    return fitted.select(F.explode(F.arrays_zip("votes", "quality")).alias("x")).select("x.votes", "x.quality")


def judge(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per document: doc_id, figures, votes, base_failed, quality (posterior) and kept."""
    rules = votes()
    table = saved(figures(docs).withColumn("votes", F.array(*rules)), "quality-votes")
    known = F.broadcast(posteriors(table, len(rules), rounds))  # at most 3 ** rules rows
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        table.join(known, "votes", "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
    )
