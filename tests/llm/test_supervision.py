import re
from collections import Counter

from cases import DOCS, no_docs, odd_docs, prose
from pyspark.sql import functions as F

from songloom.llm import supervision as s


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
        n < 20 or 100 * len(covered) > 30 * n,
    )


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_figures_against_brute_force(spark):
    texts = [
        "a b c d e f g h " * 3, "x " * 30, prose(50) + "\n" + prose(50), "l1\nl1\n \n \nl1\nl2\n", "# * | a<b> $5 %&", prose(20) * 2,
        "a b c d e f g h i a b c d e f g h", "a\x0bb\x0cc d  e", "w " * 7, "w " * 9, None, "", prose(3000, 4) + " " + prose(3000, 4),
    ]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: tuple(r[f] for f in FIELDS) for r in s.judge(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_estimation_finds_bad_rules_and_good_documents(spark):
    """Four rules are mostly right, one is noise: the posterior follows the four."""
    rows, truth = [], []
    state = 12345
    def chance():
        nonlocal state
        state = (state * 1103515245 + 12345) % 2**31
        return state / 2**31
    for _ in range(3000):
        good = chance() < 0.7
        votes = [(1 if good == (chance() < accuracy) else -1) if chance() < 0.8 else 0 for accuracy in (0.9, 0.85, 0.8, 0.8, 0.5)]
        rows.append((votes, good))
    df = spark.createDataFrame(rows, "votes array<int>, good boolean")
    quality = {tuple(r["votes"]): r["quality"] for r in s.posteriors(df.select("votes"), 5).collect()}
    right = sum((quality[tuple(v)] >= 0.5) == g for v, g in rows) / len(rows)
    assert right > 0.88
    assert abs(quality.get((0, 0, 0, 0, 1), 0.7) - quality.get((0, 0, 0, 0, -1), 0.7)) < 0.15
    again = {tuple(r["votes"]): r["quality"] for r in s.posteriors(df.repartition(7).select("votes"), 5).collect()}
    assert again == quality


def test_verdict_agrees_with_quality_labels(spark, data_dir):
    docs, labels = (spark.read.parquet(f"{data_dir}/{n}.parquet") for n in ("documents", "labels"))
    rows = s.judge(docs).withColumnRenamed("quality", "post").join(labels, "doc_id").filter("not base_failed").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in rows) >= 0.95 * len(rows)


def test_no_python_in_the_plan_odd_rows_and_empty_table(spark):
    got = s.judge(odd_docs(spark))
    assert got.count() == 13
    assert not any(r["kept"] for r in got.filter("doc_id in (3, 4, 5, 6)").collect())
    plan = s.figures(odd_docs(spark)).select(F.col("n_words"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert s.judge(no_docs(spark)).collect() == []
