"""Small inputs with everything an operator has to stand."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n, seed=0):
    return " ".join(WORDS[(i * i + seed * 7 + i // 3) % len(WORDS)] + str((i * 31 + seed) % 97) for i in range(n))


def odd_docs(spark, clash=True):
    """Nulls, empty, blank and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, prose(60, 1)), (2, prose(60, 1)), (2, prose(60, 1)), (3, None), (4, ""), (5, "   \n\t "), (6, "one"),
        (None, prose(40, 2)), (7, prose(30_000, 3)), (8, "naïve Ünïcode 中文 \U0001f600 ʼn"), (9, None), (None, None),
        (10, prose(60, 1) + " more"),
    ]
    df = spark.createDataFrame([(i, t, None if i == 3 else "en", None if i == 4 else "src0", None) for i, t in rows], DOCS)
    if clash:
        names = ["key", "words", "pos", "size", "row", "value", "start", "label", "score", "count", "prints", "first", "number"]
        df = df.withColumns({n: F.lit("x") for n in names})
    return df


def no_docs(spark):
    return spark.createDataFrame([], DOCS)
