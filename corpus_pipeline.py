"""A training corpus in five stages: harmless, without near copies, clean of benchmarks, mixed, sharded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in
the shared folder and gives the next stage what is read back. All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songloom.llm import jaccard, mixing, sharding, toxicity, winnowing
from songloom.llm.tables import saved
from songloom.session import load

#: Rows per Arrow batch, so that a batch of very long texts stays small.
ARROW_ROWS = 100


def _documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return docs


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject.

    Null and empty texts get the score of no words; repeated rows are judged alike and all stay or
    go; without documents or labels nothing goes.
    """
    return toxicity.harmless(_documents(spark, docs), load(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates.

    Equal texts, null and empty ones among them, are one class each, so of repeated rows one stays;
    an empty table stays empty.
    """
    return jaccard.one_per_class(_documents(spark, docs))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates.

    Null and empty texts have no words and stay; repeated rows are judged alike; an empty table, or
    one of items, removes nothing.
    """
    return winnowing.clean(_documents(spark, docs), load(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, dealt to domains, languages and sources by weight.

    A document comes once for each epoch that draws it. Null languages and sources are values of
    their own; texts without tokens cost nothing; repeated rows are drawn each; an empty table
    gives no rows. The domain follows from the source, and a column of that name stays as it is.
    """
    return mixing.drawn_rows(_documents(spark, docs), mixing.mixture(docs, share=1.0), ["lang", "source"])


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document drawn.

    Null texts are of size 1; equal texts and repeated rows share a shard; an empty table gives no rows.
    """
    return sharding.shard_documents(_documents(spark, docs), 8)


STAGES = [
    ("toxicity", harmless),
    ("near_duplicates", distinct),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The first two stages (a trained model, pruned similarity joins) have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
