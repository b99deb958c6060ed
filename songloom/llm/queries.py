"""Registered queries of this package: ``opN_<name>`` over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songloom.llm import (
    credentials, hard_negatives, jaccard, licences, mixing, nearest, periods, sharding, supervision, token_files, toxicity, warc, winnowing,
)
from songloom.session import load

#: Rows per Arrow batch, so that a batch of very long texts stays small.
ARROW_ROWS = 100


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return load(spark, sf_dir, name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded into grammar-compressed frames and read back from them."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return token_files.round_trip(_table(spark, sf_dir, "documents"), vocabulary).drop("ids")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives and read back through their index."""
    return warc.round_trip(_table(spark, sf_dir, "pages")).drop("payload")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents by a factorization machine."""
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets, and weak parts of credentials where complementary parts meet."""
    found = credentials.scan(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(credentials.listed("strong"), 256).alias("base_sha256"),
        credentials.listed("spans").alias("spans"),
    )


def op5_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules that vote, weighed by their estimated accuracies."""
    return supervision.judge(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("quality", 6).alias("quality"),
    )


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices by a trained paragraph classifier, confirmed by templates."""
    return licences.scan(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_notices", F.array_join("families", ",").alias("families"), F.round("probability", 4).alias("probability")
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in documents by winnowed fingerprints, and the contamination rule."""
    docs, benchmark = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return winnowing.contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight contiguous shards of groups of equal texts, the largest as small as possible."""
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all tokens, by weights of domains and languages, as prefixes of seeded epochs."""
    return mixing.mixture(_table(spark, sf_dir, "documents")).select(
        "doc_id", "domain", "lang", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_epoch").alias("epoch"),
        F.round("mix_budget", 3).alias("leaf_budget"), F.col("mix_before").alias("tokens_before"),
    )


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicate documents and each document's number of links."""
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents")).drop("key", "class_key")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels that score nearly as high as an anchor's positives."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved)


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows found of every hundredth vector."""
    return nearest.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, some of which are given a periodic end."""
    found = periods.periodic_runs(_table(spark, sf_dir, "documents"), rewrite=periods.planted)
    best = periods.longest("runs")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), "runs", "collapsed").select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(periods.listed("runs"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_warc": op2_warc,
    "op3_toxicity": op3_toxicity,
    "op4_credentials": op4_credentials,
    "op5_weak_supervision": op5_weak_supervision,
    "op6_licences": op6_licences,
    "op7_decontamination": op7_decontamination,
    "op8_sharding": op8_sharding,
    "op9_mixing": op9_mixing,
    "op10_jaccard": op10_jaccard,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_nearest": op12_nearest,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE: dict[str, str] = {
    "op2_warc": warc.ROUND_TRIP_SQL,
    "op7_decontamination": winnowing.CONTAMINATION_SQL.format(documents="documents"),
    "op11_hard_negatives": hard_negatives.MINE_SQL.format(embeddings="embeddings"),
}
