import os

import corpus_pipeline as pipeline
from cases import no_docs, odd_docs
from pyspark.sql import functions as F

from songloom.llm import jaccard, toxicity, winnowing
from songloom.llm.tables import saved


def test_stages_follow_each_other_and_take_effect(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, data_dir), f"test-{name}")
        assert docs.columns == columns
        if name == "toxicity":
            assert 0.7 * before < docs.count() <= before
        elif name == "near_duplicates":
            found = jaccard.near_duplicates(docs)
            assert found.agg(F.max("n_links"), F.max("n_copies")).first() == (0, 0)
        elif name == "decontamination":
            benchmark = spark.read.parquet(f"{data_dir}/benchmark.parquet")
            assert winnowing.contamination(docs, benchmark).filter("contaminated").count() == 0
    last = pipeline.STAGES[-1][1](spark, docs, data_dir)
    assert last.count() == docs.count() and last.select("shard").distinct().count() == 8


def test_toxic_documents_go_and_the_columns_stay(spark, data_dir):
    folder = os.path.join(os.path.dirname(data_dir), "sf0.01")  # the smallest with enough labels
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    left = toxicity.harmless(docs.withColumn("score", F.lit(1)), labels)
    assert left.columns == [*docs.columns, "score"]
    marked = labels.join(left, "doc_id", "left_semi").groupBy("toxic").count().collect()
    kept = {r["toxic"]: r["count"] for r in marked}
    total = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    assert kept[0] == total[0] and kept.get(1, 0) < 0.5 * total[1]


def test_stages_stand_odd_and_empty_tables(spark, data_dir):
    """Nulls, repeats, long texts, and columns that are called what a stage may call its own."""
    odd = odd_docs(spark).withColumn("domain", F.col("doc_id") * 10)
    for name, stage in pipeline.STAGES:
        left = stage(spark, odd, data_dir)
        if name != "sharding":
            assert left.columns == odd.columns
            assert left.filter("domain <> doc_id * 10 and doc_id is not null").isEmpty() and left.filter("domain is not null").count() > 3
        else:
            assert left.count() == odd.count()
        assert stage(spark, no_docs(spark), data_dir).collect() == []


def test_an_empty_corpus_goes_through(spark, data_dir, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{data_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{data_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
