import json

from pyspark.sql import functions as F

from songloom.operators import evaluate as ev
from songloom.operators.candidates import parse_titles
from songloom.sources import catalog as ct
from songloom.sources import sinks


def test_corpus_and_quality(spark, tmp_path):
    rows = [{"rawTitle": "Adele - Hello (Official Music Video)", "trueArtist": "Adele", "trueTrack": "Hello", "approxDurationSec": 295},
            {"rawTitle": "Halo", "trueArtist": "Beyoncé", "trueTrack": "Halo", "altArtists": ["Queen B"], "authorHint": "Beyoncé - Topic"},
            {"rawTitle": "Something else", "trueArtist": "Muse", "trueTrack": "Starlight"}]
    (tmp_path / "corpus.json").write_text(json.dumps(rows))
    corpus = ct.read_eval_corpus(spark, str(tmp_path / "corpus.json")).withColumn("title_id", F.monotonically_increasing_id())
    assert [(r["authorHint"], r["metaTrack"], r["altArtists"]) for r in corpus.orderBy("title_id").collect()] == [
        ("", "", []), ("Beyoncé - Topic", "", ["Queen B"]), ("", "", [])]
    parsed = parse_titles(corpus, "rawTitle", "metaTrack", "metaArtist", "authorHint")
    summary = ev.candidate_summary(ev.candidate_quality(parsed)).first()
    assert (summary["titles"], summary["pairs"], summary["tracks"], summary["passed"]) == (3, 2, 2, False)
    results = corpus.filter("trueTrack <> 'Starlight'").select(
        "title_id", F.when(F.col("trueTrack") == "Halo", "Queen B").otherwise("Lionel Richie").alias("artistName"),
        F.col("trueTrack").alias("trackName"), F.lit(True).alias("synced"))
    total = ev.quality_summary(ev.match_quality(results, corpus, alternates="altArtists")).first()
    assert tuple(total) == (3, 1, 1, 33)


def test_catalog_and_stream_sink(spark, tmp_path):
    (tmp_path / "cat.json").write_text(json.dumps([{"trackName": "a", "artistName": "b", "extra": {"tier": "gold"}}]))
    assert ct.read_catalog(spark, str(tmp_path / "cat.json"), "json").first()["extra"]["tier"] == "gold"
    columns = {c: F.lit("x") for c in ("videoUrl", "songTitle", "trackName", "artistName", "filterMode")}
    segments = spark.range(3).select(
        F.lit("u").alias("user"), F.lit("k").alias("videoKey"), *(v.alias(k) for k, v in columns.items()),
        F.lit(5).alias("seconds"), F.timestamp_seconds("id").alias("startedAt"), F.timestamp_seconds(F.col("id") + 5).alias("endedAt"))
    segments.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(segments.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the checkpoint keeps a second run from writing again
        sinks.write_segments(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    requests = spark.createDataFrame([("yt:a", "", -1.0)], "videoKey string, plainLyrics string, duration double")
    for c in ("videoUrl", "trackName", "artistName", "songTitle", "syncedLyrics"):
        requests = requests.withColumn(c, F.lit("v"))
    sinks.write_sync_requests(requests, str(tmp_path / "req"))
    row = spark.read.parquet(str(tmp_path / "req")).first()
    assert row["plainLyrics"] is None and row["duration"] is None and row["trackName"] == "v"
