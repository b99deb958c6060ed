"""Sinks for segments, votes and requests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

SEGMENT = [
    "videoKey", "videoUrl", "songTitle", "trackName", "artistName", "filterMode",
    "seconds", "startedAt", "endedAt",
]
VOTE = ["videoKey", "videoUrl", "songTitle", "trackName", "artistName", "filterMode", "vote", "rating", "comment"]
REQUEST = [
    "videoKey", "videoUrl", "trackName", "artistName", "songTitle", "duration", "syncedLyrics", "plainLyrics",
]


def segment_records(segments: DataFrame, user: str = "user", version: str = "0.1.0") -> DataFrame:
    """The record of a closed segment, with its day as partition column."""
    return segments.select(
        user, *SEGMENT, F.lit(version).alias("extensionVersion"), F.to_date("endedAt").alias("day")
    )


def write_segments(segments: DataFrame, path: str, checkpoint: str, user: str = "user") -> StreamingQuery:
    """Append a stream of closed segments, partitioned by day, exactly once."""
    return (
        segment_records(segments, user)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("day")
        .trigger(availableNow=True)
        .start()
    )


def keyed_batches(path: str, source: str, user: str = "user") -> Callable[[DataFrame, int], None]:
    """What a micro-batch of closed segments adds to the table at ``path``.

    A batch has a folder of its own, named after its ``source`` (a checkpoint) and number, so a
    replayed batch replaces itself. The segments of all other batches are the ledger: one that is
    there already, by (user, videoKey, startedAt), is not added again, so neither is what a query
    started anew from the beginning repeats. Only the days of the batch are looked up.
    """
    keys = ["day", user, "videoKey", "startedAt"]

    def add(batch: DataFrame, number: int) -> None:
        spark, name = batch.sparkSession, f"{source}-{number}"
        records = segment_records(batch, user).persist()  # a stateful stream must not be run twice
        try:
            spark.createDataFrame([], records.drop("day").schema).write.mode("ignore").parquet(f"{path}/batch=none/day=1970-01-01")
            days = records.agg(F.min("day").alias("low"), F.max("day").alias("high")).first()
            stored = spark.read.schema(T.StructType([*records.drop("day").schema, T.StructField("batch", T.StringType()), records.schema["day"]]))
            ledger = stored.parquet(path).filter((F.col("batch") != name) & F.col("day").between(days["low"], days["high"]))
            fresh = records.dropDuplicates(keys).join(ledger.select(keys), keys, "left_anti")
            fresh.select(records.columns).write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={name}")
        finally:
            records.unpersist()

    return add


def write_keyed_segments(segments: DataFrame, path: str, checkpoint: str, user: str = "user") -> StreamingQuery:
    """Add a stream of closed segments, each once, whatever is replayed or started anew."""
    source = hashlib.sha1(checkpoint.encode()).hexdigest()[:12]
    return (
        segments.writeStream.foreachBatch(keyed_batches(path, source, user))
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def append_segments(segments: DataFrame, path: str, batch: str | None = None, user: str = "user") -> str:
    """S10 in batch: add a batch under its id, in a folder of its own; returns the id.

    Writing a batch again replaces that batch and nothing else. Without an id it is taken from
    the records, so a repeated run changes nothing, and other batches of the same days stay.
    """
    records = segment_records(segments, user)
    if batch is None:
        seen = records.select(F.xxhash64(F.to_json(F.struct(*records.columns))).alias("h"))
        told = seen.agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.pmod("h", F.lit(1 << 31))).alias("s")).first()
        batch = "-".join(str(v or 0) for v in told)
    records.write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={batch}")
    return batch


def vote_records(votes: DataFrame) -> DataFrame:
    """Keyed votes with the star rating that goes with them."""
    keyed = votes.filter(F.coalesce("videoKey", F.lit("")) != "").filter(F.col("vote").isin("like", "dislike"))
    return keyed.withColumn("rating", F.when(F.col("vote") == "like", 5).otherwise(1)).select(VOTE)


def write_votes(votes: DataFrame, path: str) -> None:
    """Append vote records."""
    vote_records(votes).write.mode("append").parquet(path)


def outcome_reason(status: Column, body_reason: Column, key: Column) -> Column:
    """Reason code of a request's answer."""
    return (
        F.when(F.coalesce(key, F.lit("")) == "", "upstream")
        .when(status == 201, "queued")
        .when(status == 401, "unauthenticated")
        .otherwise(F.coalesce(F.nullif(body_reason, F.lit("")), F.lit("upstream")))
    )


def request_records(requests: DataFrame) -> DataFrame:
    """The request record; empty lyrics and unknown lengths become null."""

    def filled(c: str) -> Column:
        return F.nullif(F.col(c), F.lit("")).alias(c)

    duration = F.when(F.col("duration") > 0, F.col("duration")).alias("duration")
    return requests.select(*(duration if c == "duration" else filled(c) for c in REQUEST))


def write_sync_requests(requests: DataFrame, path: str) -> None:
    """Append request records."""
    request_records(requests).write.mode("append").parquet(path)


def request_outcomes(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Outcome per request from a table of answers ``[videoKey, status, reason]``.

    Of several answers to a key the newest counts (by ``ts`` and ``ord``, as far as they are
    given, then by value).
    """
    answer = F.struct("status", "reason")
    newest = F.max_by(answer, F.struct(*[c for c in ("ts", "ord") if c in responses.columns], "status", "reason"))
    last = responses.groupBy("videoKey").agg(newest.alias("_a")).select("videoKey", "_a.*")
    answered = requests.select("videoKey").distinct().join(last, "videoKey", "left")
    reason = outcome_reason(F.col("status"), F.col("reason"), F.col("videoKey"))
    return answered.select("videoKey", reason.alias("reason"))
