"""Streaming operators over event streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import derive_video_key, url_parts
from ..session import ROCKSDB_PROVIDER, shared_dir
from . import machines as m
from .ordered import run_machine

DELAY = "10 minutes"


def listen_segments(events: DataFrame, user: str = "user", silence_seconds: float | None = None, delay: str = DELAY) -> DataFrame:
    """Segments as they close."""
    place = url_parts("url")
    ready = events.select(
        user, "ts", "ord", "kind", "url", "mode", "song",
        F.when(F.col("url").isNotNull(), derive_video_key("url")).alias("url_key"),
        F.concat_ws("", place["scheme"], F.lit("://"), place["host"], F.lit(":"), place["port"], place["path"]).alias("path"),
        F.when(F.col("song.videoUrl").isNotNull(), derive_video_key("song.videoUrl")).alias("song_key"),
    )
    out = run_machine(ready, user, m.SegmentMachine(silence_seconds), m.SEGMENT_OUTPUT, delay)
    return out.withColumns({c: F.timestamp_micros(c) for c in ("startedAt", "endedAt")})


def distinct_until_changed(events: DataFrame, key: str, value: str, delay: str = DELAY) -> DataFrame:
    """Changes of a value per key."""
    ready = events.select(key, "ts", "ord", F.col(value).cast("string").alias("value"))
    out = run_machine(ready, key, m.ChangeMachine(), "ts bigint, value string", delay)
    return out.withColumn("ts", F.timestamp_micros("ts"))


def debounce(events: DataFrame, key: str, value: str, gap: str = "400 milliseconds", delay: str = DELAY) -> DataFrame:
    """T4: the last event of each burst; a session window whose gap is the delay."""
    burst = F.session_window("ts", gap)
    last = F.max_by(F.struct("ts", value), F.struct("ts", "ord")).alias("e")
    out = events.withWatermark("ts", delay).groupBy(key, burst).agg(last)
    return out.select(key, "e.ts", f"e.{value}")


def drop_stale(results: DataFrame, key: str, delay: str = DELAY) -> DataFrame:
    """T5: ``[key, ts, generation, value]`` of results that are not outdated on arrival."""
    out = run_machine(
        results.select(key, "ts", "ord", "generation", "value"), key, m.GenerationMachine(),
        "ts bigint, generation bigint, value string", delay,
    )
    return out.withColumn("ts", F.timestamp_micros("ts"))


def pause_detection(polls: DataFrame, key: str, stall_ms: int = 1600, delay: str = DELAY) -> DataFrame:
    """``[key, ts, position, paused]``."""
    out = run_machine(
        polls.select(key, "ts", "ord", "position"), key, m.PauseMachine(stall_ms),
        "ts bigint, position string, paused boolean", delay,
    )
    return out.withColumn("ts", F.timestamp_micros("ts"))


def once_per_key(events: DataFrame, key: str, delay: str = DELAY) -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def unsuppressed(requests: DataFrame, key: str, delay: str = DELAY) -> DataFrame:
    """``[key, ts]`` of requests no remembered outcome or miss holds back."""
    out = run_machine(requests.select(key, "ts", "ord", "reason"), key, m.OutcomeMachine(), "ts bigint", delay)
    return out.withColumn("ts", F.timestamp_micros("ts"))


def caption_capture(polls: DataFrame, key: str, delay: str = DELAY) -> DataFrame:
    """``[key, time, text]``, the timeline of polled captions."""
    return run_machine(
        polls.select(key, "ts", "ord", "time", "text"), key, m.CaptionMachine(), "time double, text string", delay
    )


def queue_depth(events: DataFrame, room: str = "room", delay: str = DELAY) -> DataFrame:
    """``[room, ts, depth, now_playing]``."""
    out = run_machine(
        events.select(room, "ts", "ord", "kind", "song"), room, m.QueueMachine(),
        "ts bigint, depth bigint, now_playing string", delay,
    )
    return out.withColumn("ts", F.timestamp_micros("ts"))


def song_identity_guard(lyrics: DataFrame, ticks: DataFrame, tab: str = "tab", within: str = "30 seconds", delay: str = DELAY) -> DataFrame:
    """Lyric results seen together with a tick of the same song in the same tab.

    Both sides are watermarked and the time bound lets Spark drop old state.
    """
    left = lyrics.withWatermark("ts", delay)
    right = ticks.select(
        F.col(tab).alias("_tab"), F.col("key").alias("_key"), F.col("ts").alias("_ts")
    ).withWatermark("_ts", delay)
    on = (
        (F.col(tab) == F.col("_tab"))
        & (F.col("key") == F.col("_key"))
        & (F.col("_ts") >= F.col("ts") - F.expr(f"INTERVAL {within}"))
        & (F.col("_ts") <= F.col("ts"))
    )
    return left.join(right, on, "left_semi")


def apply_mutations(log: DataFrame, user: str = "user", delay: str = DELAY, **caps) -> DataFrame:
    """M1, M2: ``[user, ts, action, ok, result, default_id]``, one row per mutation."""
    ready = log.select(user, "ts", "ord", "action", "list_id", "video_key")
    out = run_machine(
        ready, user, m.PlaylistMachine(**caps),
        "ts bigint, action string, ok boolean, result string, default_id string", delay,
    )
    return out.withColumn("ts", F.timestamp_micros("ts"))


def end_markers(events: DataFrame, user: str = "user", delay: str = DELAY) -> DataFrame:
    """One closing row per key of a finished log, later than all its rows, and one more that
    takes the watermark past them."""
    pause = F.expr(f"INTERVAL {delay}")
    last = events.groupBy(user).agg(F.max("ts").alias("_own"))
    newest = events.agg(F.max("ts").alias("_newest"), F.min(user).alias("_first"))
    placed = last.join(F.broadcast(newest))  # one row
    times = F.array(F.lit(0), F.lit(1))
    spread = placed.withColumn("_i", F.explode(times)).filter((F.col("_i") == 0) | (F.col(user) == F.col("_first")))
    at = F.col("_newest") + pause + F.when(F.col("_i") == 1, pause + pause).otherwise(F.expr("INTERVAL 0 seconds"))
    own = {user, "ts", "ord", "kind"}
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields if f.name not in own]
    row = spread.select(
        F.col(user), at.alias("ts"), F.col("_i").cast(events.schema["ord"].dataType).alias("ord"), F.lit(m.END).alias("kind"), *rest
    )
    return row.select(events.columns)


def with_end(stream: DataFrame) -> tuple[DataFrame, str]:
    """``stream`` and a folder beside it, whose rows are part of the stream once they are written."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/ends-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path)), path


def run_available(stream: DataFrame, path: str | None = None, then: Callable[[], None] | None = None) -> DataFrame:
    """Run a stream over everything available now and read back what it appended.

    ``then`` may add to its sources; the query is started again for that. Output and checkpoint
    live in a fresh folder under the shared one.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    if path is None:
        path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def run() -> None:
        query = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("path", f"{path}/out")
            .option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    run()
    if then:
        then()
        run()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
