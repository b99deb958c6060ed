import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from songloom.operators import feedback as fb
from songloom.operators import playlists as pl
from songloom.operators import usage as us
from songloom.sources import sinks
from songloom.streaming import jobs

from test_playlists import LOG, random_log as random_mutations
from test_usage import EVENTS, T0, random_log

#: A row far after the log, per key, so that the watermark passes everything else.
END = T0 + timedelta(days=400)


def as_stream(spark, tmp_path, df, batches=3):
    """Write ``df`` as a few files in shuffled order and read them as a stream."""
    path = str(tmp_path / "in")
    df.repartition(batches).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("silence", [None, 600])
def test_segments_stream_equals_batch(spark, tmp_path, silence):
    rng = random.Random(4)
    rows = [r for u in ("u1", "u2") for r in random_log(u, rng, 100)]
    rows += [(u, END, 10_000, "stop", None, None, None) for u in ("u1", "u2", "u3")]
    df = spark.createDataFrame(rows, EVENTS)
    # One watermark for all files: the rows of a later file must not count as late.
    out = jobs.run_available(jobs.listen_segments(as_stream(spark, tmp_path, df, 1), silence_seconds=silence, delay="1 second"))
    batch = us.listen_segments(df, silence_seconds=silence, slice_seconds=900)
    closed = F.col("endedAt") < F.lit(END)
    want = sorted(str(tuple(r)) for r in batch.filter(closed).select(out.columns).collect())
    got = sorted(str(tuple(r)) for r in out.filter(closed).collect())
    assert got == want and len(want) > 8


def run(spark, tmp_path, rows, schema, job):
    data = [(k, T0 + timedelta(milliseconds=ms), i, *rest) for i, (k, ms, *rest) in enumerate(rows)]
    data += [("zz", END, 99, *[None] * len(rows[0][2:]))]
    df = spark.createDataFrame(data, "k string, ts timestamp, ord long, " + schema)
    out = jobs.run_available(job(as_stream(spark, tmp_path, df, 1)))
    return [tuple(r) for r in out.filter("k <> 'zz'").collect()]


def ms(ts):
    return round((ts - T0.replace(tzinfo=None)).total_seconds() * 1000)


def test_small_machines(spark, tmp_path):
    rows = [("a", 0, "x"), ("a", 100, "x"), ("a", 2000, "y"), ("b", 50, "x"), ("a", 5000, "y")]
    got = run(spark, tmp_path, rows, "v string", lambda s: jobs.distinct_until_changed(s, "k", "v"))
    assert sorted((k, ms(t), v) for k, t, v in got) == [("a", 0, "x"), ("a", 2000, "y"), ("b", 50, "x")]
    got = run(spark, tmp_path, rows, "v string", lambda s: jobs.debounce(s, "k", "v"))
    assert sorted((k, ms(t)) for k, t, _ in got) == [("a", 100), ("a", 2000), ("a", 5000), ("b", 50)]
    got = run(spark, tmp_path, rows, "position string", lambda s: jobs.pause_detection(s, "k"))
    assert sorted((k, ms(t), p) for k, t, _, p in got) == [
        ("a", 0, False), ("a", 100, False), ("a", 2000, False), ("a", 5000, True), ("b", 50, False)]


def test_more_machines(spark, tmp_path):
    rows = [("a", 0, 2, "old"), ("a", 9, 3, "new"), ("a", 10, 2, "late"), ("a", 11, 3, "same")]
    got = run(spark, tmp_path, rows, "generation long, value string", lambda s: jobs.drop_stale(s, "k"))
    assert sorted(r[3] for r in got) == ["new", "old", "same"]
    rows = [("a", 0, None), ("a", 1, "miss"), ("a", 2, None), ("a", 600_001, None), ("b", 0, "already_synced"), ("b", 9, None),
            ("c", 0, "upstream"), ("c", 1, None), ("d", 0, "miss"), ("d", 1, "refresh"), ("d", 2, None)]
    got = run(spark, tmp_path, rows, "reason string", lambda s: jobs.unsuppressed(s, "k"))
    assert sorted((k, ms(t)) for k, t in got) == [("a", 0), ("a", 600_001), ("c", 1), ("d", 2)]
    rows = [("r", 0, "add", "s1"), ("r", 1, "add", "s2"), ("r", 2, "next", None), ("r", 3, "end", None), ("r", 4, "add", "s3")]
    got = run(spark, tmp_path, rows, "kind string, song string", lambda s: jobs.queue_depth(s, "k"))
    assert sorted((ms(t), d, n) for _, t, d, n in got) == [(0, 1, "s1"), (1, 2, "s1"), (2, 1, "s2"), (3, 0, None)]
    rows = [("v", 0, 0.1, "a"), ("v", 1, 0.4, "a"), ("v", 2, 0.8, ""), ("v", 3, 2.0, "b")]
    got = run(spark, tmp_path, rows, "time double, text string", lambda s: jobs.caption_capture(s, "k"))
    assert sorted(r[1:] for r in got) == [(0.0, "a"), (1.7, "b")]
    got = run(spark, tmp_path, [("a", 0, 1), ("a", 5, 2), ("b", 9, 3)], "v int", lambda s: jobs.once_per_key(s, "k"))
    assert sorted(r[0] for r in got) == ["a", "b"]


def test_playlist_stream_equals_batch(spark, tmp_path):
    rows = random_mutations("u", random.Random(2), 80)
    log = spark.createDataFrame(rows, LOG)
    _, _, outcomes = pl.apply_mutations(log, 3, 4)
    want = sorted((r["seq"], r["ok"], r["result"]) for r in outcomes.collect())
    timed_log = log.withColumns({"ts": F.timestamp_seconds(F.col("seq") + 1_700_000_000), "ord": F.col("seq")}).drop("seq")
    end = timed_log.limit(1).withColumns({"user": F.lit("zz"), "ts": F.lit(END)})
    stream = as_stream(spark, tmp_path, timed_log.union(end), 1)
    out = jobs.run_available(jobs.apply_mutations(stream, max_lists=3, max_items=4)).filter("user = 'u'")
    got = sorted((int(r["s"]), r["ok"], r["result"]) for r in out.select(F.unix_seconds("ts").alias("s"), "ok", "result").collect())
    assert [(s - 1_700_000_000, o, r) for s, o, r in got] == want


def test_identity_guard_stream(spark, tmp_path):
    lyrics = spark.createDataFrame([("t", "a", T0 + timedelta(seconds=10), 1), ("t", "b", T0 + timedelta(seconds=11), 2)], "tab string, key string, ts timestamp, id int")
    ticks = spark.createDataFrame([("t", "a", T0 + timedelta(seconds=5)), ("t", "c", END)], "tab string, key string, ts timestamp")
    left, right = (as_stream(spark, tmp_path / n, d, 1) for n, d in (("l", lyrics), ("r", ticks)))
    out = jobs.run_available(jobs.song_identity_guard(left, right))
    assert [r["id"] for r in out.collect()] == [1]


@pytest.mark.parametrize("seed", [5, 6])
def test_outcome_stream_equals_batch_and_forgets(spark, tmp_path, seed):
    """Random logs over several micro-batches; what has expired leaves the state store."""
    rng, rows = random.Random(seed), []
    kinds = [None, None, None, "queued", "rate_limited", "upstream", "recently_failed", "already_synced"]
    for i in range(600):
        # batch after batch a year goes by; an outcome of the same instant comes before the request
        rows.append((f"k{rng.randrange(12)}", T0 + timedelta(hours=12 * i, minutes=rng.randrange(600)), i, rng.choice(kinds)))
    df = spark.createDataFrame(rows, "k string, ts timestamp, ord long, reason string")
    want = fb.unrequested(df.filter("reason is null").drop("reason"), df.filter("reason is not null"), "k")
    src = str(tmp_path / "in")
    for i in range(0, 600, 150):
        df.filter(F.col("ord").between(i, i + 149)).coalesce(1).write.mode("append").parquet(src)
    # outcomes last a month, so a year after the log only those without end are remembered
    ends = [("zz", END + timedelta(days=400 * i), 9, None) for i in (0, 1)]
    for end in ends:
        spark.createDataFrame([end], df.schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = jobs.run_available(jobs.unsuppressed(stream, "k", "1 day"), str(tmp_path / "run"))
    got = sorted((r["k"], r["ts"]) for r in out.filter("k <> 'zz'").collect())
    assert got == sorted((r["k"], r["ts"]) for r in want.collect()) and len(got) > 50
    left = spark.read.format("statestore").option("stateVarName", "state").load(str(tmp_path / "run" / "checkpoint")).collect()
    held = {r["key"]["k"]: r["value"]["json"] for r in left}
    last = {k: reason for k, _, _, reason in rows if reason not in (None, "upstream")}
    assert set(held) - {"zz"} == {k for k, reason in last.items() if reason == "already_synced"}


def test_segments_stream_over_batches_with_ends(spark, tmp_path):
    """Files in time order, one a batch; the end of input closes what is open, so the stream is whole."""
    rng = random.Random(8)
    rows = [r for u in ("u1", "u2", "u3") for r in random_log(u, rng, 400)]
    df = spark.createDataFrame(rows, EVENTS)
    path = str(tmp_path / "in")
    cuts = sorted(r[1] for r in rows)[::300] + [END]
    for low, high in zip(cuts, cuts[1:]):
        df.filter((F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(high))).coalesce(1).write.mode("append").parquet(path)
    stream, ends = jobs.with_end(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path))
    out = jobs.run_available(jobs.listen_segments(stream), then=lambda: jobs.end_markers(df).write.mode("append").parquet(ends))
    want = sorted(str(tuple(r)) for r in us.listen_segments(df, slice_seconds=900).select(out.columns).collect())
    assert sorted(str(tuple(r)) for r in out.collect()) == want and len(want) > 100


def test_more_rows_wait_than_a_chunk_holds(spark, tmp_path):
    rows = [("a", 10 * i, str(i // 7)) for i in range(3000)]
    random.Random(1).shuffle(rows)
    got = run(spark, tmp_path, rows, "v string", lambda s: jobs.distinct_until_changed(s, "k", "v"))
    assert sorted((ms(t), v) for _, t, v in got) == [(70 * i, str(i)) for i in range(429)]


def test_keyed_sink_adds_every_segment_once(spark, tmp_path):
    rng = random.Random(3)
    df = spark.createDataFrame([r for u in ("u1", "u2") for r in random_log(u, rng, 120)], EVENTS)
    segments = us.listen_segments(df, slice_seconds=900)
    path, src = str(tmp_path / "table"), str(tmp_path / "in")
    parts = segments.withColumn("part", F.pmod(F.xxhash64("startedAt"), F.lit(3))).cache()
    for i in range(3):
        parts.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(src)
    parts.filter("part = 1").drop("part").coalesce(1).write.mode("append").parquet(src)  # told twice

    def stream():
        return spark.readStream.schema(segments.schema).option("maxFilesPerTrigger", 1).parquet(src)

    def stored():
        table = spark.read.parquet(path)
        return sorted(str(tuple(r)) for r in table.select(*sinks.SEGMENT).collect())

    want = sorted(str(tuple(r)) for r in segments.select(*sinks.SEGMENT).collect())
    sinks.write_keyed_segments(stream(), path, str(tmp_path / "c1")).awaitTermination()
    assert stored() == want and len(want) > 10
    add = sinks.keyed_batches(path, "other")
    for _ in range(2):  # a replayed batch
        add(parts.filter("part = 0").drop("part"), 7)
        assert stored() == want
    sinks.write_keyed_segments(stream(), path, str(tmp_path / "c2")).awaitTermination()  # started anew
    assert stored() == want
    late = segments.limit(1).withColumn("startedAt", F.col("startedAt") - F.expr("INTERVAL 1 second"))
    add(late, 8)
    add(late, 8)
    assert len(stored()) == len(want) + 1


def test_segments_stream_reads_folders_of_part_files(spark, data_dir, tmp_path):
    from songloom.plans.queries import segments_stream

    events = spark.read.parquet(f"{data_dir}/events.parquet")
    latest_first = events.repartitionByRange(3, F.col("ts").desc())
    latest_first.write.parquet(f"{tmp_path}/events.parquet")
    whole, parts = (sorted(map(repr, segments_stream(spark, d).collect())) for d in (data_dir, str(tmp_path)))
    assert parts == whole and whole
