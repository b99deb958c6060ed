import math
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from songloom.operators import feedback as fb
from songloom.operators import usage as us
from songloom.sources import sinks

T0 = datetime(2024, 1, 30, 22, tzinfo=timezone.utc)
EVENTS = ("user string, ts timestamp, ord long, kind string, url string, mode string, "
          "song struct<videoKey:string,songTitle:string,trackName:string,artistName:string,videoUrl:string>")


def key_of(url):
    if url is None:
        return None
    head, _, query = url.removeprefix("https://").partition("?")
    return "yt:" + query[2:] if head == "youtube.com/watch" and query else head


def spec(rows, silence):
    """Plain sequential meaning of one user's log: (key, title, mode, start, end)."""
    out, seg, tab, mode, known, last = [], None, None, None, None, None

    def close(end):
        nonlocal seg
        if seg and seg["key"] and math.floor((end - seg["start"]).total_seconds() + .5) >= 3:
            out.append((seg["key"], seg["title"], seg["mode"], seg["url"], seg["start"], end))
        seg = None

    def open_(ts, key, title, place=None):
        nonlocal seg
        if title is None and known and known[0] == key:
            title = known[1]
        seg = {"key": key, "title": title, "mode": mode, "start": ts, "beat": ts, "url": place or tab}

    for _, ts, _, kind, url, m, song in rows:
        if seg and silence is not None and (ts - last).total_seconds() > silence:
            close(seg["beat"])
        last = ts
        if kind == "start":
            if seg:
                close(ts)
            tab, mode = url, m or mode
            open_(ts, key_of(url), None)
        elif kind in ("stop", "close"):
            close(ts)
        elif kind == "navigate" and seg:
            same = tab and url and tab.partition("?")[0] == url.partition("?")[0]
            if not same:
                close(ts)
            else:
                tab = url
                if key_of(url) != seg["key"]:
                    close(ts)
                    open_(ts, key_of(url), None)
        elif kind == "mode":
            mode = m
            if seg:
                title = seg["title"]
                close(ts)
                open_(ts, key_of(tab), title or "")
        elif kind == "song":
            known = song if song[0] else known
            if seg and song[0] and song[0] != seg["key"]:
                close(ts)
                open_(ts, key_of(song[4] or tab), song[1] or "", song[4])
            elif seg:
                seg["title"] = song[1] or seg["title"]
                seg["url"] = song[4] or seg["url"]
        elif kind == "beat" and seg:
            seg["beat"] = ts
    if seg:
        close(seg["beat"])
    return [(k, t or None, *rest) for k, t, *rest in out]


def random_log(user, rng, n):
    rows, ts = [], T0
    urls = ["https://youtube.com/watch?v=a", "https://youtube.com/watch?v=b", "https://x.org/p", "https://youtube.com/watch"]
    for i in range(n):
        ts += timedelta(seconds=rng.choice([1, 2, 30, 60, 200, 2000]))
        kind = rng.choice(["start", "stop", "navigate", "song", "song", "mode", "beat", "beat", "close"])
        url = rng.choice(urls) if kind in ("start", "navigate") else None
        mode = rng.choice(["stft", "basic"]) if kind in ("start", "mode") else None
        named = rng.choice(["yt:a", "yt:b", "yt:c", None])
        place = rng.choice(["https://youtube.com/watch?v=" + named[3:], None]) if named else None
        song = (named, rng.choice(["A", "B", None]), None, None, place) if kind == "song" else None
        rows.append((user, ts, i, kind, url, mode, song))
    return rows


@pytest.fixture(scope="module")
def logs():
    rng = random.Random(23)
    return {u: random_log(u, rng, 150) for u in ("u1", "u2", "u3")}


@pytest.mark.parametrize("silence", [None, 600])
def test_segments_equal_sequential_meaning(spark, logs, silence):
    df = spark.createDataFrame([r for l in logs.values() for r in l], EVENTS)
    got = us.listen_segments(df, silence_seconds=silence, slice_seconds=900).collect()
    for user, rows in logs.items():
        want = [(k, t, m, u, s.replace(tzinfo=None), e.replace(tzinfo=None)) for k, t, m, u, s, e in spec(rows, silence)]
        have = sorted(((r["videoKey"], r["songTitle"], r["filterMode"], r["videoUrl"], r["startedAt"], r["endedAt"])
                       for r in got if r["user"] == user), key=lambda r: r[4])
        assert have == want and len(want) >= 5


@pytest.mark.parametrize("silence", [None, 600])
def test_one_start_spreads_over_slices(spark, silence):
    """A log of one start that nothing ends; every pass works on slices of an hour."""
    rng, rows, ts = random.Random(9), [], T0
    for i in range(8000):
        ts += timedelta(seconds=rng.choice([1, 5, 60, 300, 700]))
        kind = "start" if not i else rng.choice(["navigate", "song", "song", "song", "mode"] + ["beat"] * 4)
        url = "https://youtube.com/watch?v=" + rng.choice("ab") if kind in ("start", "navigate") else None
        named = rng.choice(["yt:a", "yt:b", "yt:c", None])
        place = rng.choice(["https://youtube.com/watch?v=" + named[3:], None, None]) if named else None
        song = (named, rng.choice(["A", "B", None]), None, None, place) if kind == "song" else None
        rows.append(("hot", ts, i, kind, url, "stft" if kind in ("start", "mode") else None, song))
    df = spark.createDataFrame(rows, EVENTS)
    found = us.listen_segments(df, silence_seconds=silence)
    got = sorted(((r["videoKey"], r["songTitle"], r["filterMode"], r["videoUrl"], r["startedAt"], r["endedAt"])
                  for r in found.collect()), key=lambda r: r[4])
    assert got == [(k, t, m, u, s.replace(tzinfo=None), e.replace(tzinfo=None)) for k, t, m, u, s, e in spec(rows, silence)]
    # rows meet their neighbours by (user, slice); only what slices hand on is sorted by user alone
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_slice" in line.rpartition("], [user")[2] or "_s_" in line for line in windows)


@pytest.fixture(scope="module")
def segments(spark):
    def row(u, k, mode, s, day):
        return (u, k, mode, s, datetime(2024, day[0], day[1], 12, tzinfo=timezone.utc))
    rows = [row("a", "k1", "stft", 100, (1, 31)), row("a", "k1", "basic", 50, (2, 1)), row("a", "k2", "stft", 70, (2, 2)),
            row("b", "k1", "stft", 120, (2, 2)), row("c", "k3", None, 10, (2, 3))]
    return spark.createDataFrame(rows, "user string, videoKey string, filterMode string, seconds long, endedAt timestamp")


def test_statistics(spark, segments):
    totals = {r["user"]: tuple(r)[1:] for r in us.usage_totals(segments).collect()}
    assert totals == {"a": (220, 2, 3), "b": (120, 1, 1), "c": (10, 1, 1)}
    rough = {r["user"]: tuple(r)[1:] for r in us.usage_totals(segments, approximate=True).collect()}
    assert rough == totals
    modes = {(r["user"], r["filterMode"]): r["seconds"] for r in us.usage_by_mode(segments).collect()}
    assert modes == {("a", "stft"): 170, ("a", "basic"): 50, ("a", None): 220, ("b", "stft"): 120, ("b", None): 120,
                     ("c", ""): 10, ("c", None): 10}
    top = [(r["user"], r["videoKey"], r["rank"]) for r in us.top_songs(segments, 1).orderBy("user").collect()]
    assert top == [("a", "k1", 1), ("b", "k1", 1), ("c", "k3", 1)]
    board = {(r["period"], r["user"]): tuple(r)[2:] for r in us.scoreboard(segments).collect()}
    assert board == {("2024-01", "a"): (1, 1, 100, 1), ("2024-02", "a"): (1, 3, 120, 2), ("2024-02", "b"): (1, 3, 120, 1),
                     ("2024-02", "c"): (3, 3, 10, 1), ("all", "a"): (1, 3, 220, 2), ("all", "b"): (2, 3, 120, 1),
                     ("all", "c"): (3, 3, 10, 1)}
    progress = spark.createDataFrame([("a", "solo", 220), ("b", "solo", 5)], "user string, track string, progress long")
    tiers = spark.createDataFrame([("solo", "t1", "One", 100), ("solo", "t2", "Two", 300)],
                                  "track string, key string, name string, threshold long")
    badges, summary = us.achievements(progress, tiers)
    assert {(r["user"], r["key"]): r["earned"] for r in badges.collect()} == {
        ("a", "t1"): True, ("a", "t2"): False, ("b", "t1"): False, ("b", "t2"): False}
    assert {r["user"]: tuple(r)[2:] for r in summary.collect()} == {"a": (1, 2, "Two", 80), "b": (0, 2, "One", 95)}


def test_party_and_queue(spark):
    q = spark.createDataFrame([("h", "r1", "g1", "s1", True), ("h", "r1", "g2", "s1", False), ("h", "r2", "g1", "s2", True)],
                              "host string, room string, guest string, song string, played boolean")
    assert tuple(us.party_stats(q).first()) == ("h", 3, 2, 2, 2)
    assert us.party_top_songs(q, 1).first()["song"] == "s1"
    events = [("r", T0 + timedelta(seconds=i), i, k) for i, k in enumerate(["add", "add", "next", "add", "end", "add"])]
    df = spark.createDataFrame(events, "room string, ts timestamp, ord long, kind string")
    got = [r["depth"] for r in us.queue_depth(df, slice_seconds=2).orderBy("ord").collect()]
    assert got == [1, 2, 1, 2, 0]
    songs = spark.createDataFrame([("r", "a", 0, True, False), ("r", "b", 1, False, False), ("r", "c", 2, False, False), ("x", "z", 0, False, True)],
                                  "room string, song string, position int, played boolean, closed boolean")
    assert [tuple(r) for r in us.now_playing(songs).collect()] == [("r", "b", 2)]


def test_change_signals(spark):
    rows = [("u", T0 + timedelta(milliseconds=ms), i, v) for i, (ms, v) in enumerate(
        [(0, None), (100, "a"), (450, "a"), (900, "b"), (1000, "a"), (5000, "a")])]
    df = spark.createDataFrame(rows, "user string, ts timestamp, ord long, v string")
    assert [r["ord"] for r in us.distinct_until_changed(df, "user", "v", slice_seconds=1).orderBy("ord").collect()] == [0, 1, 3, 4]
    assert [r["ord"] for r in us.debounce(df, "user", 400, slice_seconds=1).orderBy("ord").collect()] == [2, 4, 5]
    assert {r["v"]: r["ord"] for r in us.once_per_key(df.filter("v is not null"), "v").collect()} == {"a": 1, "b": 3}
    results = spark.createDataFrame([("t", 1, "old"), ("t", 2, "new")], "tab string, generation int, r string")
    assert [r["r"] for r in us.newest_generation(results, results, "tab").collect()] == ["new"]
    songs = spark.createDataFrame([("t", "a", T0, T0 + timedelta(seconds=9)), ("t", "b", T0 + timedelta(seconds=9), None)],
                                  "tab string, key string, from timestamp, to timestamp")
    lyrics = spark.createDataFrame([(1, "t", "a", T0 + timedelta(seconds=3)), (2, "t", "a", T0 + timedelta(seconds=10)),
                                    (3, "t", "b", T0 + timedelta(seconds=99))], "id int, tab string, key string, ts timestamp")
    assert sorted(r["id"] for r in us.song_identity_guard(lyrics, songs).collect()) == [1, 3]


def test_votes_and_outcomes(spark):
    votes = [("u1", "k", 1, 0, True, None), ("u1", "k", 2, 1, False, None), ("u2", "k", 1, 0, None, 5), ("u3", "k", 1, 0, None, 3),
             ("u4", "m", 1, 0, None, 0)]
    df = spark.createDataFrame([(u, k, T0 + timedelta(seconds=s), o, l, r) for u, k, s, o, l, r in votes],
                               "user string, video_key string, ts timestamp, ord long, liked boolean, rating int")
    assert {r["video_key"]: tuple(r)[1:] for r in fb.vote_tally(df).collect()} == {"k": (1, 2, 33), "m": (0, 0, None)}
    assert {r["video_key"]: tuple(r)[1:] for r in fb.star_average(df).collect()} == {"k": (4.0, 2)}
    keys = spark.createDataFrame([("k",), ("k",), ("z",)], "video_key string")
    assert sorted(tuple(r) for r in fb.stats_lookup(keys, fb.vote_tally(df)).collect()) == [("k", 1, 2), ("z", 0, 0)]
    day = timedelta(days=1)
    outs = [("yt:a", "queued", T0, 0), ("yt:b", "rate_limited", T0, 0), ("yt:c", "upstream", T0, 0), ("yt:d", "already_synced", T0, 0)]
    told = spark.createDataFrame(outs, "video_key string, reason string, ts timestamp, ord long")
    ttl = fb.ttl_outcomes(told)
    assert {r["video_key"] for r in ttl.collect()} == {"yt:a", "yt:b", "yt:d"}
    lyric = "\n".join(["l1", "l2", " ", "l3", "l4"])
    songs = [(k, k, "t", "a", lyric, None, False, False, T0 + 2 * day) for k in ("yt:a", "yt:b", "yt:c", "yt:d")]
    songs += [("yt:e", "yt:x", "t", "a", lyric, None, False, False, T0), ("yt:f", "yt:f", "t", "a", "l1\nl2", None, False, False, T0),
              ("x.org", "x.org", "t", "a", lyric, None, False, False, T0), ("yt:g", "yt:g", "t", "a", lyric, None, True, False, T0)]
    df = spark.createDataFrame(songs, "video_key string, resolved_key string, trackName string, artistName string, "
                               "syncedLyrics string, plainLyrics string, wordTimed boolean, hasWords boolean, ts timestamp")
    assert sorted(r["video_key"] for r in fb.should_request_sync(df, told).collect()) == ["yt:b", "yt:c"]
    looks = spark.createDataFrame([("k", T0 + timedelta(seconds=s), s) for s in (-1, 0, 599, 600, 700, 800)], "cache_key string, ts timestamp, id int")
    miss = spark.createDataFrame([("k", T0, "miss"), ("k", T0 + timedelta(seconds=650), "miss"), ("k", T0 + timedelta(seconds=750), "refresh")],
                                 "cache_key string, ts timestamp, kind string")
    got = {r["id"]: r["suppressed"] for r in fb.negative_cache(looks, miss, slice_seconds=300).collect()}
    assert got == {-1: False, 0: True, 599: True, 600: False, 700: True, 800: False}
    req = spark.createDataFrame([("s", "u"), ("s", "u"), ("s", "v"), ("z", "u")], "song_key string, user string")
    assert [tuple(r) for r in fb.top_demand(req, 1).collect()] == [("s", 2)]
    entries = spark.createDataFrame([("u", f"k{i}", T0 + timedelta(seconds=i)) for i in range(9)], "user string, key string, ts timestamp")
    assert sorted(r["key"] for r in fb.keep_newest(entries, 2).collect()) == ["k7", "k8"]


def test_sinks(spark, tmp_path, logs):
    votes = spark.createDataFrame([("k", "like"), (None, "like"), ("k", "dislike")], "videoKey string, vote string")
    for c in ("videoUrl", "songTitle", "trackName", "artistName", "filterMode", "comment"):
        votes = votes.withColumn(c, F.lit(None).cast("string"))
    sinks.write_votes(votes, str(tmp_path / "votes"))
    assert sorted(r["rating"] for r in spark.read.parquet(str(tmp_path / "votes")).collect()) == [1, 5]
    df = spark.createDataFrame(logs["u1"], EVENTS)
    segments = us.listen_segments(df)
    for _ in range(2):  # a repeated run changes nothing
        sinks.append_segments(segments, str(tmp_path / "segments"))
    assert spark.read.parquet(str(tmp_path / "segments")).count() == segments.count()
    # two batches of one day both stay; the first one again changes nothing
    ranked = segments.withColumn("n", F.row_number().over(W.orderBy("startedAt")))
    halves = [ranked.filter(f"n % 2 = {i}").drop("n") for i in (0, 1)]
    for half in (*halves, halves[0]):
        sinks.append_segments(half, str(tmp_path / "halves"))
    assert spark.read.parquet(str(tmp_path / "halves")).count() == segments.count()
    requests = spark.createDataFrame([("k1",), ("k2",), ("k3",), ("k4",)], "videoKey string")
    answers = spark.createDataFrame([("k1", 201, None), ("k2", 401, "x"), ("k3", 429, "rate_limited")], "videoKey string, status int, reason string")
    got = {r["videoKey"]: r["reason"] for r in sinks.request_outcomes(requests, answers).collect()}
    assert got == {"k1": "queued", "k2": "unauthenticated", "k3": "rate_limited", "k4": "upstream"}
