import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from songloom.operators import timeline as tl
from songloom.operators.ordered import neighbours
from songloom.sources import captions as cp
from songloom.sources import pages as pg
from songloom.sources.lyrics import read_lrc

LINES = "song_id int, line_idx int, time double, text string, words array<struct<time:double,text:string>>"


def test_read_lrc(spark):
    body = ("[ti:Title]\r\n[00:12.50]second\n[00:05.00][01:00.00] twice  here \n[00:07.00]\n"
            "no stamp\n[00:05.00]tie\n[00:20.00]<00:20.00>Hel<00:20.50>lo  <00:21.00>you<00:22.00>")
    got = read_lrc(spark.createDataFrame([(1, body), (2, "[ti:x]"), (3, None)], "song_id int, lrc string"))
    rows = [(r["line_idx"], r["time"], r["text"], r["words"] and [tuple(w) for w in r["words"]])
            for r in got.orderBy("line_idx").collect()]
    assert rows == [
        (0, 5.0, "twice here", None), (1, 5.0, "tie", None), (2, 12.5, "second", None),
        (3, 20.0, "Hello you", [(20.0, "Hel"), (20.5, "lo"), (21.0, "you")]), (4, 60.0, "twice here", None)]


def test_captions(spark):
    vtt = "WEBVTT\n\n00:01.500 --> 00:02.000\nHi <b>you</b>\n\n1\n01:00:02.250 --> 01:00:03.000\na\n b\n\n00:09.000 --> x\n  "
    js = json.dumps({"events": [{"tStartMs": 1500, "segs": [{"utf8": "Hi "}, {}, {"utf8": "you\n"}]},
                                {"tStartMs": 2000}, {"segs": [{"utf8": "x"}]}, {"tStartMs": 3000, "segs": [{"utf8": " "}]}]})
    srv3 = '<timedtext><body><p t="1500" d="9">Hi <s>you</s> &amp; me</p><p t="2"/><p>zero</p></body></timedtext>'
    srv1 = '<transcript><text start="1.5" dur="2">Hi  you</text><text start="3"> </text></transcript>'
    docs = spark.createDataFrame([(1, vtt), (2, js), (3, srv3), (4, srv1), (5, "garbage"), (6, "{broken"), (7, None)],
                                 "doc_id int, body string")
    got = {}
    for r in cp.read_captions(docs).orderBy("doc_id", "cue_idx").collect():
        got.setdefault(r["doc_id"], []).append((r["time"], r["text"]))
    # The text of a cue is everything after the block's first line, also with a cue number.
    assert got == {1: [(1.5, "Hi you"), (3602.25, "01:00:02.250 --> 01:00:03.000 a b")],
                   2: [(1.5, "Hi you")], 3: [(1.5, "Hi you & me"), (0.0, "zero")], 4: [(1.5, "Hi you")]}
    strict = cp.read_vtt(docs.filter("doc_id = 1"), need_end=True).count()
    assert strict == 2
    tracks = spark.createDataFrame([(1, 0, "asr", [(1.0, "a")]), (1, 1, None, []), (1, 2, "", [(1.0, "b")]), (2, 0, "asr", [(1.0, "c")])],
                                   "doc_id int, ord int, kind string, cues " + cp.CUES)
    assert {r["doc_id"]: r["ord"] for r in cp.preferred_tracks(tracks).collect()} == {1: 2, 2: 0}


def test_pages(spark):
    lyric = "<div class='x' data-lyrics-container=\"true\">12 Contributors Song Lyrics<br><br>First line of the song<div>in</div> here<br/>and a second &amp; last</div>"
    schema = ('<script type="application/ld+json">[{"@type":"WebPage"},{"@type":"MusicRecording","name":" Halo ",'
              '"byArtist":{"name":"Beyoncé"}}]</script>')
    player = '<script>var a = "{"; ytInitialPlayerResponse = {"videoDetails":{"title":"Yellow {x","author":"Coldplay - Topic"}};</script>'
    channel = '<title>Fix You (Official Video)</title><div id="owner-name"><a href="/c">Coldplay</a></div>'
    df = spark.createDataFrame([(1, lyric), (2, schema + player), (3, player), (4, channel), (5, "<p>none</p>"), (6, None)],
                               "page_id int, html string")
    got = {r["page_id"]: r["text"] for r in pg.pages_lyrics(df).collect()}
    assert got == {1: "First line of the songin\n here\nand a second & last"}
    meta = {r["page_id"]: tuple(r)[1:] for r in pg.pages_song_metadata(df).collect()}
    assert meta == {2: ("Halo", "Beyoncé", "schema"), 3: ("Yellow {x", "Coldplay", "ytInitialPlayerResponse"),
                    4: ("Fix You", "Coldplay", "dom")}
    assert pg.marked_blocks("<div M>a<div>b</div>c</div><div M>open<div>x</div>", "M") == ["a<div>b</div>c"]


def test_neighbours_equal_plain_windows(spark):
    rng = random.Random(5)
    rows = [(k, o, rng.choice([None, 1, 2, 3])) for k in (1, 2, 3) for o in sorted(rng.sample(range(200), 60))]
    df = spark.createDataFrame(rows, "k int, o int, v int")
    got = neighbours(df, ["k"], ["o"], F.floor(F.col("o") / 7), previous={"p": F.col("v")},
                     following={"n": F.col("v")}, last={"l": F.col("v")}, total={"t": F.coalesce("v", F.lit(0))})
    w = "over (partition by k order by o"
    sql = f"""select *, lag(v) {w}) p, lead(v) {w}) n,
              last(v, true) {w} rows between unbounded preceding and 1 preceding) l,
              sum(coalesce(v, 0)) {w} rows unbounded preceding) t from d"""
    df.createOrReplaceTempView("d")
    want = {tuple(r) for r in spark.sql(sql).collect()}
    assert {tuple(r) for r in got.select("k", "o", "v", "p", "n", "l", "t").collect()} == want


@pytest.fixture(scope="module")
def song(spark):
    rows = [(1, 0, 8.0, "a b", [(8.0, "a"), (8.5, "b")]), (1, 1, 20.0, "tie", None), (1, 2, 20.0, "last of tie", None),
            (1, 3, 30.0, "x y", [(30.0, "x"), (31.0, "nope")]), (2, 0, 2.0, "only", None)]
    return spark.createDataFrame(rows, LINES).cache()


def test_ends_gaps_pages(spark, song):
    ends = {(r["song_id"], r["line_idx"]): r["end"] for r in tl.line_ends(song).collect()}
    assert ends == {(1, 0): 20.0, (1, 1): 20.0, (1, 2): 30.0, (1, 3): 34.0, (2, 0): 6.0}
    gaps = [(r["song_id"], r["start"], r["end"], r["next_idx"]) for r in tl.lyric_gaps(song).orderBy("start").collect()]
    assert gaps == [(1, 0.0, 8.0, 0), (1, 9.7, 20.0, 1)]
    pages = [r[0] for r in spark.range(-1, 7).select(tl.page_of(F.col("id"))).collect()]
    assert pages == [0, 0, 0, 0, 1, 1, 1, 2]


def test_clock_joins(spark, song):
    at = [(0, 1, 7.94, False), (1, 1, 7.96, False), (2, 1, 7.96, True), (3, 1, 20.0, True), (4, 1, 999.0, True),
          (5, 2, 1.0, False), (6, 3, 1.0, False), (7, 1, 18.5, True), (8, 1, 19.5, True), (9, 1, 30.5, True)]
    ticks = spark.createDataFrame(at, "tick_id int, song_id int, t double, paused boolean").cache()
    idx = {r["tick_id"]: r["line_idx"] for r in tl.asof_line(ticks, song).collect()}
    assert idx == {0: -1, 1: 0, 2: -1, 3: 2, 4: 3, 5: -1, 6: -1, 7: 0, 8: 0, 9: 3}
    gap = {r["tick_id"]: (r["gap_idx"], r["staged_idx"]) for r in tl.gap_at(ticks, tl.lyric_gaps(song)).collect()}
    assert gap[7] == (1, None) and gap[8] == (None, 1) and gap[0] == (None, 0) and gap[9] == (None, None)
    words = {(r["tick_id"], r["word_idx"]): (r["word"], r["state"], r["percent"])
             for r in tl.word_at(ticks, song).collect()}
    assert words[1, 0] == ("a", "singing", 2.0) and words[1, 1] == ("b", "upcoming", None)
    # Words that cannot be located are cut anew; equal counts keep the measured times.
    assert words[9, 0] == ("x", "singing", 50.0) and words[9, 1] == ("y", "upcoming", None)
    assert words[4, 1] == ("y", "sung", None)


def test_captions_dedupe(spark):
    rows = [(1, 0, 0.1, "a"), (1, 1, 1.0, "a"), (1, 2, 2.0, ""), (1, 3, 3.0, "a"), (1, 4, 4.0, "b"), (1, 5, 5.0, "a")]
    df = spark.createDataFrame(rows, "doc_id int, cue_idx int, time double, text string")
    got = [(r["cue_idx"], round(r["time"], 3)) for r in tl.dedupe_consecutive(df).orderBy("cue_idx").collect()]
    assert got == [(0, 0.0), (4, 3.7), (5, 4.7)]


def test_playback_grid_and_pauses(spark):
    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
    states = [(1, t0 + timedelta(milliseconds=m), t, 100.0, p) for m, t, p in ((50, 10.0, False), (700, 30.0, True), (1100, 30.0, False))]
    df = spark.createDataFrame(states, "song_id int, ts timestamp, time double, duration double, paused boolean")
    got = [(r["ms"], round(r["t"], 3)) for r in tl.playback_ticks(df).select(
        (F.unix_millis("ts") % 10000).alias("ms"), "t").orderBy("ms").collect()]
    assert got == [(200, 10.15), (400, 10.35), (600, 10.55), (800, 30.0), (1000, 30.0), (1200, 30.1)]
    polls = [(1, t0 + timedelta(seconds=s), p) for s, p in enumerate(["0:01", "0:02", "0:02", "0:02", "0:02", "0:03"])]
    df = spark.createDataFrame(polls, "song_id int, ts timestamp, position string")
    assert [r["paused"] for r in tl.pause_detection(df).orderBy("ts").collect()] == [False, False, False, True, True, False]


def test_a_long_reign_is_listed_in_pieces(spark):
    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
    states = [(1, t0, 0.0, 0.0, False), (1, t0 + timedelta(days=30), 1.0, 0.0, False)]
    df = spark.createDataFrame(states, "song_id int, ts timestamp, time double, duration double, paused boolean")
    grid = tl.playback_ticks(df, step_ms=2000)
    got = grid.agg(F.count("*"), F.countDistinct("ts"), F.max("t")).first()
    assert tuple(got) == (30 * 43_200 + 1, 30 * 43_200 + 1, 30 * 86_400.0 - 2)


def test_the_newest_of_several_answers_counts(spark):
    from songloom.sources import sinks

    asked = spark.createDataFrame([("k",), ("k",), ("m",)], "videoKey string")
    told = spark.createDataFrame([("k", 201, None, 1), ("k", 429, "rate_limited", 2)], "videoKey string, status int, reason string, ord int")
    assert sorted(tuple(r) for r in sinks.request_outcomes(asked, told).collect()) == [("k", "rate_limited"), ("m", "upstream")]


def test_pages_go_to_python_in_short_batches(spark):
    """no Arrow batch of ten thousand pages, one evaluation in Python, entities decoded from a text named once."""
    pages = spark.createDataFrame([(1, f"<div {pg.LYRICS_MARKER}>{'la &#65; ' * 9}</div>"), (2, "<p>x</p>"), (3, None)], "page_id int, html string")
    found = pg.pages_lyrics(pages)
    assert [(r["page_id"], r["text"]) for r in found.collect()] == [(1, ("la A " * 9).strip())]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and plan.count("BatchEvalPython") == 1
    assert str(pg.html_to_text(F.col("html"))).count("&quot;") == 1
