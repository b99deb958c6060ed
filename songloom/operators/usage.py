"""Listening segments from event logs, and the statistics over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clock import round_half_up
from ..functions.urls import derive_video_key, url_parts
from ..session import cut
from .linkage import top_k
from .ordered import neighbours, time_slice

MIN_SECONDS = 3
SONG = "struct<videoKey:string,songTitle:string,trackName:string,artistName:string,videoUrl:string>"

#: Event log: ``user, ts, ord, kind, url, mode, song``. ``ord`` breaks ties of ``ts``.
KINDS = ("start", "stop", "close", "navigate", "song", "mode", "beat")


def _micros(c: str) -> Column:
    return F.unix_micros(c)


def valid_segment(segments: DataFrame) -> DataFrame:
    """Keyed segments of at least 3 rounded seconds."""
    return segments.filter(F.col("videoKey").isNotNull() & (F.col("seconds") >= MIN_SECONDS))


def listen_segments(
    events: DataFrame,
    user: str = "user",
    silence_seconds: float | None = None,
    slice_seconds: int = 3600,
) -> DataFrame:
    """T1, T2 in batch: one row per closed segment of one song in one mode.

    What a row needs to know of the rows before it is always the newest of some kind (the last
    start, move, claim of a key, opening), so it is carried along a user by time slices: each
    slice hands on what is newest at its end, and no window holds more than a slice. One log
    without a second start, of any length, spreads over tasks. Three such passes follow each
    other: what events say, what is open and under which key, and which segment it is.

    The key of an open segment is that of the place its tab shows, from a start, a move or a
    change of mode on. A song report with a URL and another key opens the segment of that URL
    (which is taken to be the URL of that key); one without a URL that names another key than
    the open segment's opens the segment of the tab. A report of the same key adds what it
    knows to the open segment.
    With ``silence_seconds``, a source silent for longer is taken as gone: its segment
    ends at its last beat and later events find nothing open. A log's open end is
    treated the same way.
    """
    keys, order = [user], ["ts", "ord"]
    piece = time_slice("ts", slice_seconds)
    place = F.struct(*order)
    started, sung = F.col("kind") == "start", F.col("kind") == "song"
    spot = url_parts("url")
    at = F.struct(
        F.col("url").alias("url"), derive_video_key("url").alias("key"),
        F.struct(*(spot[n] for n in ("scheme", "host", "port", "path"))).alias("path"), spot.isNotNull().alias("known"),
    )
    base = events.withColumns({
        "_at": F.when(F.col("url").isNotNull(), at),
        "_told": F.when(sung, F.col("song.videoKey")),
        "_told_url": F.when(sung, F.nullif(F.col("song.videoUrl"), F.lit(""))),
    })
    base = base.withColumn("_told_key", F.when(F.col("_told").isNotNull(), derive_video_key("_told_url")))
    moved = F.col("kind").isin("start", "navigate")
    by_tab = started | (F.col("kind") == "mode") | ((F.col("kind") == "navigate") & F.col("_at.key").isNotNull())
    by_url = F.col("_told").isNotNull() & F.col("_told_url").isNotNull()
    by_name = F.col("_told").isNotNull() & F.col("_told_url").isNull()

    # What the events say: start, tab, mode and song in force, and the name told last.
    known = neighbours(
        base, keys, order, piece,
        following={"_next": F.col("ts")},
        last={
            "_start": F.when(started, place),
            "_tab": F.when(started | (moved & F.col("url").isNotNull()), F.struct(F.col("_at").alias("at"))),
            "_set_mode": F.when((F.col("kind") == "mode") | started, F.col("mode")),
            "_known": F.when(F.col("_told").isNotNull(), F.col("song")),
            "_name": F.when(by_tab, F.struct(F.lit(None).cast("string").alias("k")))
            .when(by_url, F.struct(F.col("_told_key").alias("k")))
            .when(by_name, F.struct(F.col("_told").alias("k"))),
        },
    )
    known = known.withColumns({
        "_start": F.when(started, place).otherwise(F.col("_start")),
        "_tab": F.when(~started, F.col("_tab.at")),
    })
    rows = cut(known.filter("_start is not null"))

    # What is open, and its key: null stands for the key of the tab. Of reports without a URL
    # only one that names another key than was told before it can matter.
    both = F.coalesce(F.col("_at.known") & F.col("_tab.known"), F.lit(False))
    same_place = F.when(both, F.col("_at.path") == F.col("_tab.path")).otherwise(F.col("url").eqNullSafe(F.col("_tab.url")))
    ends = ((F.col("kind") == "navigate") & ~same_place) | F.col("kind").isin("stop", "close")
    silent = F.lit(False)
    if silence_seconds is not None:
        silent = F.coalesce((_micros("_next") - _micros("ts")) > silence_seconds * 1_000_000, F.lit(False))
    rows = rows.withColumns({"_ends": ends, "_silent": silent})
    other = by_name & ~F.col("_told").eqNullSafe(F.col("_name.k"))
    rows = neighbours(
        rows, keys, order, piece,
        last={
            "_open": F.when(F.col("_silent") | F.col("_ends"), F.lit(False)).when(started, F.lit(True)),
            "_here": F.when(by_tab | other, F.struct(F.lit(True).alias("tab"), F.lit(None).cast("string").alias("k")))
            .when(by_url, F.struct(F.lit(False).alias("tab"), F.col("_told_key").alias("k"))),
        },
    )
    rows = rows.withColumn("_open", F.coalesce("_open", F.lit(False)) & ~started).filter(F.col("_open") | started)
    current = F.when(F.col("_here.tab"), F.col("_tab.key")).otherwise(F.col("_here.k"))
    new_key = (
        F.when(moved, F.col("_at.key"))
        .when(sung & F.col("_told_url").isNotNull(), F.col("_told_key"))
        .otherwise(F.col("_tab.key"))
    )
    told = F.when(sung, F.col("_told")).when(F.col("kind") == "navigate", F.col("_at.key"))
    changes = told.isNotNull() & ~told.eqNullSafe(current)
    opens = started | (F.col("_open") & ~F.col("_ends") & ((F.col("kind") == "mode") | changes))
    rows = rows.withColumns({"_opens": opens, "_closes": F.col("_open") & F.col("_ends"), "_new_key": new_key})

    # Which segment it is, and what is known of its song. A mode change hands its metadata on; a
    # start or move takes the last report of the same key.
    reset = F.col("_opens") & (F.col("kind") != "mode")
    seed = F.when(F.col("_opens") & moved & (F.col("_known.videoKey") == F.col("_at.key")), F.col("_known"))
    report = F.when(sung, F.col("song"))
    fields = ("songTitle", "trackName", "artistName")
    said = {f: F.nullif(F.coalesce(report[f], seed[f]), F.lit("")) for f in fields}
    rows = rows.withColumns({
        "_opened": F.when(F.col("_opens"), place),
        **{f"_is_{f}": F.when(reset | said[f].isNotNull(), F.struct(said[f].alias("v"))) for f in fields},
    })
    rows = neighbours(
        rows, keys, order, piece,
        last={"_segment": F.col("_opened"), **{f"_was_{f}": F.col(f"_is_{f}") for f in fields}},
    )
    rows = rows.withColumns({
        "_segment": F.coalesce("_opened", "_segment"),
        **{f"_{f}": F.coalesce(f"_is_{f}", f"_was_{f}")["v"] for f in fields},
    })
    opened = F.col("_opens")
    tab_now = F.coalesce(F.when(moved, F.col("url")), F.col("_tab.url"))
    url = F.when(opened & ~sung, tab_now).when(opened, F.coalesce("_told_url", "_tab.url")).otherwise(F.col("_told_url"))
    mode_now = F.coalesce("mode", "_set_mode")
    segments = rows.groupBy(*keys, "_segment").agg(
        F.max(F.when(opened, F.col("_new_key"))).alias("videoKey"),
        F.max_by(url, F.when(url.isNotNull(), place)).alias("videoUrl"),
        *(F.max_by(f"_{f}", place).alias(f) for f in fields),
        F.max(F.when(opened, mode_now)).alias("filterMode"),
        F.min(F.when(opened, F.col("ts"))).alias("startedAt"),
        F.max(F.when(F.col("kind").isin("beat") | opened, F.col("ts"))).alias("_beat"),
        F.min(F.when(F.col("_closes"), F.col("ts"))).alias("_closed"),
        F.max(F.col("_silent") & ~F.col("_closes")).alias("_gone"),
        F.max_by("_next", place).alias("_after"),
    )
    ended = F.coalesce(
        F.col("_closed"), F.when(F.col("_gone"), F.col("_beat")), F.col("_after"), F.col("_beat")
    )
    segments = segments.withColumn("endedAt", ended)
    seconds = round_half_up((_micros("endedAt") - _micros("startedAt")) / 1_000_000)
    segments = segments.withColumn("seconds", seconds.cast("long"))
    return valid_segment(segments).select(
        user, "videoKey", "videoUrl", "songTitle", "trackName", "artistName", "filterMode",
        "seconds", "startedAt", "endedAt",
    )


# ── Statistics ───────────────────────────────────────────────────────────────

def usage_totals(segments: DataFrame, user: str = "user", approximate: bool = False) -> DataFrame:
    """A3: seconds, distinct songs and sessions per user.

    Songs are first reduced to one row per (user, song), so no user's song set is held
    in one place.
    """
    if approximate:
        return segments.groupBy(user).agg(
            F.sum("seconds").alias("totalSeconds"),
            F.approx_count_distinct("videoKey").alias("uniqueSongs"),
            F.count(F.lit(1)).alias("sessionCount"),
        )
    per_song = segments.groupBy(user, "videoKey").agg(
        F.sum("seconds").alias("s"), F.count(F.lit(1)).alias("n")
    )
    return per_song.groupBy(user).agg(
        F.sum("s").alias("totalSeconds"),
        F.count("videoKey").alias("uniqueSongs"),
        F.sum("n").alias("sessionCount"),
    )


def usage_by_mode(segments: DataFrame, user: str = "user") -> DataFrame:
    """A4: seconds per user and mode; the total row has a null mode."""
    per_mode = (
        segments.withColumn("filterMode", F.coalesce("filterMode", F.lit("")))
        .groupBy(user, "filterMode")
        .agg(F.sum("seconds").alias("seconds"))
    )
    whole = F.explode(F.array("filterMode", F.lit(None).cast("string")))
    return per_mode.withColumn("filterMode", whole).groupBy(user, "filterMode").agg(
        F.sum("seconds").alias("seconds")
    )


def top_songs(segments: DataFrame, k: int = 5, user: str = "user") -> DataFrame:
    """A5: most-filtered songs per user; ties by key."""
    per_song = segments.groupBy(user, "videoKey").agg(F.sum("seconds").alias("seconds"))
    return top_k(per_song, [user], [F.col("seconds").desc(), F.col("videoKey")], k)


def period_totals(segments: DataFrame, user: str = "user") -> DataFrame:
    """Seconds and songs per user for each UTC month of the segment's end, and for all time."""
    month = F.date_format("endedAt", "yyyy-MM")
    per_song = segments.groupBy(user, "videoKey", month.alias("month")).agg(
        F.sum("seconds").alias("s")
    )
    spread = per_song.withColumn("period", F.explode(F.array("month", F.lit("all"))))
    per_song = spread.groupBy("period", user, "videoKey").agg(F.sum("s").alias("s"))
    return per_song.groupBy("period", user).agg(
        F.sum("s").alias("totalSeconds"), F.count("videoKey").alias("songs")
    )


def scoreboard(segments: DataFrame, user: str = "user") -> DataFrame:
    """Rank of each user per period, equal seconds sharing a rank.

    Ranking a period in one task would collect every user there. The rank is one more
    than the number of users with more seconds, so users are first counted per distinct
    figure, the figures are ranked through value slices, and the rank is joined back.
    """
    totals = period_totals(segments, user)
    levels = totals.groupBy("period", "totalSeconds").agg(F.count(F.lit(1)).alias("n"))
    levels = levels.withColumn("_desc", -F.col("totalSeconds"))
    width = F.lit(3600)
    ranked = neighbours(
        levels, ["period"], ["_desc"], F.floor(F.col("_desc") / width), total={"upto": F.col("n")}
    )
    ranks = ranked.select(
        "period", "totalSeconds", (F.col("upto") - F.col("n") + 1).alias("rank")
    )
    singers = totals.groupBy("period").agg(F.count(F.lit(1)).alias("totalSingers"))
    return (
        totals.join(ranks, ["period", "totalSeconds"])
        .join(singers, "period")
        .select("period", user, "rank", "totalSingers", "totalSeconds", "songs")
    )


def achievements(
    progress: DataFrame, tiers: DataFrame, user: str = "user", track: str = "track"
) -> tuple[DataFrame, DataFrame]:
    """Earned flag per (user, tier), and per user the count and the next tier.

    ``progress`` holds ``[user, track, progress]``, one row each, ``tiers`` hold ``[track, key,
    name, threshold]``. The flags are one row per user and tier by definition. The summary needs
    no such pairs: a track's tiers travel as one sorted ladder, and the progress is placed in it.
    """
    badges = progress.join(tiers, track).withColumn(
        "earned", F.col("progress") >= F.col("threshold")
    )
    step = F.when(F.col("threshold").isNotNull(), F.struct("threshold", "name", "key"))
    ladder = tiers.groupBy(track).agg(
        F.sort_array(F.collect_list(step)).alias("_steps"), F.count(F.lit(1)).alias("allCount")
    )
    placed = progress.join(ladder, track)
    at = F.size(F.filter("_steps", lambda s: s["threshold"] <= F.col("progress"))).cast("long")
    placed = placed.withColumn("earnedCount", F.when(F.col("progress").isNotNull(), at))
    following = F.get("_steps", F.col("earnedCount").cast("int"))
    left = F.greatest(F.lit(0), following["threshold"] - F.col("progress"))
    summary = placed.select(
        user, track, "earnedCount", "allCount", following["name"].alias("nextTier"), left.alias("remaining")
    )
    return badges, summary


def party_stats(queue_events: DataFrame, host: str = "host") -> DataFrame:
    """Parties, songs queued and played, and guests per host.

    Distinct rooms and guests are reduced per host before they are counted.
    """
    counts = queue_events.groupBy(host).agg(
        F.count(F.lit(1)).alias("songsQueued"),
        F.sum(F.col("played").cast("long")).alias("songsPlayed"),
    )
    rooms = queue_events.select(host, "room").distinct().groupBy(host).agg(
        F.count("room").alias("parties")
    )
    guests = queue_events.select(host, "guest").distinct().groupBy(host).agg(
        F.count("guest").alias("guests")
    )
    return counts.join(rooms, host).join(guests, host)


def party_top_songs(queue_events: DataFrame, k: int = 3, host: str = "host") -> DataFrame:
    """Most queued songs per host; ties by song."""
    per_song = queue_events.groupBy(host, "song").agg(F.count(F.lit(1)).alias("times"))
    return top_k(per_song, [host], [F.col("times").desc(), F.col("song")], k)


def queue_depth(room_events: DataFrame, room: str = "room", slice_seconds: int = 3600) -> DataFrame:
    """Number of waiting songs after each event ``add``, ``next`` or ``end``.

    ``next`` leaves an empty queue empty: the depth is the running sum of the changes less its
    lowest value below zero so far. ``end`` empties the room; later events of a closed room do
    not count.
    """
    piece = time_slice("ts", slice_seconds)
    closed = neighbours(
        room_events, [room], ["ts", "ord"], piece,
        last={"_ended": F.when(F.col("kind") == "end", F.lit(True))},
    )
    live = closed.filter(F.col("_ended").isNull()).drop("_ended")
    change = F.when(F.col("kind") == "add", 1).when(F.col("kind") == "next", -1).otherwise(0)
    counted = neighbours(live, [room], ["ts", "ord"], piece, total={"depth": change})
    counted = neighbours(counted, [room], ["ts", "ord"], piece, lowest={"_low": F.col("depth")})
    depth = F.when(F.col("kind") == "end", 0).otherwise(F.col("depth") - F.least(F.col("_low"), F.lit(0)))
    return counted.withColumn("depth", depth).drop("_low")


def now_playing(songs: DataFrame, room: str = "room") -> DataFrame:
    """First unplayed song per open room, and how many wait."""
    waiting = songs.filter(~F.col("played") & ~F.col("closed"))
    return waiting.groupBy(room).agg(
        F.min_by("song", "position").alias("nowPlaying"), F.count(F.lit(1)).alias("count")
    )


# ── Change signals ───────────────────────────────────────────────────────────

def distinct_until_changed(
    events: DataFrame, key: str, value: str, order: Sequence[str] = ("ts", "ord"), slice_seconds: int = 3600
) -> DataFrame:
    """Rows whose value differs from the row before (the first row counts)."""
    seen = neighbours(
        events, [key], order, time_slice(order[0], slice_seconds), previous={"_before": F.struct(F.col(value).alias("v"))}
    )
    same = F.col("_before").isNotNull() & F.col("_before")["v"].eqNullSafe(F.col(value))
    return seen.filter(~same).drop("_before")


def debounce(
    events: DataFrame, key: str, delay_ms: int = 400, order: Sequence[str] = ("ts", "ord"), slice_seconds: int = 3600
) -> DataFrame:
    """T4: rows not followed by another of the same key within ``delay_ms``."""
    seen = neighbours(
        events, [key], order, time_slice(order[0], slice_seconds), following={"_next": F.col(order[0])}
    )
    quiet = (_micros("_next") - _micros(order[0])) >= delay_ms * 1000
    return seen.filter(F.col("_next").isNull() | quiet).drop("_next")


def drop_stale(
    results: DataFrame, key: str, generation: str = "generation", order: Sequence[str] = ("ts", "ord"), slice_seconds: int = 3600
) -> DataFrame:
    """T5: results that no newer generation of their key came before."""
    seen = neighbours(results, [key], order, time_slice(order[0], slice_seconds), lowest={"_low": -F.col(generation)})
    return seen.filter(F.col(generation) == -F.col("_low")).drop("_low")


def newest_generation(results: DataFrame, current: DataFrame, key: str, generation: str = "generation") -> DataFrame:
    """Results of the newest generation of their key in the table ``current``."""
    newest = current.groupBy(key).agg(F.max(generation).alias("_newest"))
    joined = results.join(newest, key)
    return joined.filter(F.col(generation) >= F.col("_newest")).drop("_newest")


def once_per_key(events: DataFrame, key: str, order: Sequence[str] = ("ts", "ord")) -> DataFrame:
    """The first submission of each key."""
    others = [c for c in events.columns if c != key]
    first = events.groupBy(key).agg(
        F.min_by(F.struct(*others), F.struct(*order)).alias("_r")
    )
    return first.select(key, "_r.*").select(events.columns)


def song_identity_guard(
    lyrics: DataFrame, songs: DataFrame, tab: str = "tab", slice_seconds: int = 3600
) -> DataFrame:
    """Lyric results whose key is the song playing in the tab when they arrive.

    ``songs`` hold ``[tab, key, from, to]`` reigns (``to`` null while playing). The reigns of a
    tab follow each other, so the one that may hold a result is the last to begin at or before
    it; both tables are merged in time order and nothing is joined.
    """
    row = F.struct(*lyrics.columns)
    reign = F.struct(F.col("key").alias("key"), F.col("to").alias("to"))
    began = songs.select(
        tab, F.col("from").alias("ts"), F.lit(0).alias("_rank"), F.xxhash64(reign).alias("_ord"), reign.alias("_reign"),
        F.lit(None).cast(lyrics.select(row).schema[0].dataType).alias("_row"),
    )
    came = lyrics.select(
        tab, "ts", F.lit(1).alias("_rank"), F.xxhash64(row).alias("_ord"),
        F.lit(None).cast(began.schema["_reign"].dataType).alias("_reign"), row.alias("_row"),
    )
    seen = neighbours(
        began.union(came), [tab], ["ts", "_rank", "_ord"], time_slice("ts", slice_seconds), last={"_now": F.col("_reign")}
    ).filter("_rank = 1")
    open_ = F.col("_now.to").isNull() | (F.col("ts") < F.col("_now.to"))
    return seen.filter((F.col("_row.key") == F.col("_now.key")) & open_).select("_row.*")
