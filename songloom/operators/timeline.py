"""Time-coded text: ends, gaps, pages, and joins with a playback clock.

Lines carry ``time`` and ``line_idx`` per song. A song may hold most of the ticks, so no
join sorts ticks by song: lines become intervals, intervals are listed under the time
buckets they touch, and ticks meet them on (song, bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import interpolate
from ..functions.regex import spread
from ..functions.tokens import line_tokens
from .ordered import neighbours, time_slice

# Fixed values, seconds.
LAST_LINE_TAIL, GAP_MIN, GAP_WORD_TAIL, LEAD, CAPTION_SHIFT = 4.0, 5.0, 1.2, 0.05, 0.3
PAGE_SIZE = 3
LINES_PER_SLICE = 1024
BUCKET_SECONDS = 10.0


def _line_slice(idx: str = "line_idx") -> Column:
    return F.floor(F.col(idx) / LINES_PER_SLICE)


def with_next_time(lines: DataFrame, song: str = "song_id") -> DataFrame:
    """Add ``next_time`` and ``next_idx`` of the following line."""
    return neighbours(
        lines,
        [song],
        ["line_idx"],
        _line_slice(),
        following={"next_time": F.col("time"), "next_idx": F.col("line_idx")},
    )


def line_ends(lines: DataFrame, song: str = "song_id", tail: float = LAST_LINE_TAIL) -> DataFrame:
    """``end`` is the next line's time; the last line lasts ``tail`` seconds."""
    ended = with_next_time(lines, song)
    end = F.coalesce(F.col("next_time"), F.col("time") + tail)
    return ended.withColumn("end", end).drop("next_time", "next_idx")


def lyric_gaps(
    lines: DataFrame,
    song: str = "song_id",
    min_gap: float = GAP_MIN,
    tail: float = GAP_WORD_TAIL,
) -> DataFrame:
    """``[song, gap_idx, start, end, next_idx]``.

    An intro gap before a late first line; between lines only after a word-timed line,
    from its last word plus ``tail``. ``gap_idx`` is the index of the line the gap leads
    to, which orders the gaps of a song.
    """
    timed = with_next_time(lines, song)
    after = F.try_element_at("words", F.lit(-1))["time"] + tail
    intro = timed.filter((F.col("line_idx") == 0) & (F.col("time") > min_gap)).select(
        song, F.lit(0.0).alias("start"), F.col("time").alias("end"), F.lit(0).alias("next_idx")
    )
    between = (
        timed.withColumn("start", after)
        .filter(F.col("next_time") - F.col("start") > min_gap)
        .select(song, "start", F.col("next_time").alias("end"), "next_idx")
    )
    return intro.unionByName(between).withColumn("gap_idx", F.col("next_idx"))


def page_of(idx: Column | str, size: int = PAGE_SIZE) -> Column:
    """Page of a line index; an index below 0 counts as 0."""
    idx = F.col(idx) if isinstance(idx, str) else idx
    return F.floor(F.greatest(idx, F.lit(0)) / size)


def dedupe_consecutive(
    captions: DataFrame,
    key: str = "doc_id",
    order: str = "cue_idx",
    shift: float = CAPTION_SHIFT,
) -> DataFrame:
    """Drop empty captions and those equal to the one before; shift the rest earlier."""
    shown = captions.filter(F.coalesce(F.col("text"), F.lit("")) != "")
    seen = neighbours(
        shown,
        [key],
        [order],
        F.floor(F.col(order) / LINES_PER_SLICE),
        previous={"_before": F.col("text")},
    )
    changed = seen.filter(~F.col("text").eqNullSafe(F.col("_before"))).drop("_before")
    return changed.withColumn("time", F.greatest(F.col("time") - shift, F.lit(0.0)))


# ── Clock joins ──────────────────────────────────────────────────────────────

def _touched(start: Column, end: Column, width: float) -> Column:
    """Buckets an interval touches; an empty interval touches none."""
    listed = F.sequence(F.floor(start / width), F.floor(end / width))
    return F.when(end > start, listed)


def interval_join(
    ticks: DataFrame,
    intervals: DataFrame,
    song: str,
    at: Column,
    width: float = BUCKET_SECONDS,
) -> DataFrame:
    """Pairs with ``start ≤ at < end`` of the same song.

    ``intervals`` are finite and carry ``start`` and ``end``. A long interval is listed
    under every bucket it touches; a tick has one bucket, so a pair appears once.
    """
    left = ticks.withColumn("_at", at).withColumn("_bucket", F.floor(F.col("_at") / width))
    right = intervals.withColumn(
        "_bucket", F.explode(_touched(F.col("start"), F.col("end"), width))
    )
    inside = (F.col("_at") >= F.col("start")) & (F.col("_at") < F.col("end"))
    return left.join(right, [song, "_bucket"]).filter(inside).drop("_at", "_bucket")


def clock(lead: float = LEAD) -> Column:
    """Tick time with the highlight lead, which applies only while playing."""
    return F.col("t") + F.when(F.col("paused"), 0.0).otherwise(lead)


def asof_line(
    ticks: DataFrame, lines: DataFrame, song: str = "song_id", lead: float = LEAD
) -> DataFrame:
    """Add ``line_idx`` of the last line with ``time ≤ t + lead``, −1 before the first.

    A line reigns from its time to the next line's. Of lines sharing a time only the last
    has a reign of non-zero length, so ties take the highest index. The last line reigns
    for ever; ticks after it meet it on the song alone.
    """
    reigns = with_next_time(lines.select(song, "line_idx", "time"), song)
    bounded = reigns.filter("next_time is not null").select(
        song, "line_idx", F.col("time").alias("start"), F.col("next_time").alias("end")
    )
    final = reigns.filter("next_time is null").select(
        song, F.col("line_idx").alias("_final_idx"), F.col("time").alias("_final_from")
    )
    placed = ticks.join(final, song, "left")
    at = clock(lead)
    after = F.coalesce(at >= F.col("_final_from"), F.lit(False))
    width = BUCKET_SECONDS
    left = placed.withColumn("_bucket", F.when(~after, F.floor(at / width)))
    right = bounded.withColumn(
        "_bucket", F.explode(_touched(F.col("start"), F.col("end"), width))
    ).select(F.col(song).alias("_song"), F.col("_bucket").alias("_b"), "line_idx", "start", "end")
    inside = (
        (F.col(song) == F.col("_song"))
        & (F.col("_bucket") == F.col("_b"))
        & (at >= F.col("start"))
        & (at < F.col("end"))
    )
    idx = F.when(after, F.col("_final_idx")).otherwise(F.coalesce(F.col("line_idx"), F.lit(-1)))
    return left.join(right, inside, "left").select(*ticks.columns, idx.cast("int").alias("line_idx"))


def gap_at(
    ticks: DataFrame, gaps: DataFrame, song: str = "song_id", lead: float = LEAD
) -> DataFrame:
    """Add ``gap_idx`` (gap showing) and ``staged_idx`` (line staged), null if none.

    A gap shows for ``start ≤ t < end − 1``; in its last second the next line is staged.
    Ticks carry a unique ``tick_id``.
    """
    shows = gaps.select(
        song, "start", (F.col("end") - 1).alias("end"), "gap_idx", F.lit(None).cast("int").alias("staged")
    )
    stages = gaps.select(
        song,
        (F.col("end") - 1).alias("start"),
        "end",
        F.lit(None).cast("int").alias("gap_idx"),
        F.col("next_idx").cast("int").alias("staged"),
    )
    hits = (
        interval_join(
            ticks.select(song, "tick_id", "t", "paused"), shows.union(stages), song, clock(lead)
        )
        .groupBy("tick_id")
        .agg(F.min("gap_idx").alias("gap_idx"), F.min("staged").alias("staged_idx"))
    )
    return ticks.join(hits, "tick_id", "left")


def word_table(lines: DataFrame, song: str = "song_id", tail: float = LAST_LINE_TAIL) -> DataFrame:
    """One row per word: ``[song, line_idx, word_idx, word, from, to]``.

    Measured times are used when their count equals the number of rendered words, each
    word ending where the next begins and the last at the line's end. Otherwise the
    line is cut into equal slices.
    """
    ended = line_ends(lines, song, tail)
    texts = F.when(F.col("words").isNotNull(), F.transform("words", lambda w: w["text"]))
    shown = F.transform(
        F.filter(line_tokens("text", texts), lambda t: t["isWord"]), lambda t: t["text"]
    )
    ended = ended.withColumn("_shown", shown)
    kept = [song, "line_idx", "time", "end", "words", F.size("_shown").alias("n")]
    rows = spread(ended, kept, F.col("_shown"), "word_idx", "word")
    i, n = F.col("word_idx"), F.col("n")
    span = F.greatest(F.col("end") - F.col("time"), F.lit(0.001))
    measured = F.coalesce(F.size("words") == n, F.lit(False))
    begins = F.when(measured, F.get("words", i)["time"]).otherwise(F.col("time") + span * i / n)
    following = F.coalesce(F.get("words", i + 1)["time"], F.col("end"))
    ends = F.when(measured, following).otherwise(F.col("time") + span * (i + 1) / n)
    return rows.select(song, "line_idx", "word_idx", "word", begins.alias("from"), ends.alias("to"))


def word_at(
    ticks: DataFrame, lines: DataFrame, song: str = "song_id", lead: float = LEAD
) -> DataFrame:
    """State of every word of the line under the clock, and the singing percentage.

    ``state`` is sung, singing or upcoming. In an estimated line with the clock past the
    end every word is sung.
    """
    placed = asof_line(ticks, lines, song, lead).filter("line_idx >= 0")
    words = word_table(lines, song)
    t = clock(lead)
    state = F.when(t >= F.col("to"), "sung").when(t >= F.col("from"), "singing").otherwise("upcoming")
    share = 100 * (t - F.col("from")) / (F.col("to") - F.col("from"))
    percent = F.when(F.col("to") > F.col("from"), F.least(F.greatest(share, F.lit(0.0)), F.lit(100.0))).otherwise(100.0)
    return (
        placed.join(words, [song, "line_idx"])
        .withColumn("state", state)
        .withColumn("percent", F.when(F.col("state") == "singing", F.round(percent, 1)))
        .drop("from", "to")
    )


#: Grid instants that are listed together.
TICKS_PER_PIECE = 1000


def playback_ticks(
    states: DataFrame, key: str = "song_id", step_ms: int = 200, slice_seconds: int = 3600, order: Sequence[str] = ("ts",)
) -> DataFrame:
    """Resample sparse states ``[key, ts, time, duration, paused]`` to a fixed grid.

    Each state rules from the first grid instant at or after it up to the next state;
    the last state yields its own instant only. No grid is joined: every state lists its
    instants, with the playhead interpolated from it. A long reign is cut into pieces first,
    which are dealt out before their instants are listed. ``order`` is unique per key.
    """
    ruled = neighbours(
        states, [key], order, time_slice("ts", slice_seconds), following={"_next": F.col("ts")}
    )
    start = F.ceil(F.unix_millis("ts") / step_ms) * step_ms
    until = F.ceil(F.unix_millis("_next") / step_ms) * step_ms - step_ms
    until = F.coalesce(until, start)
    step, piece = F.lit(step_ms).cast("long"), F.lit(step_ms * TICKS_PER_PIECE).cast("long")
    pieces = F.when(until >= start, F.sequence(start.cast("long"), until.cast("long"), piece))
    state = [key, "ts", "time", "duration", "paused"]
    cut_up = ruled.select(*state, until.cast("long").alias("_until"), F.explode(pieces).alias("_piece"))
    dealt = cut_up.repartition(F.col(key), F.col("_piece"))
    listed = F.sequence(F.col("_piece"), F.least(F.col("_piece") + piece - step, F.col("_until")), step)
    grid = dealt.select(*state, F.explode(listed).alias("ms"))
    return grid.select(
        key,
        F.timestamp_millis("ms").alias("ts"),
        interpolate("time", F.unix_millis("ts"), "paused", "ms").alias("t"),
        "duration",
        "paused",
    )


def pause_detection(
    polls: DataFrame, key: str = "song_id", stall_ms: int = 1600, slice_seconds: int = 3600, order: Sequence[str] = ("ts",)
) -> DataFrame:
    """``paused`` when the shown position has not changed for more than ``stall_ms``.

    The first poll of a key counts as a change. ``order`` is unique per key.
    """
    piece = time_slice("ts", slice_seconds)
    seen = neighbours(polls, [key], order, piece, previous={"_before": F.col("position")})
    changed = ~F.col("position").eqNullSafe(F.col("_before"))
    at = F.when(changed, F.unix_millis("ts"))
    seen = seen.withColumn("_changed", at)
    seen = neighbours(seen, [key], order, piece, last={"_last": F.col("_changed")})
    since = F.unix_millis("ts") - F.coalesce("_changed", "_last")
    return seen.withColumn("paused", since > stall_ms).drop("_before", "_changed", "_last")
