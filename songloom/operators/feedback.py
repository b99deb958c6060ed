"""Votes, requests and remembered outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import round_half_up
from ..functions.records import normalize_vote
from ..functions.regex import parts, strip, text
from .linkage import top_k
from .ordered import neighbours, time_slice

# ── Votes ────────────────────────────────────────────────────────────────────


def latest_per_user(votes: DataFrame, user: str = "user", key: str = "video_key") -> DataFrame:
    """The newest vote of each (user, key); history stays in the log."""
    others = [c for c in votes.columns if c not in (user, key)]
    newest = votes.groupBy(user, key).agg(
        F.max_by(F.struct(*others), F.struct("ts", "ord")).alias("_v")
    )
    return newest.select(user, key, "_v.*")


def vote_tally(votes: DataFrame, user: str = "user", key: str = "video_key") -> DataFrame:
    """A1: likes, dislikes and share of likes in percent per key, one vote per user.

    Needs ``liked`` or ``rating``. The share is null when nobody voted.
    """
    newest = latest_per_user(votes, user, key)
    liked = normalize_vote("liked", "rating")
    counted = newest.groupBy(key).agg(
        F.count_if(F.coalesce(liked, F.lit(False))).alias("likes"),
        F.count_if(F.coalesce(~liked, F.lit(False))).alias("dislikes"),
    )
    total = F.col("likes") + F.col("dislikes")
    share = F.when(total > 0, round_half_up(100 * F.col("likes") / total))
    return counted.withColumn("share", share.cast("long"))


def star_average(votes: DataFrame, key: str = "video_key") -> DataFrame:
    """A2: mean and count of star ratings per key."""
    rated = votes.filter(F.col("rating") > 0)
    return rated.groupBy(key).agg(F.avg("rating").alias("avg"), F.count("rating").alias("count"))


def stats_lookup(keys: DataFrame, stats: DataFrame, key: str = "video_key") -> DataFrame:
    """Likes and dislikes of a batch of keys, each once, zero without votes."""
    asked = keys.select(key).distinct()
    return asked.join(stats.select(key, "likes", "dislikes"), key, "left").fillna(
        0, ["likes", "dislikes"]
    )


# ── Remembered outcomes ──────────────────────────────────────────────────────

DAY = 86_400
# Seconds an outcome suppresses a request; None is for ever. Codes that
# are not listed are not kept.
OUTCOME_TTL: dict[str, int | None] = {
    "already_synced": None,
    "queued": 30 * DAY,
    "already_queued": 30 * DAY,
    "recently_failed": 7 * DAY,
    "bad_lyrics": 7 * DAY,
    "unsupported_source": 7 * DAY,
    "bad_request": 7 * DAY,
    "rate_limited": DAY,
}
MISS_TTL = 600
FOREVER = "9999-12-31 00:00:00"


def expires_at(reason: Column, ts: Column) -> Column:
    """End of an outcome's effect; null for codes that are not kept."""
    out = None
    for code, ttl in OUTCOME_TTL.items():
        end = F.lit(FOREVER).cast("timestamp")
        if ttl is not None:
            end = F.timestamp_micros(F.unix_micros(ts) + ttl * 1_000_000)
        out = F.when(reason == code, end) if out is None else out.when(reason == code, end)
    return out


def ttl_outcomes(outcomes: DataFrame, key: str = "video_key") -> DataFrame:
    """The newest kept outcome per key with ``expires_at``."""
    kept = outcomes.withColumn("expires_at", expires_at(F.col("reason"), F.col("ts"))).filter(
        "expires_at is not null"
    )
    newest = kept.groupBy(key).agg(
        F.max_by(F.struct("reason", "ts", "expires_at"), F.struct("ts", "ord")).alias("_o")
    )
    return newest.select(key, "_o.*")


def unrequested(
    requests: DataFrame, outcomes: DataFrame, key: str = "video_key", slice_seconds: int = 86_400
) -> DataFrame:
    """Requests whose key had no outcome in force at the request's ``ts``.

    ``outcomes`` is the log of ``key, reason, ts, ord``. What counts is the last outcome told
    at or before the request that has a lifetime: a later one holds nothing back before it was
    told. Both logs are merged in time order; nothing is joined.
    """
    row = F.struct(*requests.columns)
    until = expires_at(F.col("reason"), F.col("ts"))
    told = outcomes.select(
        key, "ts", F.lit(0).alias("_rank"), F.col("ord").cast("long").alias("_ord"), until.alias("_until"),
        F.lit(None).cast(requests.select(row).schema[0].dataType).alias("_row"),
    ).filter(F.col("_until").isNotNull() & F.col(key).isNotNull())
    asked = requests.select(
        key, "ts", F.lit(1).alias("_rank"), F.xxhash64(row).alias("_ord"), F.lit(None).cast("timestamp").alias("_until"),
        row.alias("_row"),
    )
    seen = neighbours(
        told.union(asked), [key], ["ts", "_rank", "_ord"], time_slice("ts", slice_seconds), last={"_held": F.col("_until")}
    ).filter("_rank = 1")
    return seen.filter(F.col("_held").isNull() | (F.col("_held") <= F.col("ts"))).select("_row.*")


def negative_cache(
    lookups: DataFrame,
    misses: DataFrame,
    key: str = "cache_key",
    ttl: int = MISS_TTL,
    slice_seconds: int = 3600,
) -> DataFrame:
    """Add ``suppressed``: the key's newest event is a miss less than ``ttl`` old.

    ``misses`` hold ``ts`` and ``kind`` (``miss`` or ``refresh``, which clears a miss;
    errors are neither). Both logs are merged in time order; nothing is joined.
    """
    event = F.struct("kind", "ts")
    told = misses.filter(F.col("kind").isin("miss", "refresh")).select(
        key, "ts", F.lit(0).alias("_rank"), F.xxhash64(event).alias("_ord"), event.alias("_event"),
        F.lit(None).cast(lookups.select(F.struct("*")).schema[0].dataType).alias("_row"),
    )
    row = F.struct(*lookups.columns)
    asked = lookups.select(
        key, "ts", F.lit(1).alias("_rank"), F.xxhash64(row).alias("_ord"),
        F.lit(None).cast(told.schema["_event"].dataType).alias("_event"), row.alias("_row"),
    )
    seen = neighbours(
        told.union(asked), [key], ["ts", "_rank", "_ord"], time_slice("ts", slice_seconds),
        last={"_last": F.col("_event")},
    ).filter("_rank = 1")
    age = (F.unix_micros("ts") - F.unix_micros("_last.ts")) / 1_000_000
    suppressed = F.coalesce((F.col("_last.kind") == "miss") & (age < ttl), F.lit(False))
    return seen.select("_row.*", suppressed.alias("suppressed"))


def keep_newest(entries: DataFrame, n: int = 500, user: str = "user", key: str = "key") -> DataFrame:
    """The ``n`` newest entries per user; groups are cut before they are shuffled."""
    order = [F.col("ts").desc(), F.col(key)]
    return top_k(entries, [user], order, n, "_rank").drop("_rank")


# ── Requests ─────────────────────────────────────────────────────────────────

MIN_LYRIC_LINES = 4


def line_count(lyrics: Column) -> Column:
    """Non-blank lines."""
    return F.size(F.filter(parts(text(lyrics), "\n"), lambda x: strip(x) != ""))


def should_request_sync(songs: DataFrame, outcomes: DataFrame, key: str = "video_key") -> DataFrame:
    """P10: songs worth a word-timing request, cheapest tests first.

    ``songs`` hold ``resolved_key, trackName, artistName, syncedLyrics, plainLyrics,
    wordTimed, hasWords, ts``; ``outcomes`` is the log that :func:`unrequested` takes.
    """
    lyrics = F.coalesce(F.nullif(F.col("syncedLyrics"), F.lit("")), F.nullif(F.col("plainLyrics"), F.lit("")))
    known = (text("trackName") != "") & (text("artistName") != "")
    named = songs.filter(F.col(key).rlike("^(?:yt|sp):")).filter(F.col("resolved_key") == F.col(key))
    plain = named.filter(known & lyrics.isNotNull()).filter(
        ~F.coalesce("wordTimed", F.lit(False)) & ~F.coalesce("hasWords", F.lit(False))
    )
    return unrequested(plain.filter(line_count(lyrics) >= MIN_LYRIC_LINES), outcomes, key)


def demand_votes(requests: DataFrame, song: str = "song_key", user: str = "user") -> DataFrame:
    """Distinct users asking per song; pairs are reduced before they are counted."""
    return requests.select(song, user).distinct().groupBy(song).agg(F.count(user).alias("votes"))


def top_demand(requests: DataFrame, k: int, song: str = "song_key", user: str = "user") -> DataFrame:
    """The ``k`` most wanted songs; ties by key."""
    return demand_votes(requests, song, user).orderBy(F.col("votes").desc(), song).limit(k)
