"""How good are candidates and matches against labelled titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.regex import let, text

PASS_FLOOR = 0.85


def _names(artist: str, alternates: str | None):
    others = F.col(alternates) if alternates else F.array().cast("array<string>")
    return F.filter(F.concat(F.array(artist), F.coalesce(others, F.array().cast("array<string>"))), lambda a: a != "")


def candidate_quality(titles: DataFrame, key: str = "title_id") -> DataFrame:
    """A10 per title: is the true pair, and the true track, among the candidates?

    ``titles`` hold ``candidates, trueArtist, trueTrack``. One row per candidate is
    compared with ready keys; titles come back by a ``max`` over booleans. The candidates of a
    title swap the same few names, so keys are made once per title and name.
    """
    names = F.array_distinct(F.flatten(F.transform("candidates", lambda c: F.array(text(c["artist"]), text(c["track"])))))
    known = titles.select(
        key,
        tx.normalize_for_match("trueArtist").alias("ta"),
        tx.normalize_for_match("trueTrack").alias("tt"),
        "candidates",
        let(names, lambda n: F.map_from_arrays(n, F.transform(n, tx.normalize_for_match))).alias("keys"),
    )
    keyed = known.select(key, "ta", "tt", "keys", F.explode_outer("candidates").alias("c")).select(
        key,
        "ta",
        "tt",
        F.coalesce(F.col("keys")[text("c.artist")], F.lit("")).alias("ca"),
        F.coalesce(F.col("keys")[text("c.track")], F.lit("")).alias("ct"),
        text("c.artist").alias("raw"),
    )
    track = F.col("ct") == F.col("tt")
    named = (F.col("raw") == "") | (F.col("ca") == F.col("ta")) | tx.keys_strong(F.col("ca"), F.col("ta"))
    return keyed.groupBy(key).agg(
        F.max(track).alias("track_ok"), F.max(track & named).alias("pair_ok")
    )


def candidate_summary(per_title: DataFrame) -> DataFrame:
    """A10: counts, rates and whether the floor of 85 % is met."""
    n = F.count(F.lit(1))
    return per_title.agg(
        n.alias("titles"),
        F.count_if("pair_ok").alias("pairs"),
        F.count_if("track_ok").alias("tracks"),
        (F.count_if("pair_ok") / n).alias("pair_rate"),
        (F.count_if("pair_ok") >= F.ceil(n * PASS_FLOOR)).alias("passed"),
    )


def match_quality(
    results: DataFrame, truth: DataFrame, key: str = "title_id", alternates: str | None = None
) -> DataFrame:
    """A10 per title: ``hit`` and ``synced`` of the chosen row against the truth.

    ``results`` hold ``artistName, trackName, synced`` (absent titles are misses);
    ``truth`` holds ``trueArtist, trueTrack`` and optionally other accepted artists.
    """
    names = F.transform(_names("trueArtist", alternates), tx.normalize_for_match)
    joined = truth.withColumn("_names", names).join(results, key, "left")
    joined = joined.withColumns(
        {
            "_rt": tx.normalize_for_match("trackName"),
            "_tt": tx.normalize_for_match("trueTrack"),
            "_ra": tx.normalize_for_match("artistName"),
        }
    )
    track = tx.keys_fuzzy(F.col("_rt"), F.col("_tt"))
    any_artist = F.exists("_names", lambda a: tx.keys_strong(F.col("_ra"), a))
    hit = F.col("trackName").isNotNull() & track & ((F.size("_names") == 0) | any_artist)
    return joined.select(
        key, hit.alias("hit"), (hit & F.coalesce("synced", F.lit(False))).alias("hit_synced")
    )


def quality_summary(per_title: DataFrame) -> DataFrame:
    """A10: hits, synced hits and the rate in whole percent."""
    n, hits = F.count(F.lit(1)), F.count_if("hit")
    return per_title.agg(
        n.alias("titles"),
        hits.alias("hits"),
        F.count_if("hit_synced").alias("synced_hits"),
        F.floor(100 * hits / n + 0.5).cast("long").alias("hit_percent"),
    )
