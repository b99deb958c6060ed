"""Titles to ordered (artist, track) candidates, as one array expression per title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.regex import group, has, parts, pieces, spread, strip, text

CANDIDATES = "array<struct<artist:string,track:string,album:string>>"
_SEEDS = "array<struct<artist:string,track:string,album:string,credit:boolean>>"

_DASH = r"\s+[-–—]\s+"

# Rules yield *seeds*: a pair plus a flag saying whether its artist is a credit that
# may name several people. Credits are expanded once, over the joined seed array, and
# lambda bodies refer to bound variables only, so no expression is evaluated twice.


def _seed(artist: Column, track: Column, album: Column | None = None, credit: bool = True) -> Column:
    album = F.lit("") if album is None else album
    return F.struct(
        artist.alias("artist"), track.alias("track"), album.alias("album"), F.lit(credit).alias("credit")
    )


def _bare(track: Column) -> Column:
    """A seed without an artist."""
    return _seed(F.lit(""), track, credit=False)


def _none() -> Column:
    return F.array().cast(_SEEDS)


def _if(condition: Column, *seeds: Column) -> Column:
    return F.when(condition, F.array(*seeds)).otherwise(_none())


def _pair(artist: Column, track: Column, album: Column) -> Column:
    return F.struct(artist.alias("artist"), track.alias("track"), album.alias("album"))


def split_artists(artist: Column) -> Column:
    """Single names of a joint credit; empty when the credit is one name."""
    listed = r"[,&]|(?=f)(?:\bfeat\.?\b|\bft\.?\b|\bfeaturing\b)"
    cut = r"\s*(?:,|&|\bfeaturing\b|\bfeat\.?\b|\bft\.?\b)\s*"
    crossed = parts(artist, r"\s+x\s+", True)
    duet = (F.size(crossed) == 2) & F.forall(crossed, tx.looks_like_name)
    names = (
        F.when(has(artist, listed, True), pieces(artist, cut, True))
        .when(has(artist, r"\s+x\s+", True), F.when(duet, F.transform(crossed, strip)))
    )
    names = F.coalesce(names, F.array().cast("array<string>"))
    return F.filter(names, lambda n: (n != "") & (F.lower(n) != F.lower(artist)))


def expand_artists(seeds: Column) -> Column:
    """Each credit as written, followed by each of its single names."""

    def one(seed: Column) -> Column:
        whole = F.array(_pair(seed["artist"], seed["track"], seed["album"]))
        single = F.transform(
            split_artists(seed["artist"]), lambda n: _pair(n, seed["track"], seed["album"])
        )
        return F.when(seed["credit"], F.concat(whole, single)).otherwise(whole)

    trimmed = F.transform(
        seeds,
        lambda c: F.struct(
            strip(text(c["artist"])).alias("artist"),
            strip(text(c["track"])).alias("track"),
            strip(text(c["album"])).alias("album"),
            c["credit"].alias("credit"),
        ),
    )
    return F.flatten(F.transform(trimmed, one))


def word_boundary_splits(words: Column) -> Column:
    """Every (leading words, remaining words) pair of 2–6 words."""
    n = F.size(words)

    def cut(i: Column) -> Column:
        return _seed(
            F.array_join(F.slice(words, F.lit(1), i), " "),
            F.array_join(F.slice(words, i + 1, n - i), " "),
            credit=False,
        )

    return F.when(n.between(2, 6), F.transform(F.sequence(F.lit(1), n - 1), cut)).otherwise(_none())


def _keyed(candidates: Column) -> Column:
    """Candidates with their identity, those without a track left out."""
    keyed = F.transform(
        candidates,
        lambda c: F.struct(
            c["artist"].alias("artist"),
            c["track"].alias("track"),
            c["album"].alias("album"),
            tx.candidate_key(c["artist"], c["track"], c["album"]).alias("key"),
        ),
    )
    return F.filter(keyed, lambda c: c["track"] != "")


def dedupe_candidates(keyed: Column) -> Column:
    """W10 inside one title: first occurrence per identity, order kept."""
    first = F.filter(keyed, lambda c, i: F.array_position(keyed["key"], c["key"]) == i + 1)
    return F.transform(first, lambda c: _pair(c["artist"], c["track"], c["album"]))


def _found_track(author: Column, artist: Column, track: Column) -> Column:
    """A track marked inside the title: with its artist, the author, and alone."""
    seeds = [F.when(artist != "", _seed(artist, track)), F.when(author != "", _seed(author, track))]
    return F.array_compact(F.array(*seeds, _bare(track)))


def _pipe_parts(title: Column) -> Column:
    cut = F.transform(
        parts(title, r"\s*\|\s*"), lambda s: tx.strip_colon_noise(tx.strip_num(strip(s)))
    )
    kept = F.filter(cut, lambda s: (s != "") & ~tx.looks_like_noise(s) & ~tx.is_label(s))
    return F.when(F.contains(title, F.lit(" | ")), kept).otherwise(F.array().cast("array<string>"))


def _metadata_columns(df: DataFrame, raw: Column, track: Column, artist: Column) -> DataFrame:
    """Rule 1: page metadata, trusted only when it agrees with the title."""
    df = df.withColumns(
        {
            "_ma": tx.clean_artist(tx.strip_topic(artist)),
            "_mt": tx.clean_title(track),
            "_kr": F.when(track != "", tx.normalize_for_match(raw)).otherwise(""),
            "_km": F.when(track != "", tx.normalize_for_match(track)).otherwise(""),
        }
    )
    kr, km, artist = F.col("_kr"), F.col("_km"), F.col("_ma")
    agrees = (kr != "") & (km != "") & (F.contains(kr, km) | F.contains(km, kr))
    df = df.withColumn(
        "_mt",
        F.when(agrees & (artist != ""), tx.strip_artist_from_track(artist, "_mt")).when(
            agrees, F.col("_mt")
        ),
    )
    track = F.col("_mt")
    usable = track.isNotNull() & (track != "") & ~has(track, _DASH)
    named = F.when(artist != "", _seed(artist, track)).otherwise(_bare(track))
    return df.withColumn("_r1", _if(usable, named))


def parse_titles(
    titles: DataFrame,
    title: str = "raw_title",
    meta_track: str | None = None,
    meta_artist: str | None = None,
    author: str | None = None,
) -> DataFrame:
    """N1 as a column: add ``candidates``, most trusted first, without duplicates.

    Hint columns are optional. Each rule is an array expression; rules that end the
    search are branches of one ``CASE``. Nothing is shuffled.
    """

    def hint(c: str | None) -> Column:
        return text(c) if c else F.lit("")

    df = titles.withColumns(
        {"_title": tx.clean_title(title), "_author": tx.clean_artist(tx.strip_topic(hint(author)))}
    )
    if meta_track:
        df = _metadata_columns(df, text(title), text(meta_track), hint(meta_artist))
    else:
        df = df.withColumn("_r1", _none())
    t, a = F.col("_title"), F.col("_author")
    df = df.withColumns(
        {
            "_dots": parts(t, r"\s+[·•]\s+"),
            "_pipes": _pipe_parts(t),
            "_dashes": pieces(t, _DASH),
            "_words": pieces(t, r"\s+"),
            "_colon": tx.split_colon(t),
            "_quoted": F.when(has(t, "[“\"‘']"), tx.extract_quoted(t)),
        }
    )
    dots, pipes, dashes, colon, quoted = (
        F.col(c) for c in ("_dots", "_pipes", "_dashes", "_colon", "_quoted")
    )
    first_pipe, second_pipe = F.get(pipes, F.lit(0)), F.get(pipes, F.lit(1))
    d0, d1 = F.get(dashes, F.lit(0)), F.get(dashes, F.lit(1))
    directed = (a != "") & (F.size(dashes) >= 2)
    cjk = r"^(.+?)【([^】]{1,80})】"
    key = {
        n: F.when(directed, tx.normalize_for_match(c)).otherwise("")
        for n, c in (("_k0", d0), ("_k1", d1), ("_ka", a))
    }
    df = df.withColumns(
        {
            **key,
            "_inner": F.when(has(first_pipe, _DASH), pieces(first_pipe, _DASH)),
            "_qt": tx.prefer_gloss(quoted["inner"]),
            "_qa": tx.clean_artist(quoted["before"]),
            "_bt": F.when(has(t, cjk), strip(group(t, cjk, 2))),
            "_ba": tx.clean_artist(group(t, cjk, 1)),
            "_rest": F.when(a != "", tx.strip_artist_from_track(a, t)),
        }
    )
    swap = F.when(
        directed, tx.keys_strong(F.col("_k1"), F.col("_ka")) & ~tx.keys_strong(F.col("_k0"), F.col("_ka"))
    ).otherwise(False)
    df = df.withColumns(
        {"_artist": F.when(swap, d1).otherwise(d0), "_track": F.when(swap, d0).otherwise(d1)}
    )
    da, dt, inner, rest = (F.col(c) for c in ("_artist", "_track", "_inner", "_rest"))
    right = group(t, r"^(.+?)\s+[-–—]\s+(.+)$", 2)
    pipe_artist = F.get(inner, F.lit(0))
    pipe_track = F.coalesce(F.get(inner, F.lit(1)), pipe_artist)

    by_author = F.when(
        rest != t, F.array(_seed(a, rest), _bare(rest))
    ).otherwise(F.array(_seed(a, t)))
    left, right_side = colon["left"], colon["right"]
    no_pipe = (
        F.when(
            F.size(dashes) >= 2,
            F.array(_seed(da, dt), _seed(dt, da), _bare(dt), _bare(da), _bare(right)),
        )
        .when(
            colon.isNotNull(),
            F.array(_seed(left, right_side), _seed(right_side, left), _bare(right_side)),
        )
        .otherwise(
            F.concat(
                F.when(a != "", by_author).otherwise(_none()),
                word_boundary_splits(F.col("_words")),
            )
        )
    )
    one_pipe = F.concat(
        _if(F.size(pipes) == 1, _bare(first_pipe)),
        _if((F.size(pipes) == 1) & (a != ""), _seed(a, first_pipe)),
    )
    marked = F.concat(
        F.when(
            quoted.isNotNull() & (F.col("_qt") != ""), _found_track(a, F.col("_qa"), F.col("_qt"))
        ).otherwise(_none()),
        F.when(
            tx.looks_like_name(F.col("_bt")), _found_track(a, F.col("_ba"), F.col("_bt"))
        ).otherwise(_none()),
    )
    searched = F.concat(
        marked,
        F.when(
            inner.isNotNull(),
            F.concat(
                _if(second_pipe.isNotNull(), _seed(pipe_artist, pipe_track, second_pipe)),
                F.array(_seed(pipe_artist, pipe_track), _bare(pipe_track)),
            ),
        )
        .when(
            F.size(pipes) >= 2,
            F.array(
                _seed(first_pipe, second_pipe),
                _seed(second_pipe, first_pipe),
                _bare(first_pipe),
                _bare(second_pipe),
            ),
        )
        .otherwise(F.concat(one_pipe, no_pipe)),
    )
    song_by = r"^(.+?)\s*[-–—]\s*song(?: and lyrics)? by (.+)$"
    listed = F.array_join(F.slice(dots, 2, F.greatest(F.size(dots) - 1, F.lit(0))), ", ")
    rules = (
        F.when(F.size(dots) >= 2, F.array(_seed(listed, F.get(dots, F.lit(0)))))
        .when(
            has(t, song_by, True),
            F.array(_seed(group(t, song_by, 2, True), group(t, song_by, 1, True))),
        )
        .otherwise(searched)
    )
    df = df.withColumn("_seeds", F.concat("_r1", rules, F.array(_bare(t))))
    df = df.withColumn("_all", expand_artists(F.col("_seeds")))
    unnamed = F.filter(F.col("_all"), lambda c: (c["artist"] == "") & (c["track"] != ""))
    by_channel = F.when(
        a != "", F.transform(unnamed, lambda c: _pair(a, c["track"], c["album"]))
    ).otherwise(F.array().cast(CANDIDATES))
    df = df.withColumn("_all", F.concat(F.col("_all"), by_channel))
    df = df.withColumn("_keyed", _keyed(F.col("_all")))
    return df.select(*titles.columns, dedupe_candidates(F.col("_keyed")).alias("candidates"))


def explode_candidates(parsed: DataFrame, keep: int | None = None) -> DataFrame:
    """One row per candidate with ``prio`` from 0; ``keep`` is the top-k of the lookup.

    ``keep`` cuts the array before it is exploded, so nothing is shuffled for it.
    """
    source = F.col("candidates") if keep is None else F.slice("candidates", 1, keep)
    columns = [c for c in parsed.columns if c != "candidates"]
    rows = spread(parsed, columns, source, "prio", "c")
    return rows.select(*columns, "prio", "c.artist", "c.track", "c.album")


def build_requests(candidates: DataFrame) -> DataFrame:
    """Lookup keys per candidate: ``name`` (folded, no duration) and ``search`` text.

    The name key needs an artist. Equal keys are one request each (U2) once the
    caller selects the key columns and takes ``distinct``.
    """
    artist, track = text("artist"), text("track")
    query = F.when(artist != "", F.concat(track, F.lit(" "), artist)).otherwise(track)
    folded_artist = F.coalesce(F.nullif(tx.ascii_fold(artist), F.lit("")), artist)
    folded_track = F.coalesce(F.nullif(tx.ascii_fold(track), F.lit("")), track)

    def request(kind: str, a: Column, t: Column, q: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), a.alias("key_artist"), t.alias("key_track"), q.alias("query")
        )

    nothing = F.lit(None).cast("string")
    requests = F.array(
        F.when((artist != "") & (track != ""), request("name", folded_artist, folded_track, nothing)),
        F.when(track != "", request("search", nothing, nothing, query)),
    )
    rows = spread(candidates, candidates.columns, F.array_compact(requests), "at", "r")
    return rows.select(*candidates.columns, "r.kind", "r.key_artist", "r.key_track", "r.query")
