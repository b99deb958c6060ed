"""Video keys and other identities taken from URLs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import col, group, has, text
from .text import clean_title

_URL = (
    r"(?is)^\s*([a-z][a-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:\s]+)(?::(\d*))?([^?#]*)(?:\?([^#]*))?"
)


def url_parts(url: Column | str) -> Column:
    """``struct<scheme, host, port, path, query>``, host in lower case; null if malformed."""
    url = col(url)
    names = ("scheme", "host", "port", "path", "query")
    found = [F.regexp_extract(url, _URL, i + 1) for i in range(5)]
    found[0], found[1] = F.lower(found[0]), F.lower(found[1])
    found[3] = F.when(found[3] == "", "/").otherwise(found[3])
    return F.when(url.rlike(_URL), F.struct(*(f.alias(n) for f, n in zip(found, names))))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def query_param(query: Column, name: str) -> Column:
    """First value of a query parameter, decoded; empty when absent."""
    raw = F.regexp_extract(query, rf"(?:^|&){name}=([^&]*)", 1)
    return F.coalesce(F.try_url_decode(raw), raw)


def _bare_host(parts: Column) -> Column:
    return F.regexp_replace(parts["host"], r"^www\.", "")


def _first_segment(path: Column) -> Column:
    return F.regexp_extract(path, r"^/([^/]*)", 1)


def derive_video_key(url: Column | str) -> Column:
    """``yt:<id>``, ``sp:<id>``, or host and path; null when malformed."""
    return _once(url_parts(url), lambda u: _once(_bare_host(u), lambda host: F.when(u.isNotNull(), _key_at(u, host))))


def _key_at(u: Column, host: Column) -> Column:
    path = u["path"]
    video = query_param(u["query"], "v")
    short = _first_segment(path)
    track = F.regexp_extract(path, r"/track/([0-9A-Za-z]{22})(?:/|\z)", 1)
    return (
        F.when(host.rlike(r"(?:^|\.)youtube\.com\z") & (video != ""), F.concat(F.lit("yt:"), video))
        .when((host == "youtu.be") & (short != ""), F.concat(F.lit("yt:"), short))
        .when((host == "open.spotify.com") & (track != ""), F.concat(F.lit("sp:"), track))
        .otherwise(F.concat(host, F.regexp_replace(path, r"/+\z", "")))
    )


def video_id_from_href(href: Column | str) -> Column:
    """id of a watch page, short link or short clip; null otherwise."""
    href = col(href)
    absolute = F.when(F.startswith(href, F.lit("/")), F.concat(F.lit("https://local"), href))
    u = url_parts(F.coalesce(absolute, href))
    found = (
        F.when(u["host"] == "youtu.be", _first_segment(u["path"]))
        .when(u["path"] == "/watch", query_param(u["query"], "v"))
        .otherwise(F.regexp_extract(u["path"], r"^/shorts/([^/?#]+)", 1))
    )
    return F.nullif(found, F.lit(""))


def track_id_from_href(href: Column | str) -> Column:
    """the 22-character track id; null otherwise."""
    return F.nullif(
        F.regexp_extract(col(href), r"/track/([0-9A-Za-z]{22})(?:[/?#]|\z)", 1), F.lit("")
    )


def _canonical(key: Column, encode: bool = False) -> Column:
    ident = F.substr(key, F.lit(4))
    ident = F.replace(F.url_encode(ident), F.lit("+"), F.lit("%20")) if encode else ident
    return F.when(
        F.startswith(key, F.lit("yt:")), F.concat(F.lit("https://www.youtube.com/watch?v="), ident)
    ).when(
        F.startswith(key, F.lit("sp:")), F.concat(F.lit("https://open.spotify.com/track/"), ident)
    )


def url_for_key(key: Column | str, tab_url: Column | str) -> Column:
    """the tab URL only if it means the same key, else the canonical URL, else null."""
    key, tab_url = col(key), col(tab_url)
    return F.when(derive_video_key(tab_url) == key, tab_url).otherwise(_canonical(key))


def playlist_url(key: Column | str, stored_url: Column | str) -> Column:
    """F12 for playlists: the canonical URL, else the stored one."""
    stored = F.nullif(text(stored_url), F.lit(""))
    return F.coalesce(_canonical(col(key), encode=True), stored)


def path_key(url: Column | str) -> Column:
    """path, with the video parameter on the video site."""
    u = url_parts(url)
    return F.when(
        F.endswith(u["host"], F.lit("youtube.com")),
        F.concat(u["path"], F.lit("?v="), query_param(u["query"], "v")),
    ).otherwise(u["path"])


def song_key(url: Column | str, title: Column | str) -> Column:
    """path key and cleaned title; track pages of the player site use the track id."""
    track = track_id_from_href(url)
    head = F.coalesce(F.concat(F.lit("sp:"), track), path_key(url))
    return F.concat_ws("|", head, clean_title(title))


def caption_key(url: Column | str) -> Column:
    """``video|language|translation``; a malformed URL is its own key."""
    q = url_parts(url)["query"]
    key = F.concat_ws("|", *(query_param(q, n) for n in ("v", "lang", "tlang")))
    return F.when(q.isNotNull(), key).otherwise(col(url))


def is_youtube_watch(url: Column | str) -> Column:
    """A watch page with a video id (other hosts pass)."""
    u = url_parts(url)
    youtube = F.endswith(u["host"], F.lit("youtube.com"))
    watch = (u["path"] == "/watch") & (query_param(u["query"], "v") != "")
    return F.coalesce(F.when(youtube, watch).otherwise(F.lit(True)), F.lit(False))


def is_different_path(old: Column | str, new: Column | str, compare_video: bool = False) -> Column:
    """Origin or path differ; with ``compare_video`` also the video parameter."""
    old, new = col(old), col(new)
    a, b = url_parts(old), url_parts(new)

    def place(u: Column) -> Column:
        return F.struct(u["scheme"], u["host"], u["port"], u["path"])

    moved = ~place(a).eqNullSafe(place(b))
    if compare_video:
        on_site = F.endswith(a["host"], F.lit("youtube.com"))
        video = query_param(a["query"], "v") != query_param(b["query"], "v")
        moved = moved | (on_site & video)
    known = a.isNotNull() & b.isNotNull()
    return F.when(known, moved).otherwise(~old.eqNullSafe(new))


def site_of(key: Column | str) -> Column:
    """Namespace of a video key: ``yt``, ``sp`` or ``web``."""
    key = col(key)
    return F.when(has(key, r"^(?:yt|sp):"), group(key, r"^(yt|sp):")).otherwise(F.lit("web"))
