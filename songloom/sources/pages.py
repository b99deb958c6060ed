"""Raw web pages to lyric text and song metadata."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import html_to_text
from ..functions.regex import groups, has, spread, strip, sub, text
from ..functions.text import clean_title, strip_topic

LYRICS_MARKER = 'data-lyrics-container="true"'
MIN_LYRICS = 30

_TAG_EDGE = re.compile(r"<div|</div")


def marked_blocks(html: str | None, marker: str) -> list[str]:
    """Inner HTML of every ``<div>`` carrying the marker, nested ``<div>`` included."""
    blocks: list[str] = []
    if not html:
        return blocks
    at = html.find(marker)
    while at != -1:
        body = html.find(">", at) + 1
        if not body:
            break
        depth, resume = 1, body
        for edge in _TAG_EDGE.finditer(html, body):
            opening = edge.group() == "<div"
            depth += 1 if opening else -1
            if not opening:
                resume = html.find(">", edge.end()) + 1 or len(html)
            if depth == 0:
                blocks.append(html[body : edge.start()])
                break
        at = html.find(marker, resume)
    return blocks


def clean_lyrics(c: Column) -> Column:
    """Without the contributors preamble and the embed footer."""
    c = sub(c, r"^\s*(?:read more\s*)?\d+\s*contributors?[\s\S]*?lyrics\s*\n+", "", True)
    return strip(sub(c, r"\d*\s*Embed\s*$", "", True))


def pages_lyrics(
    pages: DataFrame, key: str = "page_id", html: str = "html", marker: str = LYRICS_MARKER
) -> DataFrame:
    """``[key, text]`` of pages whose marked blocks hold 30 characters or more.

    Finding a block's end means counting nested tags, which no regular expression does;
    only that cut runs in Python, on pages that carry the marker at all. Pages go there row by row
    in short batches: an Arrow batch holds ten thousand of them, several times over.
    """
    blocks = F.udf(lambda h: marked_blocks(h, marker), "array<string>", useArrow=False)
    marked = pages.select(key, html).filter(F.contains(html, F.lit(marker)))
    joined = strip(F.array_join(F.transform(blocks(html), html_to_text), "\n"))
    long_enough = F.filter(F.array(clean_lyrics(joined)), lambda s: F.length(s) >= MIN_LYRICS)
    return spread(marked, [key], long_enough, "at", "text").select(key, "text")


_SCRIPT = r"(?is)<script\b([^>]*)>(.*?)</script\s*>"
_PLAYER = "ytInitialPlayerResponse"
_STRING_OR_BRACE = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]|\\.', re.S)


def json_after(script: str | None, marker: str = _PLAYER) -> str | None:
    """The JSON object that follows a marker, cut at its matching brace."""
    at = script.find(marker) if script else -1
    start = script.find("{", at + len(marker)) if at != -1 else -1
    if start == -1:
        return None
    depth = 0
    for token in _STRING_OR_BRACE.finditer(script, start):
        depth += {"{": 1, "}": -1}.get(token.group(), 0)
        if depth == 0:
            return script[start : token.end()]
    return None


def _meta(track: Column, artist: Column, source: str) -> Column:
    track, artist = strip(text(track)), strip(text(artist))
    return F.struct(track.alias("track"), artist.alias("artist"), F.lit(source).alias("source"))


def _text_of(node: Column, path: str) -> Column:
    return text(F.try_variant_get(node, path, "string"))


def _linked_data(html: Column) -> Column:
    """Music items of the schema.org blocks; a block may be one object or an array."""
    kinds, bodies = groups(html, _SCRIPT, 1), groups(html, _SCRIPT, 2)
    typed = F.zip_with(
        kinds, bodies, lambda k, b: F.when(has(k, r"type\s*=\s*[\"']application/ld\+json[\"']", True), b)
    )
    nodes = F.transform(F.array_compact(typed), F.try_parse_json)

    def items(node: Column) -> Column:
        return F.coalesce(F.try_variant_get(node, "$", "array<variant>"), F.array(node))

    music = F.filter(
        F.flatten(F.transform(F.array_compact(nodes), items)),
        lambda n: _text_of(n, "$['@type']").isin("MusicVideoObject", "MusicRecording")
        & (strip(_text_of(n, "$.name")) != ""),
    )

    def artist(n: Column) -> Column:
        named = F.nullif(_text_of(n, "$.byArtist.name"), F.lit(""))
        return F.coalesce(named, _text_of(n, "$.byArtist"))

    found = F.transform(music, lambda n: _meta(_text_of(n, "$.name"), artist(n), "schema"))
    return F.get(found, F.lit(0))


# Elements that hold the channel name, most specific first.
_CHANNEL = [
    r"(?is)<ytd-video-owner-renderer\b.*?<ytd-channel-name\b.*?<a\b[^>]*>(.*?)</a>",
    r"(?is)<ytd-channel-name\b.*?<a\b[^>]*\byt-formatted-string\b[^>]*>(.*?)</a>",
    r"(?is)\bid=[\"']owner-name[\"'].*?<a\b[^>]*>(.*?)</a>",
    r"(?is)\bid=[\"']channel-name[\"'].*?<a\b[^>]*>(.*?)</a>",
]


def _channel(html: Column) -> Column:
    names = F.array(
        *(strip(strip_topic(strip(html_to_text(F.regexp_extract(html, p, 1))))) for p in _CHANNEL)
    )
    artist = F.get(F.filter(names, lambda n: n != ""), F.lit(0))
    title = html_to_text(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1))
    return F.when(artist.isNotNull(), _meta(clean_title(strip(title)), artist, "dom"))


def pages_song_metadata(
    pages: DataFrame, key: str = "page_id", html: str = "html"
) -> DataFrame:
    """``[key, track, artist, source]`` from linked data, player data, or the channel.

    Only pages naming the player data visit Python, for the brace-balanced cut; the
    JSON itself is read natively.
    """
    schema = f"{key} {pages.schema[key].dataType.simpleString()}, html string, player array<string>"
    base = pages.select(key, F.col(html).alias("html"))
    script = re.compile(r"<script\b[^>]*>(.*?)</script\s*>", re.I | re.S)

    def cut(batches):
        for pdf in batches:
            found = pdf["html"].map(
                lambda h: [j for j in (json_after(s) for s in script.findall(h)) if j]
            )
            yield pdf.assign(player=found)

    has_player = F.coalesce(F.contains("html", F.lit(_PLAYER)), F.lit(False))
    plain = base.filter(~has_player).withColumn("player", F.array().cast("array<string>"))
    both = plain.union(base.filter(has_player).mapInPandas(cut, schema))
    details = F.transform(F.array_compact(F.transform("player", F.try_parse_json)), lambda n: _meta(
        _text_of(n, "$.videoDetails.title"), strip_topic(strip(_text_of(n, "$.videoDetails.author"))), _PLAYER))
    player = F.get(F.filter(details, lambda d: d["track"] != ""), F.lit(0))
    page = F.col("html")
    linked = F.when(F.contains(page, F.lit("ld+json")), _linked_data(page))
    channel = F.when(page.rlike("(?i)ytd-|owner-name|channel-name"), _channel(page))
    found = F.array_compact(F.array(F.coalesce(linked, player, channel)))
    return spread(both, [key], found, "at", "m").select(key, "m.track", "m.artist", "m.source")


def page_title(html: Column | str) -> Column:
    """Text of the ``<title>`` element, as a raw title for the parser."""
    raw = F.regexp_extract(text(html), r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    return strip(html_to_text(raw))


