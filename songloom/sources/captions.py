"""Caption documents to cue tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.markup import decode_entities
from ..functions.regex import group, groups, has, parts, spread, squash, strip, sub, text

CUES = "array<struct<time:double,text:string>>"
_JSON3 = "struct<events:array<struct<tStartMs:double,segs:array<struct<utf8:string>>>>>"


def _cues(entries: Column) -> Column:
    return F.filter(entries, lambda c: c["text"] != "").cast(CUES)


def _cue(time: Column, words: Column) -> Column:
    return F.struct(time.alias("time"), words.alias("text"))


def vtt_cues(body: Column | str, need_end: bool = False) -> Column:
    """WebVTT blocks; ``need_end`` asks for an end stamp after the arrow."""
    stamp = r"(\d{1,2}):(\d{2})(?::(\d{2}))?\.(\d{3})\s*-->"
    if need_end:
        stamp += r"\s*\d{1,2}:\d{2}(?::\d{2})?\.\d{3}"

    def cue(block: Column) -> Column:
        a, b, c, ms = (group(block, stamp, i).try_cast("double") for i in (1, 2, 3, 4))
        whole = F.when(c.isNotNull(), a * 3600 + b * 60 + c).otherwise(a * 60 + b)
        below = F.regexp_extract(block, r"(?s)^[^\n]*\n(.*)\z", 1)
        return _cue(whole + ms / 1000, squash(F.regexp_replace(below, "<[^>]*>", "")))

    blocks = F.filter(parts(text(body), r"\r?\n\r?\n+"), lambda b: has(b, stamp))
    return _cues(F.transform(blocks, cue))


def json3_cues(body: Column | str) -> Column:
    """S3: JSON caption events having segments and a start."""
    events = F.from_json(text(body), _JSON3)["events"]
    usable = F.filter(events, lambda e: e["segs"].isNotNull() & e["tStartMs"].isNotNull())

    def cue(e: Column) -> Column:
        joined = F.array_join(
            F.transform(e["segs"], lambda s: F.coalesce(s["utf8"], F.lit(""))), ""
        )
        return _cue(e["tStartMs"] / 1000, squash(joined))

    return _cues(F.coalesce(F.transform(usable, cue), F.array().cast(CUES)))


def xml_cues(body: Column | str, kind: str = "srv3") -> Column:
    """XML captions: ``srv3`` has ``<p t=ms>``, ``srv1`` has ``<text start=sec>``.

    Elements of one kind do not nest in these formats, so each is one match; markup
    inside is dropped and entities decoded.
    """
    tag, name, unit = ("p", "t", 1000.0) if kind == "srv3" else ("text", "start", 1.0)
    element = rf"(?s)<{tag}(\s[^>]*)?(?<!/)>(.*?)</{tag}\s*>"
    doc = text(body)
    number = r"(-?\d+)" if kind == "srv3" else r"(-?\d+(?:\.\d+)?|-?\.\d+)"

    def cue(attributes: Column, inner: Column) -> Column:
        at = F.regexp_extract(attributes, rf"\s{name}\s*=\s*[\"']\s*{number}", 1).try_cast("double")
        return _cue(F.coalesce(at, F.lit(0.0)) / unit, squash(decode_entities(F.regexp_replace(inner, "<[^>]*>", ""))))

    return _cues(F.zip_with(groups(doc, element, 1), groups(doc, element, 2), cue))


def sniffed_cues(body: Column | str) -> Column:
    """The first format that yields a cue, by the look of the document."""
    doc = strip(text(body))

    def some(condition: Column, cues: Column) -> Column:
        return F.when(condition, F.filter(F.array(cues), lambda c: F.size(c) > 0))

    xml = F.startswith(doc, F.lit("<"))
    vtt = F.startswith(doc, F.lit("WEBVTT")) | F.contains(doc, F.lit("-->"))
    found = [
        some(F.startswith(doc, F.lit("{")), json3_cues(doc)),
        some(xml, xml_cues(doc, "srv3")),
        some(xml, xml_cues(doc, "srv1")),
        some(vtt, vtt_cues(doc)),
    ]
    return F.coalesce(*(F.get(f, F.lit(0)) for f in found), F.array().cast(CUES))


def tried_cues(json3: Column, srv3: Column, vtt: Column, srv1: Column, default: Column) -> Column:
    """S5 for bodies asked for by format: JSON, srv3, WebVTT, srv1, then plain XML."""
    tried = F.array(
        json3_cues(json3),
        xml_cues(srv3, "srv3"),
        vtt_cues(vtt, need_end=True),
        xml_cues(srv1, "srv1"),
        xml_cues(default, "srv1"),
    )
    return F.coalesce(F.get(F.filter(tried, lambda c: F.size(c) > 0), F.lit(0)), F.array().cast(CUES))


def _read(docs: DataFrame, key: str, cues: Column) -> DataFrame:
    return spread(docs, [key], cues, "cue_idx", "cue").select(key, "cue_idx", "cue.time", "cue.text")


def read_vtt(docs: DataFrame, key: str = "doc_id", body: str = "body", need_end: bool = False) -> DataFrame:
    """``[key, cue_idx, time, text]``."""
    return _read(docs, key, vtt_cues(body, need_end))


def read_json3_captions(docs: DataFrame, key: str = "doc_id", body: str = "body") -> DataFrame:
    """S3: ``[key, cue_idx, time, text]``."""
    return _read(docs, key, json3_cues(body))


def read_xml_captions(docs: DataFrame, kind: str = "srv3", key: str = "doc_id", body: str = "body") -> DataFrame:
    """``[key, cue_idx, time, text]``."""
    return _read(docs, key, xml_cues(body, kind))


def read_captions(docs: DataFrame, key: str = "doc_id", body: str = "body") -> DataFrame:
    """``[key, cue_idx, time, text]`` with the format found per document."""
    return _read(docs, key, sniffed_cues(body))


def preferred_tracks(tracks: DataFrame, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """O3: per document, the first track with cues; human tracks before automatic ones.

    ``tracks`` hold ``kind`` and a ``cues`` array.
    """
    automatic = F.when(F.coalesce(F.col("kind"), F.lit("")) == "asr", 1).otherwise(0)
    usable = tracks.filter(F.size("cues") > 0)
    window = W.partitionBy(doc).orderBy(automatic, order)
    return usable.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")
