"""Timed lyric documents to line tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import groups, parts, spread, squash, strip, sub, text

LINES = "array<struct<time:double,text:string,words:array<struct<time:double,text:string>>>>"
_STAMP = r"\[(\d+):(\d+(?:\.\d+)?)\]"
_TAG = r"<(\d+):(\d+(?:\.\d+)?)>"


def _times(c: Column, pattern: str) -> Column:
    """Seconds of every ``mm:ss.xx`` stamp."""
    return F.zip_with(
        groups(c, pattern, 1),
        groups(c, pattern, 2),
        lambda m, s: m.cast("double") * 60 + s.cast("double"),
    )


def _words(rest: Column) -> Column:
    """Word entries of a tagged line; null when it has no tag or no text after one."""
    after = F.slice(parts(rest, _TAG), F.lit(2), F.size(parts(rest, _TAG)))
    entries = F.zip_with(
        _times(rest, _TAG), after, lambda t, w: F.struct(t.alias("time"), strip(w).alias("text"))
    )
    kept = F.filter(entries, lambda e: e["text"] != "")
    return F.when(F.size(kept) > 0, kept)


def lrc_lines(lrc: Column | str) -> Column:
    """One document as an array of lines ordered by time, equal times in source order."""

    def line(raw: Column) -> Column:
        return F.struct(
            _times(raw, _STAMP).alias("times"), F.regexp_replace(raw, r"\[[^\]]*\]", "").alias("rest")
        )

    def timed(entry: Column) -> Column:
        return F.struct(
            entry["times"].alias("times"),
            squash(sub(entry["rest"], _TAG)).alias("text"),
            F.when(entry["rest"].rlike(_TAG), _words(entry["rest"])).alias("words"),
        )

    stamped = F.filter(F.transform(parts(text(lrc), r"\r?\n"), line), lambda e: F.size(e["times"]) > 0)
    filled = F.filter(F.transform(stamped, timed), lambda e: e["text"] != "")
    spread = F.flatten(
        F.transform(
            filled,
            lambda e, i: F.transform(
                e["times"],
                lambda t, j: F.struct(
                    t.alias("time"), i.alias("i"), j.alias("j"), e["text"].alias("text"), e["words"].alias("words")
                ),
            ),
        )
    )
    ordered = F.array_sort(spread)
    return F.transform(ordered, lambda e: F.struct(e["time"], e["text"], e["words"])).cast(LINES)


def read_lrc(docs: DataFrame, key: str = "song_id", body: str = "lrc") -> DataFrame:
    """``[key, line_idx, time, text, words]``, one row per stamp.

    A document is one row, so ordering happens inside the row and nothing is shuffled.
    """
    rows = spread(docs, [key], lrc_lines(body), "line_idx", "line")
    return rows.select(key, "line_idx", "line.time", "line.text", "line.words")
