"""Words of a lyric line."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .regex import SPACE, col, let, text

# Scripts written without blanks. Han and kana are cut per character; words of the
# others need a lexicon (operators.lexicon), and are cut per cluster without one.
_CHAR_SCRIPTS = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
_LINE_SCRIPTS = r"\x{0E00}-\x{0E7F}\x{0E80}-\x{0EFF}\x{1780}-\x{17FF}\x{1000}-\x{109F}"

#: Clusters, a letter with the vowels and marks that belong to it. In order: Thai, Lao,
#: Khmer (with letters below the line), Burmese (with stacked and silenced letters).
_CLUSTERS = (
    r"[\u0E40-\u0E44]?[\u0E01-\u0E2E][\u0E30-\u0E3A\u0E45\u0E47-\u0E4E]*",
    r"[\u0EC0-\u0EC4]?[\u0E81-\u0EAE\u0EDC-\u0EDF][\u0EB0-\u0EBD\u0EC8-\u0ECE]*",
    r"[\u1780-\u17B3](?:\u17D2[\u1780-\u17B3])*[\u17B4-\u17D1\u17D3\u17DD]*",
    r"[\u1000-\u102A\u103F](?:\u1039[\u1000-\u1021])*[\u102B-\u1038\u103A-\u103E]*(?:[\u1000-\u1021]\u103A[\u1037\u1038]?)*",
)
LINE_RUN = r"[\u0E00-\u0EFF\u1780-\u17FF\u1000-\u109F]+"
#: What no rule covers (digits, signs) is a cluster per character.
_ANY_CLUSTER = "|".join((*_CLUSTERS, r"[\u0E00-\u0EFF\u1780-\u17FF\u1000-\u109F]"))
CLUSTER = re.compile(_ANY_CLUSTER)

_RANGE = "struct<start:int,end:int>"
_TOKEN = "array<struct<text:string,isWord:boolean>>"


def locate_words(line: Column | str, words: Column | str) -> Column:
    """``array<struct<start, end>>`` of the words in order; null if one is missing.

    Offsets count code points from 0.
    """
    line, words = col(line), col(words)
    start = F.struct(
        F.lit(0).alias("at"), F.lit(True).alias("ok"), F.array().cast(f"array<{_RANGE}>").alias("r")
    )

    def place(acc: Column, word: Column) -> Column:
        return let(F.call_function("locate", word, line, acc["at"] + 1), lambda at: after(acc, word, at))

    def after(acc: Column, word: Column, at: Column) -> Column:
        end = at - 1 + F.length(word)
        hit = F.struct((at - 1).alias("start"), end.alias("end")).cast(_RANGE)
        found = F.struct(
            end.alias("at"), F.lit(True).alias("ok"), F.array_append(acc["r"], hit).alias("r")
        )
        lost = F.struct(acc["at"].alias("at"), F.lit(False).alias("ok"), acc["r"].alias("r"))
        usable = acc["ok"] & (F.coalesce(word, F.lit("")) != "") & (at > 0)
        return F.when(usable, found).otherwise(lost)

    return F.when(
        words.isNotNull() & line.isNotNull(),
        F.aggregate(words, start, place, lambda acc: F.when(acc["ok"], acc["r"])),
    )


def _token(c: Column, word: Column) -> Column:
    return F.struct(c.alias("text"), word.alias("isWord"))


def line_clusters(run: Column | str) -> Column:
    """Clusters of a run of Thai, Lao, Khmer or Burmese."""
    return F.regexp_extract_all(col(run), F.lit(_ANY_CLUSTER), F.lit(0))


def _pieces(line: Column) -> Column:
    """Runs of those scripts, blanks, and what else stands between blanks, in order."""
    other = rf"[^{SPACE}{_LINE_SCRIPTS}]+"
    return F.regexp_extract_all(line, F.lit(rf"{LINE_RUN}|[{SPACE}]+|{other}"), F.lit(0))


def _is_blank(c: Column) -> Column:
    return c.rlike(rf"^[{SPACE}]+\z")


def tokens_by(lines: DataFrame, column: str, name: str, words_of: Callable[[Column], Column]) -> DataFrame:
    """``lines`` with untimed tokens in ``name``; ``words_of`` maps the runs of a line's scripts
    without blanks to an array of words each."""
    line, pieces = text(column), _pieces(text(column))
    has_runs = line.rlike(f"[{_LINE_SCRIPTS}]")
    runs = F.filter(pieces, lambda p: p.rlike(f"^{LINE_RUN}"))
    found = lines.withColumn("_words", words_of(F.when(has_runs, runs).otherwise(F.array().cast("array<string>"))))
    # each run takes the next entry of the words
    start = F.struct(F.lit(0).alias("i"), F.array().cast(_TOKEN).alias("t"))

    def step(acc: Column, piece: Column) -> Column:
        listed = F.transform(F.get(F.col("_words"), acc["i"]), lambda w: _token(w, w.rlike(r"[\p{L}\p{N}]")))
        plain = F.array(_token(piece, ~_is_blank(piece)))
        is_run = piece.rlike(f"^{LINE_RUN}")
        return F.struct(
            (acc["i"] + is_run.cast("int")).alias("i"),
            F.concat(acc["t"], F.when(is_run, listed).otherwise(plain).cast(_TOKEN)).alias("t"),
        )

    by_run = F.aggregate(pieces, start, step, lambda acc: acc["t"])
    return found.withColumn(name, F.when(has_runs, by_run).otherwise(segment_untimed(column))).drop("_words")


def segment_untimed(line: Column | str) -> Column:
    """F17 without timing: blanks separate words; Han and kana count per character, Thai, Lao,
    Khmer and Burmese per cluster (:func:`operators.lexicon.segment_lines` finds their words)."""
    line = text(line)
    blank = rf"[{SPACE}]+"
    spaced = F.regexp_extract_all(line, F.lit(rf"{blank}|[^{SPACE}]+"), F.lit(0))
    by_char = F.regexp_extract_all(
        line, F.lit(rf"[{_CHAR_SCRIPTS}]|{blank}|[^{_CHAR_SCRIPTS}{SPACE}]+"), F.lit(0)
    )
    by_cluster = F.regexp_extract_all(
        line, F.lit(rf"{_ANY_CLUSTER}|{blank}|[^{_LINE_SCRIPTS}{SPACE}]+"), F.lit(0)
    )
    return (
        F.when(line == "", F.array().cast(_TOKEN))
        .when(
            line.rlike(f"[{_LINE_SCRIPTS}]"),
            F.transform(by_cluster, lambda t: _token(t, t.rlike(r"[\p{L}\p{N}]"))),
        )
        .when(
            line.rlike(f"[{_CHAR_SCRIPTS}]"),
            F.transform(by_char, lambda t: _token(t, t.rlike(r"[\p{L}\p{N}]"))),
        )
        .otherwise(F.transform(spaced, lambda t: _token(t, ~t.rlike(rf"^{blank}\z"))))
        .cast(_TOKEN)
    )


def line_tokens(line: Column | str, words: Column | None = None) -> Column:
    """timed words located in order with their separators, else untimed tokens."""
    line = text(line)
    untimed = segment_untimed(line)
    if words is None:
        return untimed

    def timed(ranges: Column) -> Column:
        """Each word with the separator before it, then what follows the last word."""

        def piece(r: Column, i: Column) -> Column:
            since = F.coalesce(F.get(ranges, i - 1)["end"], F.lit(0))
            before = F.substr(line, since + 1, r["start"] - since)
            word = F.substr(line, r["start"] + 1, r["end"] - r["start"])
            return F.array(_token(before, F.lit(False)), _token(word, F.lit(True)))

        rest = F.substr(line, F.try_element_at(ranges, F.lit(-1))["end"] + 1)
        tail = F.array(_token(rest, F.lit(False)))
        return F.filter(
            F.concat(F.flatten(F.transform(ranges, piece)), tail), lambda t: t["text"] != ""
        ).cast(_TOKEN)

    found = F.when(F.size(words) > 0, let(locate_words(line, words), lambda r: F.when(r.isNotNull(), timed(r))))
    return F.coalesce(found, untimed)
