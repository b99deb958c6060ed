"""Time text and playhead arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import col, group, has, strip, text


def parse_time_text(c: Column | str) -> Column:
    """``m:ss`` or ``h:mm:ss`` to seconds, sign kept; null otherwise."""
    s = strip(text(c))
    pattern = r"^(-?)(\d+):(\d{2})(?::(\d{2}))?$"
    first, second, third = (F.try_to_number(group(s, pattern, i), F.lit("9" * 18)) for i in (2, 3, 4))
    long = group(s, pattern, 4) != ""
    seconds = F.when(long, first * 3600 + second * 60 + third).otherwise(first * 60 + second)
    sign = F.when(group(s, pattern, 1) == "-", -1).otherwise(1)
    return F.when(has(s, pattern), (sign * seconds).cast("long"))


def shown_duration(position: Column | str, shown: Column | str) -> Column:
    """a negative figure is time remaining, so the length is position − figure."""
    position, shown = col(position), col(shown)
    return F.when(shown < 0, position - shown).otherwise(shown)


def interpolate(
    last_time: Column | str, last_ms: Column | str, paused: Column | str, now_ms: Column | str
) -> Column:
    """playhead at ``now``; frozen while paused, never rewound, 0 if unknown."""
    t, ts, now = col(last_time).cast("double"), col(last_ms), col(now_ms)
    finite = t.isNotNull() & ~F.isnan(t) & (F.abs(t) != float("inf"))
    moved = t + F.greatest((now - ts) / 1000, F.lit(0.0))
    return F.when(~finite, 0.0).when(col(paused), t).otherwise(moved)


def round_half_up(c: Column) -> Column:
    """Round halves toward +∞ (``round`` sends −2.5 to −3)."""
    return F.floor(c + 0.5)
