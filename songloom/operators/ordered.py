"""Looking at the row before or after, per key, when one key may hold most rows.

A window over ``partitionBy(key)`` puts a whole key into one task. Here each key is cut
into *slices* of its order (an hour of events, a thousand lines). The window runs per
(key, slice); one summary row per slice then travels along the key and fills in what
the slice could not see. The summaries are fewer than the rows by the slice size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_SLICE = "_slice"


def time_slice(ts: str, seconds: int) -> Column:
    """Slice number of a timestamp column."""
    return F.floor(F.unix_micros(F.col(ts)) / (seconds * 1_000_000))


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    piece: Column,
    previous: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
    lowest: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add columns read from other rows of the same key.

    ``previous`` / ``following``: value in the row just before / after (null at the ends).
    ``last``: last non-null value strictly before the row.
    ``total``: sum of the values up to and including the row.
    ``lowest``: smallest value up to and including the row.

    ``order`` must be unique per key, and ``piece`` must not decrease along it.
    """
    previous, following, last, total, lowest = (dict(m or {}) for m in (previous, following, last, total, lowest))
    keys, order = list(keys), list(order)
    reads = {**previous, **following, **last, **total, **lowest}
    base = df.withColumns({_SLICE: piece, **{f"_v_{n}": c for n, c in reads.items()}})
    here = W.partitionBy(*keys, _SLICE).orderBy(*order)
    before = here.rowsBetween(W.unboundedPreceding, -1)
    until = here.rowsBetween(W.unboundedPreceding, 0)
    v = {n: F.col(f"_v_{n}") for n in reads}
    boxed = {n: F.struct(v[n].alias("x")) for n in (*previous, *following)}
    local = base.withColumns(
        {
            **{f"_l_{n}": F.lag(boxed[n]).over(here) for n in previous},
            **{f"_l_{n}": F.lead(boxed[n]).over(here) for n in following},
            **{f"_l_{n}": F.last(v[n], ignorenulls=True).over(before) for n in last},
            **{f"_l_{n}": F.sum(v[n]).over(until) for n in total},
            **{f"_l_{n}": F.min(v[n]).over(until) for n in lowest},
        }
    )
    place = F.struct(*order)
    summary = base.groupBy(*keys, _SLICE).agg(
        *(F.max_by(boxed[n], place).alias(f"_s_{n}") for n in previous),
        *(F.min_by(boxed[n], place).alias(f"_s_{n}") for n in following),
        *(F.max_by(v[n], F.when(v[n].isNotNull(), place)).alias(f"_s_{n}") for n in last),
        *(F.sum(v[n]).alias(f"_s_{n}") for n in total),
        *(F.min(v[n]).alias(f"_s_{n}") for n in lowest),
    )
    along = W.partitionBy(*keys).orderBy(_SLICE)
    earlier = along.rowsBetween(W.unboundedPreceding, -1)
    carried = summary.select(
        *keys,
        _SLICE,
        *(F.lag(f"_s_{n}").over(along).alias(f"_c_{n}") for n in previous),
        *(F.lead(f"_s_{n}").over(along).alias(f"_c_{n}") for n in following),
        *(F.last(f"_s_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in last),
        *(F.sum(f"_s_{n}").over(earlier).alias(f"_c_{n}") for n in total),
        *(F.min(f"_s_{n}").over(earlier).alias(f"_c_{n}") for n in lowest),
    )
    joined = local.join(carried, [*keys, _SLICE], "left")

    def read(n: str) -> Column:
        both = F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}"))
        if n in total:
            return F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))
        if n in lowest:
            return F.least(f"_l_{n}", f"_c_{n}")
        return both["x"] if n in boxed else both

    kept = [c for c in df.columns if c not in reads]
    return joined.select(*kept, *(read(n).alias(n) for n in reads))
