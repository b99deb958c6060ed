"""Benchmark passages in documents, found by winnowed fingerprints and checked word by word.

A text's fingerprints are the smallest k-gram hash of every stretch of ``w`` k-grams. Two
texts that share ``k + w - 1`` words share such a stretch, hence a fingerprint; with
``k + w - 1`` equal to the window of the contamination rule none is missed. Items shorter
than the window are one window of their own length and take part with all grams of it.

Steps: every document's fingerprints meet those of the benchmark; around each hit the
windows that may hold it are cut out and compared as text (the extension); matched windows
are merged into covered words. Texts are known by a digest, so copies are extended once.

Null and empty texts have no words; items without words have no window; items without id are
matched but not listed; repeated rows give repeated results; empty tables are fine. Only
doc_id and text, item_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.llm.tables import saved, unused

WINDOW, GRAM = 13, 5
#: Fixed value: what stands between words once A-Z are lower case.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-case words; only A-Z are lowered."""
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), _BETWEEN), "")


def _grams(words: Column, k: int, window: int) -> Column:
    """Hashes of the k-grams, by position; none if there are fewer than ``window`` words."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k), F.lit(window)))
    return F.when(F.size(words) >= window, hashes).otherwise(F.array().cast("array<long>"))


def _least(hashes: Column, w: int) -> Column:
    if w == 1:
        return F.array_distinct(hashes)
    starts = F.sequence(F.lit(1), F.size(hashes) - (w - 1))
    least = F.array_distinct(F.transform(starts, lambda i: F.array_min(F.slice(hashes, i, w))))
    return F.when(F.size(hashes) >= w, least).otherwise(hashes)


def shapes(lengths: list[int], window: int = WINDOW, gram: int = GRAM) -> list[tuple[int, int]]:
    """(window, gram) for each length of window: short ones are their own gram."""
    return [(n, gram if n >= window else n) for n in lengths]


def _with_fingerprints(df: DataFrame, of: list[tuple[int, int]]) -> DataFrame:
    """``df`` with ``words`` gets ``prints``; hashes are made once, then windows slide over them."""
    df = df.withColumns({f"_grams_{n}": _grams(F.col("words"), k, n) for n, k in of})
    parts = [_least(F.col(f"_grams_{n}"), n - k + 1) for n, k in of]
    prints = F.concat(*parts) if parts else F.array().cast("array<long>")
    return df.withColumn("prints", prints).drop(*[f"_grams_{n}" for n, _ in of])


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, size and text of every distinct window of every item."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    items = items.withColumn("size", F.least(F.size("words"), F.lit(window)))
    cut = F.transform(
        F.sequence(F.lit(1), F.size("words") - F.col("size") + 1), lambda i: F.array_join(F.slice("words", i, F.col("size")), " ")
    )
    return items.select("item_id", "size", F.explode(F.array_distinct(cut)).alias("window"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document: doc_id, key (digest of the text), n_words, n_hit, n_items, item_ids, contaminated."""
    windows = saved(item_windows(benchmark, window), "item-windows")
    of = shapes(sorted(r["size"] for r in windows.select("size").distinct().collect()), window, gram)  # at most `window` rows
    split = _with_fingerprints(
        windows.select("window", "size").distinct().withColumn("words", F.split("window", " ")), of
    )
    sought = saved(split.select(F.explode("prints").alias("print")).distinct(), "item-prints")

    texts = docs.select("doc_id", "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"))
    words = texts.withColumn("words", words_of(F.col("text")))
    prints = saved(
        _with_fingerprints(words, of).select("doc_id", "key", F.size("words").cast("long").alias("n_words"), "prints"), "doc-prints"
    )
    hits = saved(
        prints.select("key", F.explode("prints").alias("print")).join(sought, "print")
        .groupBy("key").agg(F.collect_set("print").alias("hits")),
        "print-hits",
    )

    once = texts.join(hits, "key").groupBy("key").agg(F.first("text").alias("text"), F.first("hits").alias("hits"))
    found = once.select("key", "hits", words_of(F.col("text")).alias("words"))
    matched = [_extended(found, n, k).join(windows.select("size", "window").distinct(), ["size", "window"]) for n, k in of]
    if not matched:
        return _result(prints, None)
    spans = matched[0]
    for more in matched[1:]:
        spans = spans.unionByName(more)
    spans = saved(spans, "matched-windows")
    covered = spans.groupBy("key").agg(F.collect_set(F.struct("start", "size")).alias("spans")).select(
        "key",
        F.size(
            F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1))))
        ).cast("long").alias("n_hit"),
    )
    listed = (
        spans.select("key", "size", "window").distinct().join(windows, ["size", "window"])
        .groupBy("key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    )
    return _result(prints, saved(covered.join(listed, "key"), "text-hits"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated ones; equal texts share their verdict."""
    key = unused(docs, "_key")
    found = contamination(docs, benchmark).filter("contaminated").select(F.col("key").alias(key)).distinct()
    rows = docs.withColumn(key, F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    return rows.join(saved(found, "contaminated-texts"), key, "left_anti").drop(key)


def _extended(found: DataFrame, window: int, gram: int) -> DataFrame:
    """The windows around the fingerprint hits: key, start (from 1), size, window."""
    hit_at = F.filter(
        F.sequence(F.lit(1), F.size("words") - (gram - 1)),
        lambda i: F.array_contains("hits", F.xxhash64(F.slice("words", i, gram), F.lit(window))),
    )
    reach = F.array(*[F.lit(d) for d in range(window - gram + 1)])
    starts = F.array_distinct(F.flatten(F.transform(hit_at, lambda p: F.transform(reach, lambda d: p - d))))
    starts = F.filter(starts, lambda s: (s >= 1) & (s <= F.size("words") - (window - 1)))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.array_join(F.slice("words", s, window), " ").alias("window")))
    long_enough = found.filter(F.size("words") >= window)
    return long_enough.select("key", F.explode(cut).alias("w")).select("key", "w.start", F.lit(window).alias("size"), "w.window")


def _result(prints: DataFrame, text_hits: DataFrame | None) -> DataFrame:
    rows = prints.select("doc_id", "key", "n_words")
    if text_hits is None:
        rows = rows.withColumns({"n_hit": F.lit(None).cast("long"), "item_ids": F.lit(None).cast("array<string>")})
    else:
        rows = rows.join(text_hits, "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("item_ids", F.array().cast("array<string>"))
    return rows.select(
        "doc_id", "key", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("item_ids"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


#: The contamination rule in DuckDB SQL: all windows of all texts, joined as text.
CONTAMINATION_SQL = r"""
with d as (
    select row_number() over () as r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
    from {documents}
), b as (
    select item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
    from benchmark
), bw as (
    select distinct item_id, size, array_to_string(w[s : s + size - 1], ' ') as win
    from (select *, unnest(range(1, len(w) - size + 2)) as s from (select *, least(13, len(w)) as size from b where len(w) > 0))
), dw as (
    select r, size, s, array_to_string(w[s : s + size - 1], ' ') as win
    from (select *, unnest(range(1, len(w) - size + 2)) as s
          from d, (select distinct size from bw) where len(w) >= size)
), m as (
    select r, s, dw.size, item_id from dw join bw on dw.size = bw.size and dw.win = bw.win
), h as (
    select r, count(distinct p) as n_hit from (select r, unnest(range(s, s + size)) as p from m) group by r
), i as (
    select r, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids
    from m group by r
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    sha256(coalesce(ids, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join h using (r) left join i using (r)
"""
