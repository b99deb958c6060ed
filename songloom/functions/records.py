"""Small rules over stored records: playlists, votes, signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import col, text

NAME_MAX, TITLE_MAX = 60, 300

_ITEM = "struct<videoKey:string,title:string,url:string,addedAt:string>"
LISTS = f"array<struct<id:string,name:string,createdAt:string,items:array<{_ITEM}>>>"


def _field(node: Column, name: str) -> Column:
    return F.nullif(F.try_variant_get(node, f"$.{name}", "string"), F.lit(""))


def _is_string(node: Column, name: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(node, f"$.{name}", "variant"))
    return F.coalesce(kind == "STRING", F.lit(False))


def _elements(node: Column, path: str) -> Column:
    found = F.try_variant_get(node, path, "array<variant>")
    return F.coalesce(found, F.array().cast("array<variant>"))


def normalize_lists(raw: Column | str) -> Column:
    """stored playlists as typed arrays; malformed lists and items are dropped."""

    def item(it: Column) -> Column:
        url = F.when(_is_string(it, "url"), F.try_variant_get(it, "$.url", "string"))
        return F.struct(
            _field(it, "videoKey").alias("videoKey"),
            F.left(text(_field(it, "title")), F.lit(TITLE_MAX)).alias("title"),
            text(url).alias("url"),
            text(_field(it, "addedAt")).alias("addedAt"),
        )

    def one(node: Column) -> Column:
        items = F.filter(
            _elements(node, "$.items"),
            lambda it: _is_string(it, "videoKey") & _field(it, "videoKey").isNotNull(),
        )
        name = F.left(F.coalesce(_field(node, "name"), F.lit("Untitled")), F.lit(NAME_MAX))
        return F.struct(
            F.try_variant_get(node, "$.id", "string").alias("id"),
            name.alias("name"),
            text(_field(node, "createdAt")).alias("createdAt"),
            F.transform(items, item).alias("items"),
        )

    blob = F.try_parse_json(col(raw))
    kept = F.filter(_elements(blob, "$"), lambda node: _is_string(node, "id"))
    return F.transform(kept, one).cast(LISTS)


def normalize_vote(liked: Column | str, rating: Column | str) -> Column:
    """the liked flag, else a star rating of 4 or more, else null."""
    rating = col(rating)
    return F.coalesce(col(liked), F.when(rating > 0, rating >= 4))


SIGNALS = ("explicit_up", "explicit_down")


def valid_signal(revision_id: Column | str, signal: Column | str) -> Column:
    """Positive revision and a known signal."""
    ok = (col(revision_id) > 0) & col(signal).isin(*SIGNALS)
    return F.coalesce(ok, F.lit(False))
