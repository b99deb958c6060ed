"""Catalog and labelled-title readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG = (
    "trackName string, artistName string, albumName string, duration double, "
    "syncedLyrics string, plainLyrics string, "
    "extra struct<has_lyrics:boolean,has_word_timing:boolean,tier:string,revision_id:bigint>"
)
CORPUS = (
    "rawTitle string, trueArtist string, altArtists array<string>, trueTrack string, "
    "approxDurationSec double, authorHint string, metaTrack string, metaArtist string"
)


def read_catalog(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Catalog rows; JSON documents may hold one object or an array of them."""
    if fmt == "json":
        return spark.read.schema(CATALOG).option("multiLine", True).json(path)
    return spark.read.format(fmt).load(path)


def catalog_from_responses(responses: DataFrame, body: str = "body") -> DataFrame:
    """S8 over a table of lookup responses: objects and arrays become one row set."""
    text = F.trim(body)
    row = F.from_json(text, CATALOG)
    rows = F.from_json(text, f"array<struct<{_nested(CATALOG)}>>")
    flat = F.when(F.startswith(text, F.lit("[")), rows).otherwise(F.array(row))
    others = [c for c in responses.columns if c != body]
    named = responses.select(*others, F.explode(flat).alias("row")).select(*others, "row.*")
    return named.filter(F.col("trackName").isNotNull() | F.col("artistName").isNotNull())


def _nested(schema: str) -> str:
    """A flat column list in the notation of a nested struct."""
    head, _, tail = schema.partition("extra ")
    return head.replace(" string", ":string").replace(" double", ":double") + "extra:" + tail


def read_eval_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Labelled titles; optional fields default to empty."""
    df = spark.read.option("multiLine", True).schema(CORPUS).json(path)
    empty = {c: F.coalesce(c, F.lit("")) for c in ("authorHint", "metaTrack", "metaArtist")}
    alternates = F.coalesce("altArtists", F.array().cast("array<string>"))
    return df.withColumns({**empty, "altArtists": alternates})
