"""Secrets in texts, and parts of credentials linked where they meet.

Strong spans are found by fixed patterns. Weak candidates (something that names an account,
something that looks random, an address to log in to) are common in clean text, so one is
reported only if a part of another role lies within ``reach`` characters of it; strong spans
count as parts too. The link is an interval join within documents. It needs no pairs: each
text is cut into scopes of ``reach`` characters, and per scope and role the first and last
span are enough to decide whether a neighbour is near.

Positions are code points, ends exclusive. Null texts count as empty; each row of the input
gives one row, whatever its id; an empty table gives none.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.llm.tables import saved

REACH = 200

_CASELESS = re.ASCII | re.IGNORECASE
#: The strong patterns. Runs of a class are maximal, so a least length can stand
#: in the pattern of access and hex; for assign it is checked after the match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _CASELESS)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_WORDS = re.compile(r"password|passwd|secret|token|api_?key", _CASELESS)

#: Weak candidates. A field name may end a longer one (DB_USER, aws_access_key_id); a scan
#: looks at each run of name characters once. Random runs may have any length.
_PREFIX = r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]*"
_ACCOUNT = r"user(?:[_-]?(?:name|id))?|login|account|client[_-]?id|key[_-]?id|(?<!secret)(?<!secret[_.-])access[_-]?key"
IDENTIFIER = re.compile(_PREFIX + rf"""(?:{_ACCOUNT})["']?\x20*[:=]\x20*["']?[\w.@+-]{{3,}}""", _CASELESS)
SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
ENDPOINT = re.compile(
    r"""\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]{4,}|""" + _PREFIX + r"""(?:host|server|endpoint)["']?\x20*[:=]\x20*["']?[\w.-]{3,}(?::\d{2,5})?""",
    _CASELESS,
)

#: Kinds in the order in which spans with equal starts are listed, with their roles.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "secret": "secret", "endpoint": "endpoint"}


def strong_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the strong spans."""
    found = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if _ASSIGN_WORDS.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    return sorted(found)


def weak_spans(text: str, strong: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak candidates, without those that overlap a strong span."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 3, m.end()) for m in IDENTIFIER.finditer(text)]
        found += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    found += [(m.start(), 4, m.end()) for m in SECRET.finditer(text) if _mixed(m[0])]
    starts = [s[0] for s in strong]
    reached = list(accumulate((s[2] for s in strong), max, initial=-1))  # largest end so far
    return [s for s in found if reached[bisect_left(starts, s[2])] <= s[0]]


def _mixed(run: str) -> bool:
    return any("a" <= c <= "z" for c in run) and any("A" <= c <= "Z" for c in run) and any("0" <= c <= "9" for c in run)


_SPAN = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("strong", pa.list_(_SPAN)), ("weak", pa.list_(_SPAN))])
_FOUND_SQL = (
    "doc_id long, strong array<struct<start: long, rank: int, end: long>>, weak array<struct<start: long, rank: int, end: long>>"
)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            strong = strong_spans(text)
            row = [[{"start": a, "rank": k, "end": b} for a, k, b in x] for x in (strong, weak_spans(text, strong))]
            rows.append({"doc_id": doc_id, "strong": row[0], "weak": row[1]})
        yield pa.RecordBatch.from_pylist(rows, schema=_FOUND)


def linked(spans: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak ones of ``spans`` (row, start, end, rank, role, strong) with another role near.

    Near: at most ``reach`` characters between the spans. A scope holds the spans that start
    in it; from the scopes before, only the last end counts, from those after, only the first
    start. Spans are listed in every scope they touch.
    """
    scope = F.floor(F.col("start") / reach)
    covered = spans.withColumn("scope", F.explode(F.sequence(scope, F.floor(F.col("end") / reach))))
    ends = covered.groupBy("row", "scope", "role").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    # a scope is seen from itself and from its two neighbours on either side
    seen = ends.withColumn("scope", F.explode(F.sequence(F.col("scope") - 1, F.col("scope") + 1)))
    weak = covered.filter("not strong").withColumnRenamed("role", "own")
    near = (F.col("first") - F.col("end") <= reach) & (F.col("start") - F.col("last") <= reach)
    return (
        weak.join(seen, ["row", "scope"]).filter((F.col("role") != F.col("own")) & near)
        .select("row", "start", "end", "rank").distinct()
    )


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Per document: doc_id, counts of strong spans, the strong spans and all reported spans.

    ``strong`` and ``spans`` are arrays of (start, rank, end) in order; ranks index KINDS.
    """
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_find, _FOUND_SQL)
    found = saved(found.withColumn("row", F.monotonically_increasing_id()), "credential-spans")
    role = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (i, ROLES[k])])
    # documents without weak candidates have nothing to link
    parts = found.filter(F.size("weak") > 0).select(
        "row",
        F.explode(
            F.concat(
                F.transform("strong", lambda s: F.struct(s["start"], s["rank"], s["end"], F.lit(True).alias("strong"))),
                F.transform("weak", lambda s: F.struct(s["start"], s["rank"], s["end"], F.lit(False).alias("strong"))),
            )
        ).alias("s"),
    ).select("row", "s.*")
    reported = linked(parts.withColumn("role", role[F.col("rank")]), reach)
    added = reported.groupBy("row").agg(F.collect_list(F.struct("start", "rank", "end")).alias("added"))
    count = lambda k: F.size(F.filter("strong", lambda s: s["rank"] == k)).cast("long")
    spans = F.when(F.col("added").isNull(), F.col("strong")).otherwise(F.array_sort(F.concat("strong", "added")))
    return found.join(added, "row", "left").select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), "strong", spans.alias("spans")
    )


def listed(spans: str | Column) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", kinds[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
