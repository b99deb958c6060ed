"""HTML fragments to text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import col, groups, let, parts, sub

# Named entities in the order they are decoded.
_NAMED = [
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&#039;", "'"), ("&apos;", "'"), ("&nbsp;", " "),
]


def _code_point(number: Column) -> Column:
    """Text of one Unicode code point; empty for values that are none."""
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(
        valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    ).otherwise(F.lit(""))


def _numeric(c: Column, pattern: str, base: int) -> Column:
    """Decode one numeric entity form in a single pass, left to right."""

    def number(digits: Column) -> Column:
        # no code point has more than seven digits, but any number of zeros may lead
        bare = F.regexp_replace(digits, "^0+", "")
        return F.when(F.length(bare) <= 7, F.conv(bare, base, 10).cast("long"))

    def read(s: Column) -> Column:
        decoded = F.transform(groups(s, pattern), lambda d: _code_point(number(d)))
        pairs = F.zip_with(parts(s, pattern), decoded, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        return F.when(s.rlike(pattern), F.array_join(pairs, "")).otherwise(s)

    return let(c, read)  # a lambda's body has no common subexpressions: the text so far is named once


def decode_entities(c: Column | str) -> Column:
    """F16: named, hexadecimal and decimal entities."""
    out = reduce(lambda acc, e: F.replace(acc, F.lit(e[0]), F.lit(e[1])), _NAMED, col(c))
    out = _numeric(out, "&#x([0-9a-fA-F]+);", 16)
    return _numeric(out, r"&#(\d+);", 10)


def html_to_text(c: Column | str) -> Column:
    """F16: breaks and block ends to newlines, tags dropped, blank runs folded."""
    out = sub(col(c), r"<br\s*/?>|</(?:p|div)>", "\n", True)
    out = decode_entities(F.regexp_replace(out, "<[^>]+>", ""))
    return F.regexp_replace(F.regexp_replace(out, "[ \t]+\n", "\n"), "\n{3,}", "\n\n")
