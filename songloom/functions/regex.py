"""Regular expressions with the web platform's meaning of ``\\s``, ``\\b`` and ``$``.

Java's ``\\s`` misses the no-break space, its ``\\b`` follows Unicode letters on some
JVM versions, and its ``$`` also matches before a final newline. Patterns in this
package are written in the plain notation and pass through :func:`web` once, at
plan-building time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: white space as the web platform defines it (character-class content).
SPACE = (
    r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)

#: The same, character by character.
_BLANKS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

_WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def web(pattern: str, ignore_case: bool = False) -> str:
    """Rewrite ``\\s``, ``\\S``, ``\\b`` and ``$`` for the JVM; flags are optional."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            pair = pattern[i : i + 2]
            out.append(
                {
                    r"\s": SPACE if in_class else f"[{SPACE}]",
                    r"\S": f"[^{SPACE}]",
                    r"\b": _BOUNDARY,
                }.get(pair, pair)
            )
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        elif ch == "[":
            ch = r"\["
        elif ch == "$" and not in_class:
            ch = r"\z"
        out.append(ch)
        i += 1
    return ("(?iu)" if ignore_case else "") + "".join(out)


def col(c: Column | str) -> Column:
    """A column from a name or a column."""
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """A string column with null read as empty."""
    return F.coalesce(col(c), F.lit(""))


def has(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    return c.rlike(web(pattern, ignore_case))


def sub(c: Column, pattern: str, replacement: str = "", ignore_case: bool = False) -> Column:
    return F.regexp_replace(c, web(pattern, ignore_case), replacement)


def group(c: Column, pattern: str, index: int = 1, ignore_case: bool = False) -> Column:
    """Capture ``index`` of the first match; empty when nothing matches."""
    return F.regexp_extract(c, web(pattern, ignore_case), index)


def groups(c: Column, pattern: str, index: int = 1, ignore_case: bool = False) -> Column:
    """Capture ``index`` of every match, as an array."""
    return F.regexp_extract_all(c, F.lit(web(pattern, ignore_case)), F.lit(index))


def parts(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Split on a pattern, keeping empty pieces."""
    return F.split(c, web(pattern, ignore_case), -1)


def strip(c: Column) -> Column:
    """Trim every kind of white space (``trim`` knows only the ASCII blank)."""
    return F.trim(c, F.lit(_BLANKS))


def squash(c: Column) -> Column:
    """Fold white-space runs to one blank and trim."""
    return F.trim(sub(c, r"\s+", " "))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spread(df: DataFrame, columns: list, array: Column, position: str, element: str) -> DataFrame:
    """One row per array element, next to ``columns``.

    The outer form is used on purpose: for the inner one the optimizer derives a
    ``size(array) > 0`` filter and evaluates a costly array expression twice.
    """
    rows = df.select(*columns, F.posexplode_outer(array).alias(position, element))
    return rows.filter(F.col(position).isNotNull())


def pieces(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Split, trim each piece and drop the empty ones."""
    trimmed = F.transform(parts(c, pattern, ignore_case), strip)
    return F.filter(trimmed, lambda s: s != "")
