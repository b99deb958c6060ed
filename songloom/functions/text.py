"""Title and name text: folding, comparison keys, cleaning, match predicates."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import col, group, has, let, strip, sub, text, web

# Letters without a canonical decomposition, and Cyrillic letters, with
# the Latin text they fold to.
SPECIAL_LATIN = {
    "đ": "d", "ð": "d", "ł": "l", "ø": "o", "æ": "ae", "œ": "oe",
    "ß": "ss", "þ": "th", "ı": "i", "ŋ": "n", "ħ": "h", "ĸ": "k",
}
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "ђ": "dj", "е": "e",
    "ж": "z", "з": "z", "и": "i", "ј": "j", "к": "k", "л": "l", "љ": "lj",
    "м": "m", "н": "n", "њ": "nj", "о": "o", "п": "p", "р": "r", "с": "s",
    "т": "t", "ћ": "c", "у": "u", "ф": "f", "х": "h", "ц": "c", "ч": "c",
    "џ": "dz", "ш": "s", "ѕ": "dz", "і": "i", "ы": "y", "э": "e", "ю": "yu",
    "я": "ya", "й": "j", "ё": "e", "щ": "sc", "ъ": "", "ь": "",
}

# Words that do not count when titles are compared.
NOISE_WORDS = (
    "hd hq uhd 4k 8k 2160p 1440p 1080p? 720p audio video lyric lyrics official oficial "
    "officiel mv live vivo directo remaster remastered remix rmx stereo mono version "
    "visualizer visualiser performance"
).split()

# Whole words only, by ASCII boundaries; the first look rejects most positions at once.
_NOISE = (
    f"(?=[{''.join(sorted({w[0] for w in NOISE_WORDS}))}])(?<![A-Za-z0-9_])"
    f"(?:{'|'.join(NOISE_WORDS)})(?![A-Za-z0-9_])"
)
_MARKS = r"[\x{0300}-\x{036F}]"


def _translate(c: Column, table: dict[str, str]) -> Column:
    """One-pass ``translate`` for 1→1 and 1→0, then ``replace`` for longer outputs."""
    single = {k: v for k, v in table.items() if len(v) == 1}
    dropped = "".join(k for k, v in table.items() if not v)
    longer = {k: v for k, v in table.items() if len(v) > 1}
    out = F.translate(c, "".join(single) + dropped, "".join(single.values()))
    if not longer:
        return out

    def expand(s: Column) -> Column:
        wide = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), longer.items(), s)
        return F.when(s.rlike(f"[{''.join(longer)}]"), wide).otherwise(s)

    return let(out, expand)


@lru_cache(maxsize=None)
def _decomposition() -> dict[str, str]:
    """Lower-case letter → its composed form without combining marks, from ``unicodedata``.

    Hangul and other letters that merely decompose and recompose are not in the table.
    """
    table = {}
    for cp in range(0xC0, 0x30000):
        ch = chr(cp)
        if 0xAC00 <= cp < 0xE000 or ch.lower() != ch:
            continue
        parts = unicodedata.normalize("NFD", ch)
        if parts == ch:
            continue
        bare = "".join(p for p in parts if not 0x300 <= ord(p) <= 0x36F)
        bare = unicodedata.normalize("NFC", bare)
        if bare != ch:
            table[ch] = bare
    return table


def translit(c: Column | str) -> Column:
    """lower-case, then fold special Latin and Cyrillic letters."""
    return _translate(F.lower(text(c)), {**SPECIAL_LATIN, **CYRILLIC})


def _wide(c: Column) -> Column:
    return c.rlike(r"[^\x00-\x7F]")


#: Texts in which folding changes more letters than these go through the tables as a whole.
_FEW_LETTERS = 40


def ascii_fold(c: Column | str) -> Column:
    """:func:`translit`, then drop diacritics. Pure ASCII input skips the tables.

    The tables look up every character, so they are asked once for each letter of a text that is not
    ASCII, and those that change are replaced one after the other. A fold that is not ASCII may be a
    letter that folds where it is typed (ї becomes і), so such folds come last.
    """

    def by_tables(low: Column) -> Column:
        special = _translate(low, {**SPECIAL_LATIN, **CYRILLIC})
        return F.regexp_replace(_translate(special, _decomposition()), _MARKS, "")

    def fold(low: Column) -> Column:
        letters = F.array_distinct(F.split(F.regexp_replace(low, r"[\x00-\x7F]+", ""), ""))
        pairs = F.transform(letters, lambda x: let(by_tables(x), lambda y: F.struct(_wide(y).alias("last"), x.alias("letter"), y.alias("folded"))))
        changed = F.filter(pairs, lambda x: x["letter"] != x["folded"])
        few = let(F.sort_array(changed), lambda xs: F.when(F.size(xs) <= _FEW_LETTERS, replaced(low, xs)).otherwise(by_tables(low)))
        return F.when(_wide(low), few).otherwise(low)

    def replaced(low: Column, pairs: Column) -> Column:
        return F.aggregate(pairs, low, lambda s, x: F.replace(s, x["letter"], x["folded"]))

    return let(F.lower(text(c)), fold)


def normalize_for_match(c: Column | str) -> Column:
    """the comparison key of a title or name."""
    out = F.regexp_replace(ascii_fold(c), _NOISE, " ")
    out = F.regexp_replace(out, r"[^\p{L}\p{M}\p{N}]+", " ")
    out = F.regexp_replace(out, r" (?:feat|ft|featuring|prod) .*\z", "")
    return F.trim(out)


#: Characters whose presence means composition may change a string that holds them.
RECOMPOSABLE = r"[\x{1100}-\x{11FF}\x{3099}\x{309A}\x{09BE}\x{09D7}\x{0B3E}\x{0B56}\x{0B57}\x{0BBE}\x{0BD7}\x{0C56}\x{0CC2}\x{0CD5}\x{0CD6}\x{0D3E}\x{0D57}\x{0DCA}\x{0DCF}\x{0DDF}\x{102E}\x{1B35}]"


def compose(df, column: str):
    """Bring a text column to composed form (NFC) before it is linked.

    Spark has no built-in for it. Only rows holding a character that can recompose
    (conjoining jamo, separate voicing marks, two-part Indic vowels) visit Python.
    """
    schema = df.schema

    def to_nfc(batches):
        for pdf in batches:
            yield pdf.assign(**{column: pdf[column].map(lambda s: unicodedata.normalize("NFC", s))})

    rare = F.coalesce(F.col(column).rlike(RECOMPOSABLE), F.lit(False))
    return df.filter(~rare).unionByName(df.filter(rare).mapInPandas(to_nfc, schema))


# ── Edit distance ────────────────────────────────────────────────────────────

def tolerance(a: Column, b: Column, percent: int, least: int) -> Column:
    """``max(least, ⌊percent · longer length⌋)`` in whole numbers."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.greatest(F.lit(least), F.floor(longer * percent / 100).cast("int"))


def within(a: Column, b: Column, tol: Column | int) -> Column:
    """Edit distance at most ``tol``; equality and length are looked at first."""
    tol = F.lit(tol) if isinstance(tol, int) else tol
    bounded = F.call_function("levenshtein", a, b, tol).between(F.lit(0), tol)
    near = F.abs(F.length(a) - F.length(b)) <= tol
    return F.when(a == b, True).when(near, bounded).otherwise(False)


def track_distance(a: Column | str, b: Column | str) -> Column:
    """F4 on comparison keys."""
    return F.levenshtein(normalize_for_match(a), normalize_for_match(b))


def keys_fuzzy(a: Column, b: Column) -> Column:
    """P3 on ready comparison keys."""
    return (a != "") & (b != "") & within(a, b, tolerance(a, b, 15, 2))


def keys_strong(a: Column, b: Column) -> Column:
    """P4 on ready comparison keys."""
    held = (F.length(a) >= 3) & (F.length(b) >= 3) & (F.contains(a, b) | F.contains(b, a))
    return (a != "") & (b != "") & (held | within(a, b, tolerance(a, b, 20, 2)))


def fuzzy_track_match(a: Column | str, b: Column | str) -> Column:
    """Same title within 15 % edits."""
    return keys_fuzzy(normalize_for_match(a), normalize_for_match(b))


def artist_match_strong(a: Column | str, b: Column | str) -> Column:
    """Same artist: equal, contained, or within 20 % edits."""
    return keys_strong(normalize_for_match(a), normalize_for_match(b))


def metadata_matches_title(meta: Column | str, raw: Column | str) -> Column:
    """One comparison key holds the other."""
    a, b = normalize_for_match(raw), normalize_for_match(meta)
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def tokens(key: Column) -> Column:
    """Distinct words of a comparison key."""
    return F.array_distinct(F.filter(F.split(key, " "), lambda t: t != ""))


def identity_covers(
    row_artist: Column | str, row_track: Column | str, track: Column | str, artist: Column | str
) -> Column:
    """Every wanted word occurs in the row's artist and track text."""
    have = tokens(normalize_for_match(F.concat_ws(" ", text(row_artist), text(row_track))))
    want = tokens(normalize_for_match(F.concat_ws(" ", text(track), text(artist))))
    return (F.size(want) > 0) & (F.size(F.array_except(want, have)) == 0)


# ── Durations ────────────────────────────────────────────────────────────────

def _both_positive(a: Column, b: Column) -> Column:
    return (F.coalesce(a, F.lit(0.0)) > 0) & (F.coalesce(b, F.lit(0.0)) > 0)


def duration_corroborates(a: Column | str, b: Column | str, seconds: float = 5) -> Column:
    """P5: both known and at most ``seconds`` apart."""
    a, b = col(a), col(b)
    return _both_positive(a, b) & (F.abs(a - b) <= seconds)


def duration_penalty(a: Column | str, b: Column | str) -> Column:
    """Free within 10 s, then one point per 5 s, at most 8."""
    a, b = col(a), col(b)
    over = F.least((F.abs(a - b) - 10) / 5, F.lit(8.0))
    return F.when(_both_positive(a, b), F.greatest(over, F.lit(0.0))).otherwise(F.lit(0.0))


# ── Title cleaning ───────────────────────────────────────────────────────────

# The patterns of title tags, in order. The alternatives of a step are removed together;
# the flag says whether case is ignored. The next pattern is a cheap one found in whatever the step
# would match: a title without it skips the step. The last one is how every match of the step begins:
# a place without it is passed over before its alternatives are tried.
_CLEANING = [
    ([
        r"\s*\(official[^)]*\)", r"\s*\[official[^\]]*\]",
        r"\s*\(officiel[^)]*\)",
        r"\s*\(\s*v[ií]deo\s+oficial\s*\)", r"\s*\[\s*v[ií]deo\s+oficial\s*\]",
        r"\s*\(\s*oficial\s*\)", r"\s*\[\s*oficial\s*\]",
        r"\s*\(\s*en\s+vivo[^)]*\)", r"\s*\(\s*en\s+directo[^)]*\)",
        r"\s*\(lyrics?[^)]*\)", r"\s*\[lyrics?[^\]]*\]",
        r"\s*\(audio\)", r"\s*\[audio\]",
        r"\s*\(\s*video\s*\)", r"\s*\[\s*video\s*\]",
        r"\s*\(\s*visuali[sz]er\s*\)", r"\s*\[\s*visuali[sz]er\s*\]",
        r"\s*\([^)]*\b(?:4k|8k|uhd|full\s*hd|hd|hq|2160p|1440p|1080p?|720p)\b[^)]*\)",
        r"\s*\[[^\]]*\b(?:4k|8k|uhd|full\s*hd|hd|hq|2160p|1440p|1080p?|720p)\b[^\]]*\]",
        r"\s*\((?:cd|lp|ep|album|single)\)", r"\s*\[(?:cd|lp|ep|album|single)\]",
        r"\s*\([^)]*\bremaster(?:ed)?\b[^)]*\)", r"\s*\[[^\]]*\bremaster(?:ed)?\b[^\]]*\]",
        r"\s*\([^)]*\b(?:remix|rmx)\b[^)]*\)", r"\s*\[[^\]]*\b(?:remix|rmx)\b[^\]]*\]",
        r"\s*\(live[^)]*\)", r"\s*\[live[^\]]*\]",
        r"\s*\((?:feat|ft|featuring|with|w)\.?\s[^)]*\)", r"\s*\[(?:feat|ft|featuring|with|w)\.?\s[^\]]*\]",
    ], True, r"[\(\[]", r"\s*[\(\[]"),
    ([r"\s*\b(?:feat|ft|featuring)\.?\s+.+$"], True, r"f(?:ea)?t", r"\s*f"),
    ([r"\s*\(\d{4}[^)]*\)", r"\s*\[\d{4}[^\]]*\]"], False, r"[\(\[]\d", r"\s*[\(\[]\d"),
    ([r"\s*[\(\[]?\b(?:full\s*hd|hd|uhd|4k|8k|hq|m\/?v|av)\b[\)\]]?\s*$"], True, r"hd|4k|8k|hq|m\/?v|av", r"\s*[\(\[]?[fhu48ma]"),
    ([r"\s*[\(\[]?\b(?:official\s+(?:music\s+)?(?:video|mv)|official\s+audio|lyric\s+video|lyrics?|audio|visuali[sz]er)\b[\)\]]?\s*$"], True, r"video|mv|audio|lyric|visuali", r"\s*[\(\[]?[olav]"),
    ([r"\s*\|\s*spotify\s*$", r"\s*-\s*youtube\s*$", r"\s*-\s*soundcloud\s*$"], True, r"spotify|youtube|soundcloud", r"\s*[|-]"),
    ([r"(\s*,\s*\p{Lu}\p{Ll}+(?:\s+\p{Lu}\p{Ll}+){0,2}){2,}\s*$"], False, r",", r"\s*,"),
    ([r"\s*[\(\[|:-]\s*(?:full\s+)?(?:video|audio)\s+song\s*[\)\]]?\s*$"], True, r"song", r"\s*[\(\[|:-]"),
    ([
        r"\s*[-–—|]\s*(?:full\s+)?(?:video|audio)\s+song(?=\s*\|)",
        r"\s*[-–—|]\s*lyrical(?:\s+video)?(?=\s*\|)",
        r"\s*\((?:full\s+)?(?:video|audio)\s+song[^)]*\)", r"\s*\[(?:full\s+)?(?:video|audio)\s+song[^\]]*\]",
        r"\s*\(lyrical(?:\s+video)?[^)]*\)", r"\s*\[lyrical(?:\s+video)?[^\]]*\]",
    ], True, r"song|lyrical", r"\s*[\(\[|–—-]"),
    ([
        r"\s*[\(\[|:-]\s*lyrical\s*[\)\]]?\s*$",
        r"\s*\((?:audio\s+)?jukebox[^)]*\)", r"\s*[\|\-]\s*(?:audio\s+)?jukebox\s*$",
    ], True, r"lyrical|jukebox", r"\s*[\(\[|:-]"),
    ([
        r"\s*\((?:[^)]*\b)?ost\b[^)]*\)", r"\s*\[(?:[^\]]*\b)?ost\b[^\]]*\]",
        r"\s*[\|\-]\s*[^|\-]*\bost\b\s*$",
        r"\s*[\(\[]\s*(?:viet|eng|indo)sub[^\)\]]*[\)\]]",
        r"\s*[\|\-]\s*(?:viet|eng|indo)sub.*$",
        r"\s*[\(\[]\s*karaoke\s*(?:beat|version)?[^\)\]]*[\)\]]",
    ], True, r"ost|sub|karaoke", r"\s*[\(\[|-]"),
    ([
        r"\s*【[^】]*(?:官方|歌詞|歌词|動態|动态|完整版|高清|現場|现场|音頻|音频|MV|4K|HD)[^】]*】",
        r"\s*「[^」]*(?:官方|歌詞|歌词|動態|动态|完整版|高清|現場|现场|音頻|音频|MV|4K|HD)[^」]*」",
        r"\s*『[^』]*(?:官方|歌詞|歌词|動態|动态|完整版|高清|現場|现场|音頻|音频|MV|4K|HD)[^』]*』",
    ], True, r"[【「『]", r"\s*[【「『]"),
]
_PICTOGRAPHS = (
    r"[\x{1F000}-\x{1FAFF}\x{2190}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}\x{200D}]"
)
CLEANING_PASSES = 8


def _cleaning_pass(c: Column) -> Column:
    def step(acc: Column, tags: tuple) -> Column:
        patterns, ignore_case, sign, head = tags
        tag = f"(?={head})(?:{'|'.join(patterns)})"
        cut = lambda s: F.when(has(s, sign, ignore_case), sub(s, tag, "", ignore_case)).otherwise(s)
        return let(acc, cut)

    return strip(reduce(step, _CLEANING, c))


#: A title no cleaning step could touch: letters, digits and blanks without a tag word.
_TAG_WORDS = (
    r"(?=[fhu48malvo\(\[|:,\-–—【「『])(?:\b(?:feat|ft|featuring|full\s*hd|hd|uhd|4k|8k|hq|m\/?v|av|lyrics?"
    r"|audio|visuali[sz]er|official|ost|lyrical)\b|[\(\[|:,\-–—【「『])"
)


def clean_title(c: Column | str) -> Column:
    """drop badges, pictographs and tags until nothing changes (at most 8 passes)."""
    start = F.regexp_replace(sub(text(c), r"^\s*\(\d+\)\s+"), _PICTOGRAPHS, "")
    state = F.struct(start.alias("s"), F.lit(False).alias("done"))

    def step(acc: Column, _) -> Column:
        cleaned = let(  # a lambda's body has no common subexpressions: the pass is named once
            _cleaning_pass(acc["s"]),
            lambda nxt: F.struct(nxt.alias("s"), nxt.eqNullSafe(acc["s"]).alias("done")),
        )
        return F.when(acc["done"], acc).otherwise(cleaned)

    passes = F.sequence(F.lit(1), F.lit(CLEANING_PASSES))
    cleaned = F.aggregate(passes, state, step, lambda acc: acc["s"])
    out = F.when(start.rlike(web(_TAG_WORDS, True)), cleaned).otherwise(start)
    return strip(sub(out, r"\s{2,}", " "))


# ── Names inside titles ──────────────────────────────────────────────────────

def strip_topic(c: Column | str) -> Column:
    """Drop the ``- Topic`` ending of generated channels."""
    return sub(text(c), r"\s*-\s*topic\s*$", "", True)


def strip_artist_from_track(artist: Column | str, track: Column | str) -> Column:
    """remove a repeated artist prefix followed by a blank, dash or colon."""
    artist, track = text(artist), text(track)
    fa, ft = ascii_fold(artist), ascii_fold(track)
    follow = F.substr(ft, F.length(fa) + 1, F.lit(1))
    rest = F.substr(track, F.length(artist) + 1)
    rest = strip(sub(rest, r"^[\s\-:]+"))
    repeated = (fa != "") & F.startswith(ft, fa) & follow.isin(" ", "-", ":") & (rest != "")
    return F.when(repeated, rest).otherwise(track)


def looks_like_name(c: Column) -> Column:
    """Has a letter and at least two characters."""
    return c.rlike(r"\p{L}") & (F.length(strip(c)) >= 2)


# Words of a trailing descriptor, of a noise segment, of a label.
_DESCRIPTOR = (
    "live|remaster|remastered|version|acoustic|radio edit|extended|remix|instrumental|karaoke"
    "|cover|audio|video|visuali[sz]er|session|unplugged|demo|mono|stereo|edit"
)
_SEGMENT_NOISE = "official|music|video|audio|hd|hq|4k|1080p?|lyrics?|mv|visuali[sz]er"
_LABEL = (
    r"records?|vevo|t-?series|entertainment|music\s+group|productions?|media|channel|tv"
)


def is_descriptor_seg(c: Column) -> Column:
    """A droppable ending such as ``Live in Madrid``, a bare year, or ``in Tokyo``."""
    return (
        has(c, rf"\b(?:{_DESCRIPTOR})\b", True)
        | has(strip(c), r"^\(?\d{4}\)?$")
        | has(c, r"^in\s+\p{Lu}")
    )


def looks_like_noise(c: Column) -> Column:
    """Made of noise words only."""
    return has(c, rf"^(?:\s*(?:{_SEGMENT_NOISE}))+\s*$", True)


def is_label(c: Column) -> Column:
    """Names a label or channel."""
    return has(c, rf"\b(?:{_LABEL})\b", True)


def clean_artist(c: Column | str) -> Column:
    """without count badge and trailing parenthetical gloss."""
    return strip(sub(sub(text(c), r"^\s*\(\d+\)\s+"), r"\s*\([^)]*\)\s*$"))


def extract_quoted(c: Column) -> Column:
    """``struct<before, inner>`` around a quoted track, or null."""
    double = r"(?s)^(.*?)[“\"]([^”\"]{2,})[”\"]"
    single = r"(?s)^(.*?)(?:^|\s)[‘']([^’']{2,}?)[’'](?=\s|$)"

    def pair(pattern: str) -> Column:
        return F.struct(group(c, pattern, 1).alias("before"), group(c, pattern, 2).alias("inner"))

    has_letter = group(c, single, 2).rlike(r"\p{L}")
    return F.when(has(c, double), pair(double)).when(has(c, single) & has_letter, pair(single))


def prefer_gloss(c: Column) -> Column:
    """a Latin gloss inside brackets wins over the text around it."""
    gloss = r"\(([A-Za-z][^)]*[A-Za-z'’])\)"
    bare = strip(sub(c, r"\s*\([^)]*\)\s*$"))
    return (
        F.when(has(c, gloss), strip(group(c, gloss)))
        .when(bare != "", bare)
        .otherwise(strip(c))
    )


def split_colon(c: Column) -> Column:
    """``struct<left, right>`` of ``A: B``, or null for structural colons."""
    pattern = r"^([^:]+?)\s*:\s+(.+)$"
    left, right = strip(group(c, pattern, 1)), strip(group(c, pattern, 2))
    structural = has(right, r"^(?:vol|pt|part|no|chapter|episode|act|season)\b|^\d", True)
    ok = has(c, pattern) & looks_like_name(left) & looks_like_name(right) & ~structural
    return F.when(ok, F.struct(left.alias("left"), right.alias("right")))


def strip_num(c: Column) -> Column:
    """F8: without a leading track number."""
    return sub(c, r"^\d{1,2}[\s.\-]+")


def strip_colon_noise(c: Column) -> Column:
    """F8: without trailing ``: official …`` noise."""
    return strip(sub(c, r"\s*:\s*(?:official|music|video|audio|lyrics?).*$", "", True))


def candidate_key(artist: Column, track: Column, album: Column) -> Column:
    """lower-cased identity of a candidate."""
    return F.concat_ws("|", *(F.lower(text(c)) for c in (artist, track, album)))


def cache_key(artist: Column | str, track: Column | str, video_key: Column | str) -> Column:
    """lookup identity; equal names on different videos stay apart."""
    return F.concat_ws("|", text(video_key), F.lower(text(artist)), F.lower(text(track)))


# Script of the title → word to search lyrics with, first match wins.
_SEARCH_TERMS = [
    (r"[\x{0900}-\x{097F}]", "गाने के बोल"),
    (r"[\x{0E00}-\x{0E7F}]", "เนื้อเพลง"),
    (r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]", "歌詞"),
    (r"[\x{AC00}-\x{D7AF}]", "가사"),
    (r"(?iu)[ơưđạảềếễệ]", "lời bài hát"),
]


def detect_script_term(c: Column | str) -> Column:
    """localized search word by the script of the title."""
    c = text(c)
    first, *rest = _SEARCH_TERMS
    out = F.when(c.rlike(first[0]), F.lit(first[1]))
    for pattern, term in rest:
        out = out.when(c.rlike(pattern), F.lit(term))
    return out.otherwise(F.lit("lyrics"))

