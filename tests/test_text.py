import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from songloom.functions import clock, markup, records, regex, text, tokens, urls


def column(spark, fn, values, schema="s string"):
    rows = [(v,) if not isinstance(v, tuple) else v for v in values]
    df = spark.createDataFrame(rows, schema)
    out = df.select(fn(*[F.col(c) for c in df.columns]).alias("r")).collect()
    return [r["r"] for r in out]


def test_normalize_keeps_every_script(spark):
    got = column(
        spark,
        text.normalize_for_match,
        ["तुम ही हो", "เธอคือของขวัญ", "月亮代表我的心", "Здраво", "Beyoncé – Halo (HD)", None,
         "Lose Yourself feat. Nobody", "Straße ÆON", "éhd hd"],
    )
    assert got == ["तुम ही हो", "เธอคือของขวัญ", "月亮代表我的心", "zdravo", "beyonce halo", "",
                   "lose yourself", "strasse aeon", "ehd"]


def spec_fold(s):
    table = {**text.SPECIAL_LATIN, **text.CYRILLIC}
    folded = "".join(table.get(ch, ch) for ch in s.lower())
    bare = "".join(c for c in unicodedata.normalize("NFD", folded) if not 0x300 <= ord(c) <= 0x36F)
    return unicodedata.normalize("NFC", bare)


def test_fold_equals_unicode_rules_on_random_strings(spark):
    rng = random.Random(7)
    pools = [(0x20, 0x24F), (0x370, 0x4FF), (0x1E00, 0x1EFF), (0xAC00, 0xAC80), (0x300, 0x36F),
             (0x900, 0x97F), (0x3041, 0x3096), (0x4E00, 0x4E80)]
    strings = ["".join(chr(rng.randint(*rng.choice(pools))) for _ in range(12)) for _ in range(400)]
    got = column(spark, text.ascii_fold, strings)
    for raw, g in zip(strings, got):
        assert unicodedata.normalize("NFC", g) == spec_fold(raw), raw


def test_folds_are_not_folded_again(spark):
    """A letter may fold to one that folds where it is typed; few letters, then very many."""
    pairs = ["ї і", "і ї", "ǿ ø", "ø ǿ", "ӗ е ъ", "е ӗ"]
    assert column(spark, text.ascii_fold, pairs) == ["і i", "i і", "ø o", "o ø", "е e ", "e е"]
    every = "".join(sorted({*text._decomposition(), *text.CYRILLIC, *text.SPECIAL_LATIN}))
    strings = [every[:39], every[:42], every[::5], every, every[::-1]]
    assert [unicodedata.normalize("NFC", g) for g in column(spark, text.ascii_fold, strings)] == [spec_fold(s) for s in strings]


def test_compose_touches_only_rows_that_can_recompose(spark):
    jamo = unicodedata.normalize("NFD", "한글 가사")
    df = spark.createDataFrame([(1, jamo), (2, "plain")], "id int, s string")
    got = {r["id"]: r["s"] for r in text.compose(df, "s").collect()}
    assert got == {1: "한글 가사", 2: "plain"}


@pytest.mark.parametrize("raw, want", [
    ("Adele - Hello (Official Music Video)", "Adele - Hello"),
    ("(12) Adele - Hello [4K Remastered] - YouTube", "Adele - Hello"),
    ("Song (Official Video) [HD] (2011 - Remaster)", "Song"),
    ("Artist - Song ft. Somebody Else", "Artist - Song"),
    ("Song 🎵 Lyrics", "Song"),
    ("Song | Full Video Song | Label", "Song | Label"),
    ("歌手【歌名】【官方MV】", "歌手【歌名】"),
    ("Song (Drama OST Part 2)", "Song"),
    ("Song (Live at Wembley) (Official Audio)", "Song"),
    ("Plain title", "Plain title"),
    ("Éclair (OFFICIAL VIDÉO)", "Éclair"),
    ("", ""),
])
def test_clean_title(value, raw, want):
    assert value(text.clean_title, raw) == want


def test_clean_title_skips_only_steps_without_a_match(spark):
    """Titles of all tags, against the same steps without the look ahead; a pass is planned once."""
    tags = ["(Official)", "[oficial]", "ft. Nobody", "FEAT Who", "(2011 x)", "[1999]", "Full HD", "M/V", "(4k)", "official mv", "Visualiser",
            "| Spotify", "- YouTube", ", Aa Bb, Cc", ", Dd", "- Video Song", "| lyrical |", "(lyrical x)", ": jukebox", "- jukebox", "(Audio Jukebox 1)",
            "(x OST y)", "| Drama ost", "[Vietsub]", "- indosub x", "(Karaoke beat)", "【官方】", "「4k」", "『MV』", "(a remix)", "[hq]", "(with X)"]
    rng = random.Random(4)
    titles = ["Song " + "".join(rng.choice(["", " "]) + rng.choice([*tags, "Name", "x"]) for _ in range(rng.randint(1, 5))) for _ in range(300)]

    def plain(c):
        for patterns, ignore_case, *_ in text._CLEANING:
            c = regex.sub(c, "|".join(patterns), "", ignore_case)
        return regex.strip(c)

    assert column(spark, text._cleaning_pass, titles) == column(spark, plain, titles)
    assert str(text.clean_title(F.col("s"))).count("indo)sub[^") == 1


def test_strip_takes_all_white_space_of_the_web_without_a_regular_expression(spark):
    """Same result as the pattern; the pattern looked at every place of a string."""
    blanks = [" ", "\t", "\n", "\x0b", "\f", "\r", "\u00a0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000", "\ufeff"]
    others = ["\u200b", "\u180e", "\x1c", "\x85", "é", "歌", "😀"]
    values = [f"{b}a{b} b{b}" for b in blanks + others] + ["", *blanks, "".join(blanks)]
    assert column(spark, regex.strip, values) == column(spark, lambda c: regex.sub(c, r"^\s+|\s+$"), values)
    assert "regexp" not in str(regex.strip(F.col("s")))


@pytest.mark.parametrize("a, b, want", [
    ("Hello", "Helo", True), ("Hello", "Yellow", True), ("Hello", "Goodbye", False),
    ("", "Hello", False), ("Bohemian Rhapsody", "Bohemian Rapsodi", True),
])
def test_fuzzy_track_match(value, a, b, want):
    assert value(text.fuzzy_track_match, a, b) is want


@pytest.mark.parametrize("a, b, want", [
    ("BTS (방탄소년단)", "BTS", True), ("Adele", "Lionel Richie", False), ("AC/DC", "ACDC", True),
    ("U2", "U2 Band", False), ("", "X", False),
])
def test_artist_match_strong(value, a, b, want):
    assert value(text.artist_match_strong, a, b) is want


@pytest.mark.parametrize("row_artist, row_track, track, artist, want", [
    ("Coldplay", "Yellow", "Yellow", "Coldplay", True),
    ("Coldplay", "Yellow", "Fix You", "Coldplay", False),
    ("Some Channel", "Ceca - Kukavica - (Audio 1993)", "Kukavica", "Ceca", True),
    ("Some Channel", "Neko - Kukavica", "Kukavica", "Ceca", False),
    ("Some Channel", "Seka Aleksic - Crno i zlatno", "Crno i zlatno", "Seka Aleksić", True),
])
def test_identity_covers(value, row_artist, row_track, track, artist, want):
    assert value(text.identity_covers, row_artist, row_track, track, artist) is want


def test_small_title_helpers(value):
    assert value(text.strip_artist_from_track, "Nipple", "NIPPLE: Sutra") == "Sutra"
    assert value(text.strip_artist_from_track, "Nip", "Nipple Sutra") == "Nipple Sutra"
    assert value(text.clean_artist, "(3) BTS (방탄소년단)") == "BTS"
    assert value(text.prefer_gloss, "神메뉴(God's Menu)") == "God's Menu"
    assert value(text.prefer_gloss, "Song (가사)") == "Song"
    assert value(text.extract_quoted, 'Stray Kids "MIROH" M') == ("Stray Kids ", "MIROH")
    assert value(text.extract_quoted, "Don't stop 'n' go") is None
    assert tuple(value(text.split_colon, "Artist: Song")) == ("Artist", "Song")
    assert value(text.split_colon, "Show: Vol. 53") is None
    assert value(text.strip_num, "07. Song") == "Song"
    assert value(text.strip_colon_noise, "Song : Official Video X") == "Song"
    assert value(text.is_descriptor_seg, "Live in Rome") is True
    assert value(text.is_descriptor_seg, "in Tokyo") is True
    assert value(text.is_descriptor_seg, "Nothing") is False
    assert value(text.looks_like_noise, "Official HD Video") is True
    assert value(text.is_label, "T-Series") is True
    assert value(text.detect_script_term, "तुम") == "गाने के बोल"
    assert value(text.detect_script_term, "Đêm") == "lời bài hát"
    assert value(text.detect_script_term, "Song") == "lyrics"
    assert value(text.metadata_matches_title, "Hello", "Adele - Hello") is True
    assert value(text.cache_key, "A", None, "yt:1") == "yt:1|a|"


def test_duration_rules(value):
    d = ["double", "double"]
    assert value(text.duration_corroborates, 100.0, 105.0, types=d) is True
    assert value(text.duration_corroborates, 100.0, 105.5, types=d) is False
    assert value(text.duration_corroborates, 0.0, 1.0, types=d) is False
    assert value(text.duration_penalty, 100.0, 110.0, types=d) == 0
    assert value(text.duration_penalty, 100.0, 120.0, types=d) == 2
    assert value(text.duration_penalty, 100.0, 900.0, types=d) == 8
    assert value(text.duration_penalty, None, 900.0, types=d) == 0


@pytest.mark.parametrize("url, want", [
    ("https://www.youtube.com/watch?v=abc%2Fd&t=3", "yt:abc/d"),
    ("https://m.youtube.com/watch?t=3&v=xyz", "yt:xyz"),
    ("https://youtu.be/qwe?t=1", "yt:qwe"),
    ("https://open.spotify.com/track/4uLU6hMCjMI75M1A2tKUQC?si=1", "sp:4uLU6hMCjMI75M1A2tKUQC"),
    ("https://WWW.Example.com/a/b/?x=1#y", "example.com/a/b"),
    ("https://example.com", "example.com"),
    ("not a url", None),
    (None, None),
])
def test_derive_video_key(value, url, want):
    assert value(urls.derive_video_key, url) == want


def test_url_helpers(value):
    tid = "4uLU6hMCjMI75M1A2tKUQC"
    assert value(urls.track_id_from_href, f"/intl-de/track/{tid}") == tid
    assert value(urls.track_id_from_href, f"/track/{tid}x") is None
    assert value(urls.track_id_from_href, f"/album/{tid}") is None
    assert value(urls.track_id_from_href, None) is None
    assert value(urls.video_id_from_href, "/shorts/abc?x") == "abc"
    assert value(urls.video_id_from_href, "/watch?v=q1&x=2") == "q1"
    assert value(urls.video_id_from_href, "https://youtu.be/q2") == "q2"
    assert value(urls.video_id_from_href, "/feed") is None
    watch = "https://www.youtube.com/watch?v="
    assert value(urls.url_for_key, "yt:a", watch + "a&t=1") == watch + "a&t=1"
    assert value(urls.url_for_key, "yt:a", watch + "b") == watch + "a"
    assert value(urls.url_for_key, "example.com/x", watch + "b") is None
    assert value(urls.playlist_url, "example.com/x", "http://k") == "http://k"
    assert value(urls.path_key, watch + "b&t=1") == "/watch?v=b"
    assert value(urls.caption_key, "https://x/api?v=1&lang=en") == "1|en|"
    assert value(urls.is_youtube_watch, watch + "b") is True
    assert value(urls.is_youtube_watch, "https://www.youtube.com/feed") is False
    assert value(urls.is_different_path, watch + "b", watch + "c") is False
    assert value(lambda a, b: urls.is_different_path(a, b, True), watch + "b", watch + "c") is True


@pytest.mark.parametrize("shown, want", [
    ("3:45", 225), ("12:07", 727), ("1:02:03", 3723), ("-1:30", -90), ("0:00", 0),
    (" 3:45 ", 225), ("live", None), ("345", None), ("", None), (None, None),
])
def test_parse_time_text(value, shown, want):
    assert value(clock.parse_time_text, shown) == want


@pytest.mark.parametrize("t, ts, paused, now, want", [
    (10.0, 1000, False, 3500, 12.5), (10.0, 1000, True, 3500, 10.0),
    (10.0, 5000, False, 4000, 10.0), (float("nan"), 1000, False, 2000, 0.0),
])
def test_interpolate(value, t, ts, paused, now, want):
    assert value(clock.interpolate, t, ts, paused, now,
                 types=["double", "long", "boolean", "long"]) == want


def test_entities_and_markup(value):
    assert value(markup.decode_entities, "a &amp; b &#39;c&#x1F600;&#233;&#x110000;") == "a & b 'c😀é"
    assert value(markup.decode_entities, "&amp;lt;") == "<"
    assert value(markup.html_to_text, "a<br/>b</p><i>c</i>  \n\n\n\nd") == "a\nb\nc\n\nd"


def words(toks):
    return [t["text"] for t in toks if t["isWord"]]


@pytest.mark.parametrize("line, timed, want", [
    ("Hello world again", None, ["Hello", "world", "again"]),
    ("Hello, world!", None, ["Hello,", "world!"]),
    ("Hello world", ["Hello", "world"], ["Hello", "world"]),
    ("月亮代表我的心", list("月亮代表我的心"), list("月亮代表我的心")),
    ("月亮代表我的心", None, list("月亮代表我的心")),
    ("तुम ही हो my love", None, ["तुम", "ही", "हो", "my", "love"]),
    ("Completely different text", ["nope", "missing"], ["Completely", "different", "text"]),
    ("", None, []),
])
def test_line_tokens(value, line, timed, want):
    got = value(tokens.line_tokens, line, timed, types=["string", "array<string>"])
    assert words(got) == want
    assert "".join(t["text"] for t in got) == line


def test_untimed_thai_splits_into_words(value):
    got = value(tokens.segment_untimed, "เธอคือของขวัญ")
    assert len(words(got)) > 1 and "".join(t["text"] for t in got) == "เธอคือของขวัญ"


def test_locate_words(value):
    got = value(tokens.locate_words, "la la land", ["la", "la", "land"],
                types=["string", "array<string>"])
    assert [tuple(r) for r in got] == [(0, 2), (3, 5), (6, 10)]


def test_normalize_lists(value):
    raw = ('[{"id":"a","name":"","items":[{"videoKey":"k","title":"t"},{"videoKey":5},{}]},'
           '{"id":7},{"id":"b","name":"%s","createdAt":"now"}]' % ("n" * 80))
    got = value(records.normalize_lists, raw)
    assert [(l["id"], l["name"], len(l["items"])) for l in got] == [
        ("a", "Untitled", 1), ("b", "n" * 60, 0)]
    assert tuple(got[0]["items"][0]) == ("k", "t", "", "")
    assert value(records.normalize_lists, "{broken") == []
    assert value(records.normalize_lists, None) == []


def test_votes_and_signals(value):
    t = ["boolean", "int"]
    assert value(records.normalize_vote, True, 1, types=t) is True
    assert value(records.normalize_vote, None, 4, types=t) is True
    assert value(records.normalize_vote, None, 3, types=t) is False
    assert value(records.normalize_vote, None, 0, types=t) is None
    s = ["long", "string"]
    assert value(records.valid_signal, 3, "explicit_up", types=s) is True
    assert value(records.valid_signal, 0, "explicit_up", types=s) is False
    assert value(records.valid_signal, 3, "up", types=s) is False
