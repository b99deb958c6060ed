"""Registered queries: ``(spark, sf_dir) → DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock, records, urls
from ..functions import text as tx
from ..functions.tokens import line_tokens
from ..operators import candidates as cd
from ..operators import evaluate as ev
from ..operators import feedback as fb
from ..operators import linkage as lk
from ..operators import playlists as pl
from ..operators import signal as sg
from ..operators import timeline as tl
from ..operators import usage as us
from ..sources import captions as cp
from ..sources import catalog as ct
from ..sources import pages as pg
from ..sources import sinks
from ..sources.lyrics import read_lrc
from ..streaming import jobs
from . import inputs as inp

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def micros(c: str) -> Column:
    return F.unix_micros(c)


# ── Text ─────────────────────────────────────────────────────────────────────

@query
def normalize_titles(spark, sf):
    """F1–F3 over whole documents."""
    docs = inp.table(spark, sf, "documents")
    keyed = docs.select("doc_id", tx.normalize_for_match("text").alias("key"))
    return keyed.select("doc_id", F.md5(F.encode("key", "UTF-8")).alias("key_md5"), F.length("key").alias("key_chars"))


@query
def clean_titles(spark, sf):
    """F5 over tagged part titles."""
    return inp.part_titles(spark, sf).select("title_id", tx.clean_title("raw_title").alias("clean"))


@query
def video_keys(spark, sf):
    """F10–F13, P9 over page URLs."""
    pages = inp.table(spark, sf, "pages")
    key = urls.derive_video_key("url")
    return pages.select(
        "page_id",
        key.alias("video_key"),
        urls.path_key("url").alias("path_key"),
        urls.caption_key("url").alias("caption_key"),
        urls.site_of(key).alias("site"),
        urls.is_youtube_watch("url").alias("fetchable"),
        urls.is_different_path("url", F.regexp_replace("url", r"[?#].*", "")).alias("moved"),
    )


@query
def page_text(spark, sf):
    """The article of each page as a marked lyrics container."""
    pages = inp.table(spark, sf, "pages")
    marked = F.replace(
        F.replace("html", F.lit("<article>"), F.lit(f"<div {pg.LYRICS_MARKER}>")), F.lit("</article>"), F.lit("</div>")
    )
    text = pg.pages_lyrics(pages.select("page_id", marked.alias("html")))
    return text.select("page_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"), F.length("text").alias("chars"))


@query
def page_metadata(spark, sf):
    """Page titles wrapped as linked data, player data or channel markup, by key."""
    pages = inp.table(spark, sf, "pages")
    title, kind = pg.page_title("html"), F.col("page_id") % 3
    linked = F.to_json(F.struct(F.lit("MusicRecording").alias("@type"), title.alias("name"),
                                F.struct(F.lit("Band").alias("name")).alias("byArtist")))
    player = F.to_json(F.struct(F.struct(title.alias("title"), F.lit("Band - Topic").alias("author")).alias("videoDetails")))
    html = (
        F.when(kind == 0, F.concat(F.lit('<script type="application/ld+json">'), linked, F.lit("</script>")))
        .when(kind == 1, F.concat(F.lit("<script>var ytInitialPlayerResponse = "), player, F.lit(";</script>")))
        .otherwise(F.concat(F.lit("<title>x</title><div id=\"owner-name\"><a href=\"/c\">"), F.col("url"), F.lit("</a></div>")))
    )
    return pg.pages_song_metadata(pages.select("page_id", html.alias("html")))


@query
def document_tokens(spark, sf):
    """F17, J12 over whole documents."""
    docs = inp.table(spark, sf, "documents")
    toks = docs.select("doc_id", "text", line_tokens("text").alias("t"))
    return toks.select(
        "doc_id",
        F.size(F.filter("t", lambda x: x["isWord"])).alias("words"),
        F.size(F.filter("t", lambda x: ~x["isWord"])).alias("separators"),
        (F.array_join(F.transform("t", lambda x: x["text"]), "") == F.col("text")).alias("lossless"),
    )


# ── Candidates and linkage ───────────────────────────────────────────────────

def _part_candidates(spark, sf, keep=None):
    return cd.explode_candidates(cd.parse_titles(inp.part_titles(spark, sf)), keep)


@query
def candidates_dash(spark, sf):
    """N1, N2, W10 on dashed titles."""
    return _part_candidates(spark, sf).select("title_id", "prio", "artist", "track")


@query
def titles_by_rule(spark, sf):
    """The candidates of titles that each rule but the dash reads."""
    parsed = cd.parse_titles(inp.ruled_titles(spark, sf), "raw_title", "meta_track", "meta_artist", "author")
    return cd.explode_candidates(parsed).select("title_id", "prio", "artist", "track", "album")


@query
def title_pieces(spark, sf):
    """What the pieces of names, links and titles are taken for."""
    part = inp.table(spark, sf, "part")
    key, name, brand, kind = F.col("p_partkey"), F.col("p_name"), F.col("p_brand"), F.col("p_partkey") % 4
    number = key.cast("string")
    pick = lambda *forms: F.coalesce(*[F.when(kind == i, f) for i, f in enumerate(forms)])
    link = pick(
        F.concat(F.lit("/watch?list=x&v=k"), number, F.lit("&t=1")), F.concat(F.lit("https://youtu.be/k"), number, F.lit("?t=2")),
        F.concat(F.lit("/shorts/k"), number), F.lit("/playlist?list=x"),
    )
    segment = pick(F.lit("Official Music Video"), F.concat(brand, F.lit(" Records")), F.concat(name, F.lit(" 2011")), name)
    ending = pick(F.concat(F.lit("Live in "), name), F.lit("(2011)"), F.lit("in Tokyo"), name)
    foreign = pick(F.concat(name, F.lit(" เพลง")), F.concat(name, F.lit(" 歌")), F.concat(name, F.lit(" 노래")), name)
    spotify = F.concat(F.lit("https://open.spotify.com/track/"), F.lpad(number, 22, "x"), F.lit("?si=1"))
    return part.select(
        "p_partkey",
        tx.strip_artist_from_track(brand, F.concat(brand, pick(F.lit(" - "), F.lit(": "), F.lit(" "), F.lit("'s ")), name)).alias("without_artist"),
        tx.clean_artist(F.concat(F.lit("(12) "), brand, F.lit(" (Gloss)"))).alias("artist"),
        tx.strip_num(F.concat(pick(F.lit("03. "), F.lit("7 "), F.lit("12-"), F.lit("123 ")), name)).alias("unnumbered"),
        tx.strip_colon_noise(F.concat(name, pick(F.lit(": Official Video"), F.lit(" : lyrics"), F.lit(": Music 4k"), F.lit(": Live")))).alias("quiet"),
        tx.prefer_gloss(pick(F.concat(F.lit("歌("), name, F.lit(")")), F.concat(name, F.lit(" (歌)")), F.lit("(1)"), name)).alias("gloss"),
        tx.looks_like_noise(segment).alias("noise"), tx.is_label(segment).alias("label"), tx.is_descriptor_seg(ending).alias("descriptor"),
        tx.detect_script_term(foreign).alias("term"),
        urls.video_id_from_href(link).alias("video_id"), urls.track_id_from_href(F.when(kind < 2, spotify).otherwise(link)).alias("track_id"),
    )


@query
def page_title_candidates(spark, sf):
    """N1, N4 on page titles with the page host as author: candidates per title."""
    pages = inp.table(spark, sf, "pages").select(
        "page_id", pg.page_title("html").alias("raw_title"), urls.url_parts("url")["host"].alias("author")
    )
    return cd.parse_titles(pages, author="author").select("page_id", F.size("candidates").alias("n"))


@query
def lookup_requests(spark, sf):
    """Distinct lookups of the three most trusted candidates."""
    requests = cd.build_requests(_part_candidates(spark, sf, keep=3))
    return requests.select("kind", "key_artist", "key_track", "query").distinct()


@query
def exact_link(spark, sf):
    """Dashed titles to the first catalog row of their best candidate."""
    catalog = inp.part_catalog(spark, sf).withColumns(
        {"artistName": F.col("albumName"), "albumName": F.lit(None).cast("string")}
    )
    wants = _part_candidates(spark, sf, keep=3).drop("album").withColumn("duration", F.lit(0.0))
    hits = lk.link_by_name(wants, catalog).filter("row_ord is not null")
    best = hits.groupBy("title_id").agg(F.min_by(F.struct("prio", "row_ord"), "prio").alias("b"))
    return best.select("title_id", "b.prio", "b.row_ord")


@query
def link_by_video(spark, sf):
    """Listened keys to the catalog rows linked to them."""
    links = inp.part_catalog(spark, sf).select(
        F.concat(F.lit("yt:k"), (F.col("duration").cast("int") % 97).cast("string")).alias("video_key"), "row_ord"
    )
    listens = inp.keyed_events(spark, sf).select("ord", "video_key")
    return lk.link_by_identity(listens, links).select("ord", "video_key", "row_ord", "matchedBy")


#: All artists of these tables are named, so the flag is left out of the results.
_KEYS = [c for c in lk.WANT if c != "w_named"]


def _signatures(spark, sf):
    wants = lk.signatures(lk.wanted(inp.part_wants(spark, sf)))
    return wants, lk.catalog_signatures(inp.part_catalog(spark, sf))


@query
def fuzzy_link(spark, sf):
    """Every accepted pair of distinct wants and rows."""
    return lk.fuzzy_link(*_signatures(spark, sf)).select(*_KEYS, "row_ord")


@query
def score_pick(spark, sf):
    """The pick and five alternatives per want."""
    picked = lk.pick_best(lk.fuzzy_link(*_signatures(spark, sf)))
    return picked.select(*_KEYS, "position", "row_ord", F.round("score", 6).alias("score"))


@query
def match_quality(spark, sf):
    """A10: how often the pick is the right part name and type."""
    wants, catalog = inp.part_wants(spark, sf), inp.part_catalog(spark, sf)
    picks = lk.pick_best(lk.fuzzy_link(*_signatures(spark, sf)), alternatives=0)
    rows = catalog.select("row_ord", "artistName", "trackName")
    chosen = lk.wanted(wants).join(picks.select(*lk.WANT, "row_ord", "r_synced"), lk.WANT).join(rows, "row_ord")
    results = chosen.select(F.col("want_id").alias("title_id"), "artistName", "trackName", F.col("r_synced").alias("synced"))
    truth = catalog.select(F.col("row_ord").alias("title_id"), F.col("artistName").alias("trueArtist"), F.col("trackName").alias("trueTrack"))
    return ev.quality_summary(ev.match_quality(results, truth))


@query
def candidate_quality(spark, sf):
    """A10: is the true brand and name among the candidates of each title?"""
    parsed = cd.parse_titles(inp.part_titles(spark, sf))
    part = inp.table(spark, sf, "part").select(
        F.col("p_partkey").alias("title_id"), F.col("p_brand").alias("trueArtist"), F.col("p_name").alias("trueTrack")
    )
    return ev.candidate_summary(ev.candidate_quality(parsed.join(part, "title_id")))


@query
def broad_search(spark, sf):
    """Accepted pairs sharing half of the wanted words."""
    pairs = lk.search_broad(inp.part_wants(spark, sf), inp.part_catalog(spark, sf))
    return pairs.select(*_KEYS, "row_ord")


@query
def token_search(spark, sf):
    """Best document holding every word of a benchmark item."""
    items = inp.table(spark, sf, "benchmark").select(
        "item_id", F.lit("").alias("artist"), F.col("text").alias("track"), F.lit(0.0).alias("duration")
    )
    docs = inp.table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_ord"), F.lit("").alias("artistName"), F.col("text").alias("trackName"),
        F.lit(None).cast("string").alias("syncedLyrics"), F.lit("x").alias("plainLyrics"), F.lit(0.0).alias("duration"),
    )
    return lk.search_all_terms(items, docs).select("item_id", "row_ord", F.round("score", 6).alias("score"))


# Part types as lookup sources, most trusted first.
SOURCES = {"community": ["SMALL", "LARGE"], "main": ["ECONOMY", "PROMO"], "fallback": ["STANDARD", "MEDIUM"]}


@query
def waterfall(spark, sf):
    """Three sources in order, each seeing only what is still unmatched."""
    part = inp.table(spark, sf, "part")
    wants = part.select(F.col("p_partkey").alias("want_id"), F.col("p_brand").alias("artist"), F.col("p_name").alias("track"), F.lit(0.0).alias("duration"))
    catalog = inp.part_catalog(spark, sf).withColumns({"kind": F.col("artistName"), "artistName": F.col("albumName")}).drop("albumName")

    def stage(kinds):
        rows = catalog.filter(F.col("kind").isin(*kinds))
        return lambda pending: lk.link_by_name(pending, rows).filter("row_ord is not null")

    stages = [(name, stage(kinds)) for name, kinds in SOURCES.items()]
    return lk.waterfall_link(wants, stages, "want_id").select("want_id", "source", "row_ord")


@query
def resolved_songs(spark, sf):
    """Events as per-candidate results of a song, one resolved per song."""
    events = inp.keyed_events(spark, sf)
    results = events.select(
        F.concat_ws("-", "user", F.col("k").cast("string")).alias("song"),
        F.col("ord").alias("prio"),
        (F.col("event") != "error").alias("found"),
        F.col("event").isin("purchase", "signup").alias("synced"),
        F.when(F.col("event") == "signup", "video-id").otherwise("name").alias("matchedBy"),
        F.when(F.col("event") != "click", F.col("value")).alias("score"),
    )
    return lk.priority_resolve(results, "song").select("song", "prio", "synced", "matchedBy")


@query
def confirmed_hits(spark, sf):
    """Nearest title hit by a matching artist among rows sharing half the words."""
    pairs = lk.search_broad(inp.part_wants(spark, sf), inp.part_catalog(spark, sf))
    return lk.artist_confirmed_hits(pairs).select(*_KEYS, "row_ord", "distance")


@query
def catalog_responses(spark, sf):
    """Catalog rows from objects and arrays of JSON answers."""
    row = F.struct(
        F.col("p_name").alias("trackName"), F.col("p_brand").alias("artistName"), F.col("p_size").alias("duration"),
        F.when(F.col("p_size") % 2 == 0, "[00:01.00] la").alias("syncedLyrics"),
    )
    one, many = F.to_json(row), F.to_json(F.array(row, row))
    part = inp.table(spark, sf, "part")
    answers = part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, one).otherwise(many).alias("body"))
    rows = lk.usable_rows(ct.catalog_from_responses(answers))
    return rows.select("p_partkey", "artistName", "trackName", F.col("duration").cast("int").alias("duration"))


# ── Time-coded text ──────────────────────────────────────────────────────────

@query
def lrc_lines(spark, sf):
    """S1, O1 over lyric documents made of conversation turns."""
    return read_lrc(inp.lrc_documents(spark, sf)).select("song_id", "line_idx", "time", "text")


@query
def caption_cues(spark, sf):
    """S2–S5 over caption documents in four formats."""
    return cp.read_captions(inp.caption_documents(spark, sf))


@query
def line_ends(spark, sf):
    """W5."""
    return tl.line_ends(inp.conversation_lines(spark, sf)).select("song_id", "line_idx", "time", "end")


@query
def lyric_gaps(spark, sf):
    """W6."""
    gaps = tl.lyric_gaps(inp.conversation_lines(spark, sf))
    return gaps.select("song_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "next_idx")


@query
def pages_of_lines(spark, sf):
    """W8."""
    lines = inp.conversation_lines(spark, sf)
    return lines.select("song_id", "line_idx", tl.page_of("line_idx").alias("page"))


@query
def tick_line_asof(spark, sf):
    """J9."""
    placed = tl.asof_line(inp.conversation_ticks(spark, sf), inp.conversation_lines(spark, sf))
    return placed.select("tick_id", "song_id", "line_idx")


@query
def tick_gap(spark, sf):
    """J10."""
    gaps = tl.lyric_gaps(inp.conversation_lines(spark, sf))
    placed = tl.gap_at(inp.conversation_ticks(spark, sf), gaps)
    return placed.select("tick_id", "gap_idx", "staged_idx")


@query
def tick_word(spark, sf):
    """J11."""
    placed = tl.word_at(inp.conversation_ticks(spark, sf), inp.conversation_lines(spark, sf))
    return placed.select("tick_id", "word_idx", "word", "state")


@query
def dedupe_captions(spark, sf):
    """Event types per user as polled captions."""
    events = inp.keyed_events(spark, sf)
    captions = events.select(
        F.col("user").alias("doc_id"), F.col("ord").alias("cue_idx"), F.col("value").alias("time"), F.col("event").alias("text")
    )
    kept = tl.dedupe_consecutive(captions)
    return kept.select("doc_id", "cue_idx", "text", F.round("time", 6).alias("time"))


@query
def playback_grid(spark, sf):
    """Sparse states of each user on an hourly grid."""
    states = inp.keyed_events(spark, sf).select(
        F.col("user").alias("song_id"), "ts", "ord", F.col("value").alias("time"), F.lit(0.0).alias("duration"),
        (F.col("event") == "error").alias("paused"),
    )
    grid = tl.playback_ticks(states, step_ms=3_600_000, order=("ts", "ord"))
    return grid.select(F.col("song_id").alias("user"), micros("ts").alias("at"), F.round("t", 3).alias("t"))


@query
def pause_detection(spark, sf):
    """Event types as shown positions, a stall of twelve hours."""
    polls = inp.keyed_events(spark, sf).select(F.col("user").alias("song_id"), "ts", "ord", F.col("event").alias("position"))
    return tl.pause_detection(polls, stall_ms=inp.SILENCE * 1000, order=("ts", "ord")).select("ord", "paused")


# ── Usage ────────────────────────────────────────────────────────────────────

def _segments(spark, sf):
    return us.listen_segments(inp.listen_log(spark, sf), silence_seconds=inp.SILENCE)


def _segment_columns(df):
    return df.select(
        "user", "videoKey", "videoUrl", "filterMode", "songTitle", "trackName", "artistName", "seconds",
        micros("startedAt").alias("started_us"), micros("endedAt").alias("ended_us"),
    )


@query
def listen_segments(spark, sf):
    """T1, T2, P11, S10."""
    return _segment_columns(sinks.segment_records(_segments(spark, sf)))


@query
def segments_stream(spark, sf):
    """T1 as a stream over the event table; when it has been read, each user's log is ended."""
    inp.ensure_settings(spark)
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    # a pattern may name a file as well as a folder of part files; a plain path must be a folder
    raw = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")
    log = inp.listen_log(_StreamTables(spark, raw.withColumn("ts", F.col("ts").cast("timestamp"))), sf)
    ended, ends = jobs.with_end(log)
    close = lambda: jobs.end_markers(inp.listen_log(spark, sf)).write.mode("append").parquet(ends)
    return _segment_columns(jobs.run_available(jobs.listen_segments(ended), then=close))


class _StreamTables:
    """Hands a streaming table to the view builders in place of the stored one."""

    def __init__(self, spark, frame):
        self.conf, self.frame, self.read = spark.conf, frame, self

    def parquet(self, _path):
        return self.frame


@query
def usage_totals(spark, sf):
    """A3."""
    return us.usage_totals(_segments(spark, sf))


@query
def usage_by_mode(spark, sf):
    """A4."""
    return us.usage_by_mode(_segments(spark, sf))


@query
def top_songs(spark, sf):
    """A5, W3."""
    return us.top_songs(_segments(spark, sf), 3).select("user", "videoKey", "seconds", "rank")


@query
def scoreboard(spark, sf):
    """A6."""
    return us.scoreboard(_segments(spark, sf))


@query
def achievements(spark, sf):
    """Seconds listened against tiers of part sizes."""
    progress = us.usage_totals(_segments(spark, sf)).select("user", F.lit("solo").alias("track"), F.col("totalSeconds").alias("progress"))
    sizes = inp.table(spark, sf, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))
    tiers = sizes.select(
        F.lit("solo").alias("track"), F.col("p_size").cast("string").alias("key"),
        F.concat(F.lit("Tier "), F.col("p_size").cast("string")).alias("name"), (F.col("p_size") * 20_000).cast("long").alias("threshold"),
    )
    return us.achievements(progress, tiers)[1].select("user", "earnedCount", "allCount", "nextTier", "remaining")


def _queue(spark, sf):
    orders = inp.table(spark, sf, "orders")
    return orders.select(
        F.col("o_custkey").alias("host"), F.year("o_orderdate").alias("room"), F.col("o_orderpriority").alias("guest"),
        F.concat_ws("-", "o_orderstatus", "o_orderpriority").alias("song"), (F.col("o_orderstatus") == "F").alias("played"),
    )


@query
def party_stats(spark, sf):
    """A8."""
    return us.party_stats(_queue(spark, sf))


@query
def party_top_songs(spark, sf):
    """A8, W3."""
    return us.party_top_songs(_queue(spark, sf), 2)


@query
def queue_depth(spark, sf):
    """Waiting songs per user; view adds, purchase plays."""
    events = inp.keyed_events(spark, sf).select(
        F.col("user").alias("room"), "ts", "ord",
        F.when(F.col("event") == "view", "add").when(F.col("event") == "purchase", "next").otherwise("other").alias("kind"),
    )
    return us.queue_depth(events).select("ord", "depth")


# ── Feedback ─────────────────────────────────────────────────────────────────

@query
def vote_tally(spark, sf):
    """A1, W4, F19."""
    return fb.vote_tally(inp.vote_log(spark, sf))


@query
def latest_votes(spark, sf):
    """W4."""
    return fb.latest_per_user(inp.vote_log(spark, sf)).select("user", "video_key", "ord")


@query
def star_average(spark, sf):
    """A2."""
    stars = fb.star_average(inp.vote_log(spark, sf))
    return stars.select("video_key", F.round("avg", 6).alias("avg"), "count")


@query
def stats_lookup(spark, sf):
    """Keys of all parts, with zeros where nobody voted."""
    keys = inp.table(spark, sf, "part").select(F.concat(F.lit("yt:k"), (F.col("p_size") * 4).cast("string")).alias("video_key"))
    return fb.stats_lookup(keys, fb.vote_tally(inp.vote_log(spark, sf)))


@query
def vote_records(spark, sf):
    """Records of purchases and errors."""
    events = inp.keyed_events(spark, sf)
    none = F.lit(None).cast("string")
    votes = events.select(
        F.col("video_key").alias("videoKey"),
        *(none.alias(c) for c in ("videoUrl", "songTitle", "trackName", "artistName", "filterMode", "comment")),
        F.when(F.col("event") == "purchase", "like").when(F.col("event") == "error", "dislike").alias("vote"),
    )
    return sinks.vote_records(votes).groupBy("videoKey", "vote", "rating").agg(F.count(F.lit(1)).alias("n"))


def _outcomes(spark, sf):
    reasons = ["queued", "rate_limited", "already_synced", "upstream", "recently_failed"]
    events = inp.keyed_events(spark, sf).filter(F.col("event") == "error")
    return events.select("video_key", inp.choose(F.col("ord"), reasons).alias("reason"), "ts", "ord")


@query
def ttl_outcomes(spark, sf):
    """T9."""
    kept = fb.ttl_outcomes(_outcomes(spark, sf))
    return kept.select("video_key", "reason", micros("ts").alias("at"), micros("expires_at").alias("until"))


@query
def unrequested(spark, sf):
    """Purchases whose key no outcome holds back."""
    requests = inp.keyed_events(spark, sf).filter(F.col("event") == "purchase").select("ord", "video_key", "ts")
    return fb.unrequested(requests, _outcomes(spark, sf)).select("ord", "video_key")


@query
def sync_eligible(spark, sf):
    """Conversation turns as fallback lyrics of a song."""
    turns = inp.table(spark, sf, "conversations")
    key = F.concat(F.lit("yt:k"), F.col("conv_id").cast("string"))
    songs = turns.select(
        "conv_id", "turn", key.alias("video_key"), key.alias("resolved_key"), F.col("role").alias("trackName"), F.lit("a").alias("artistName"),
        F.lit(None).cast("string").alias("syncedLyrics"), F.col("text").alias("plainLyrics"),
        (F.col("turn") == 3).alias("wordTimed"), F.lit(False).alias("hasWords"), F.lit("2024-02-01").cast("timestamp").alias("ts"),
    )
    eligible = fb.should_request_sync(songs, _outcomes(spark, sf))
    return eligible.select("conv_id", "turn", urls.url_for_key("video_key", F.lit(None).cast("string")).alias("url"))


@query
def negative_cache(spark, sf):
    """Views as lookups, errors as misses, signups as refreshes; a day to live."""
    events = inp.keyed_events(spark, sf).withColumn("cache_key", tx.cache_key(F.lit(""), F.lit(""), "video_key"))
    told = events.select(
        "cache_key", "ts", F.when(F.col("event") == "error", "miss").when(F.col("event") == "signup", "refresh").alias("kind")
    )
    looks = events.filter(F.col("event") == "view").select("cache_key", "ts", "ord")
    return fb.negative_cache(looks, told, ttl=fb.DAY).select("ord", "suppressed")


@query
def demand_votes(spark, sf):
    """A9."""
    requests = inp.keyed_events(spark, sf).select(F.col("video_key").alias("song_key"), "user")
    return fb.demand_votes(requests)


@query
def keep_newest(spark, sf):
    """W9."""
    entries = inp.keyed_events(spark, sf).select("user", F.col("ord").alias("key"), "ts")
    return fb.keep_newest(entries, 5).select("user", "key")


@query
def debounce(spark, sf):
    """T4: bursts of a user closer than two hours."""
    return us.debounce(inp.keyed_events(spark, sf), "user", 7_200_000).select("user", "ord")


@query
def distinct_until_changed(spark, sf):
    """T3."""
    return us.distinct_until_changed(inp.keyed_events(spark, sf), "user", "event").select("user", "ord", "event")


@query
def once_per_key(spark, sf):
    """T8."""
    return us.once_per_key(inp.keyed_events(spark, sf), "video_key").select("video_key", "ord")


@query
def drop_stale(spark, sf):
    """T5: events as results whose generation lags by up to four days."""
    events = inp.keyed_events(spark, sf).withColumn("generation", F.dayofmonth("ts") - F.col("ord") % 5)
    return us.drop_stale(events, "video_key").select("video_key", "ord")


@query
def identity_guard(spark, sf):
    """Views whose key is the one their user last bought."""
    from ..operators.ordered import neighbours, time_slice

    events = inp.keyed_events(spark, sf)
    bought = events.filter(F.col("event") == "purchase")
    reigns = neighbours(bought, ["user"], ["ts", "ord"], time_slice("ts", 3600), following={"to": F.col("ts")})
    songs = reigns.select(F.col("user").alias("tab"), F.col("video_key").alias("key"), F.col("ts").alias("from"), "to")
    lyrics = events.select(F.col("user").alias("tab"), F.concat(F.lit("yt:k"), (F.col("k") - F.col("k") % 2).cast("string")).alias("key"), "ts", "ord")
    return us.song_identity_guard(lyrics, songs).select("ord")


# ── Playlists ────────────────────────────────────────────────────────────────

@query
def playlist_outcomes(spark, sf):
    """M1: the outcome of every change."""
    return pl.apply_mutations(inp.mutation_log(spark, sf))[2]


@query
def playlist_caps(spark, sf):
    """M1 at its caps: the outcome of every change with two lists a user and two items a list."""
    return pl.apply_mutations(inp.mutation_log(spark, sf), 2, 2)[2]


@query
def playlist_state(spark, sf):
    """Current lists and their sizes."""
    lists, items, _ = pl.apply_mutations(inp.mutation_log(spark, sf))
    return lists.join(pl.list_sizes(items, lists), ["user", "list_id"]).select("user", "list_id", "name", "size")


@query
def default_lists(spark, sf):
    """M2, J14."""
    log = inp.mutation_log(spark, sf)
    lists, _, outcomes = pl.apply_mutations(log)
    return pl.default_list(log, lists, outcomes)


# ── Signal ───────────────────────────────────────────────────────────────────

@query
def center_cancel(spark, sf):
    """The blend of X6 alone, without its low-pass (basic_mode is X6): energy per block."""
    clip = inp.vector_clip(spark, sf)
    left, right = sg.mid_side_blend(
        F.transform("left", lambda x: x.cast("double")), F.transform("right", lambda x: x.cast("double")), 0.85
    )
    energy = F.aggregate(left, F.lit(0.0), lambda acc, x: acc + x * x)
    total = F.aggregate(right, F.lit(0.0), lambda acc, x: acc + x)
    return clip.select("block_idx", F.round(energy, 6).alias("energy"), F.round(total, 6).alias("right_sum"))


@query
def basic_mode(spark, sf):
    """Center cancellation with bass protection, RMS per block."""
    out = sg.center_cancel(inp.vector_clip(spark, sf), 0.85, block=32)
    rms = F.sqrt(sg._square_sum("left") / F.size("left"))
    return out.select("block_idx", F.round(rms, 4).alias("rms"))


@query
def stft_filter(spark, sf):
    """X1–X5 fused: spectral center removal, RMS per block."""
    out = sg.remove_center(inp.vector_clip(spark, sf), block=32)
    rms = F.sqrt(sg._square_sum("left") / F.size("left"))
    return out.select("block_idx", F.round(rms, 4).alias("rms"))


@query
def modes(spark, sf):
    """The clip through every mode, and one that is unknown, in one pass; RMS per block."""
    name = F.explode(F.array(*[F.lit(m) for m in (*sg.MODES, "other")]))
    clips = inp.vector_clip(spark, sf).withColumn("mode", name).withColumn("clip_id", F.col("mode"))
    out = sg.mode_dispatch(clips, 0.85, block=32)
    rms = {f"rms_{s}": F.round(F.sqrt(sg._square_sum(s) / F.size(s)), 4) for s in ("left", "right")}
    return out.select("clip_id", "block_idx", *(c.alias(n) for n, c in rms.items()))


@query
def frame_features(spark, sf):
    """Mean centerness per frame."""
    table = sg.spectral_features(sg.frames(inp.vector_clip(spark, sf), block=32))
    mean = F.aggregate("centerness", F.lit(0.0), lambda acc, x: acc + x) / F.size("centerness")
    return table.select("frame_idx", F.round(mean, 4).alias("centerness"))


@query
def frame_energy(spark, sf):
    """Complete frames and their energy."""
    table = sg.frames(inp.vector_clip(spark, sf), block=32)
    return table.select("frame_idx", F.round(sg._square_sum("left"), 4).alias("energy"))


@query
def signal_quality(spark, sf):
    """X8 on the whole clip with its left channel halved."""
    clip = inp.vector_clip(spark, sf)
    top = 2**31
    q = sg.signal_quality(clip, clip.select("clip_id", "block_idx", F.transform("left", lambda x: x / 2).alias("left"), "right"), 0, top)
    return q.select("clip_id", F.round("ratio", 4).alias("ratio"), "finite", F.round("rms_in", 4).alias("rms_in"))




# ── Records ──────────────────────────────────────────────────────────────────

@query
def request_outcomes(spark, sf):
    """Reason code per request; parts of type PROMO got no answer."""
    part = inp.table(spark, sf, "part")
    key = F.concat(F.lit("yt:k"), F.col("p_partkey").cast("string")).alias("videoKey")
    status = F.when(F.col("p_size") < 20, 201).when(F.col("p_size") < 30, 401).otherwise(429)
    reason = F.when(F.col("p_type") != "SMALL", F.lower("p_type"))
    answers = part.filter(F.col("p_type") != "PROMO").select(key, status.alias("status"), reason.alias("reason"))
    return sinks.request_outcomes(part.select(key), answers)


@query
def valid_signals(spark, sf):
    """Events as signals on revisions; how many of each kind are accepted."""
    events = inp.keyed_events(spark, sf)
    signal = F.when(F.col("event") == "purchase", "explicit_up").when(F.col("event") == "error", "explicit_down").otherwise("other")
    ok = records.valid_signal(F.col("k") - 50, signal)
    return events.select(signal.alias("signal"), ok.alias("ok")).groupBy("signal", "ok").agg(F.count(F.lit(1)).alias("n"))


@query
def time_texts(spark, sf):
    """shown positions to seconds, and the playhead two seconds later."""
    events = inp.keyed_events(spark, sf)
    shown = F.concat(F.floor("value").cast("string"), F.lit(":"), F.lpad(F.col("k").cast("string"), 2, "0"))
    parsed = events.select("ord", (F.col("event") == "error").alias("paused"), clock.parse_time_text(shown).alias("seconds"))
    head = clock.interpolate("seconds", F.lit(1000), "paused", F.lit(3000))
    return parsed.select("ord", "seconds", head.alias("playhead"))


@query
def stored_snapshots(spark, sf):
    """Fresh answers or the snapshot, with its flag."""
    events = inp.keyed_events(spark, sf)
    status = F.when(F.col("event") == "error", 503).when(F.col("event") == "signup", 401).otherwise(200)
    fresh = events.select(F.col("ord").alias("user"), status.alias("status"), F.col("event").alias("lists"))
    snapshot = events.filter(F.col("k") < 50).select(F.col("ord").alias("user"), F.lit("old").alias("lists"))
    return pl.snapshot_or_stale(fresh, snapshot)


@query
def preferred_tracks(spark, sf):
    """O3: caption track per conversation; user turns count as automatic tracks."""
    docs = inp.caption_documents(spark, sf)
    turns = inp.table(spark, sf, "conversations").select(inp.turn_id().alias("doc_id"), "conv_id", "turn", "role")
    tracks = turns.join(docs, "doc_id").select(
        "conv_id", "turn", F.when(F.col("role") == "user", "asr").alias("kind"), cp.sniffed_cues("body").alias("cues")
    )
    return cp.preferred_tracks(tracks, "conv_id", "turn").select("conv_id", "turn")


@query
def list_documents(spark, sf):
    """stored playlist blobs, one per event, read and normalised."""
    events = inp.keyed_events(spark, sf)
    item = F.struct(F.when(F.col("event") != "error", F.col("video_key")).alias("videoKey"), F.col("event").alias("title"))
    named = F.struct(F.col("user").cast("string").alias("id"), F.array(item, item).alias("items"))
    broken = F.struct(F.col("user").alias("id"), F.array(item).alias("items"))
    blob = F.concat(F.lit("["), F.to_json(named), F.lit(","), F.to_json(broken), F.lit("]"))
    lists = events.select("ord", records.normalize_lists(blob).alias("lists"))
    items = F.aggregate("lists", F.lit(0), lambda acc, x: acc + F.size(x["items"]))
    return lists.select("ord", F.size("lists").alias("n_lists"), items.alias("n_items"), F.get("lists", F.lit(0))["name"].alias("name"))
