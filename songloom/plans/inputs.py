"""Media-shaped views of the benchmark tables. Each covers its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.regex import parts
from ..session import ensure_settings, load

SILENCE = 12 * 3600

# Tags put behind part names, chosen by key.
TAGS = ["", " (Official Video)", " [HD]", " (2011 - Remaster)", " ft. Someone Else", " (Live) [4K]"]

_MODES = ["stft", "basic", "stft_deep"]


#: Session setting: deal every input table to so many partitions (for benches whose small
#: files are a single split each; unset on a cluster).
INPUT_PARTITIONS = "spark.songloom.inputPartitions"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ensure_settings(spark)
    df = load(spark, sf, name)
    wanted = spark.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(wanted)) if wanted and not df.isStreaming else df


def dealt(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table dealt evenly over the shuffle width of the session, for work per row far beyond that
    of reading it: a file of a few megabytes is one split, however many titles it holds."""
    df, width = table(spark, sf, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(width) if df.rdd.getNumPartitions() < width else df


def choose(index: Column, values: list[str]) -> Column:
    """``values[index % len]`` as a column."""
    return F.get(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int"))


def part_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Messy titles ``brand - name + tag``."""
    part = dealt(spark, sf, "part")
    title = F.concat("p_brand", F.lit(" - "), "p_name", choose(F.col("p_partkey"), TAGS))
    return part.select(F.col("p_partkey").alias("title_id"), title.alias("raw_title"))


def ruled_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Every part as a title of one of eight kinds, by key: dotted, quoted, with a colon, with one
    or two bars, worded, after its channel's name, and with page metadata (right on even sizes)."""
    part = dealt(spark, sf, "part")
    b, n, t, kind = F.col("p_brand"), F.col("p_name"), F.col("p_type"), F.col("p_partkey") % 8
    forms = [
        F.concat(n, F.lit(" • "), b, F.lit(", "), t), F.concat(b, F.lit(' "'), n, F.lit('" (Official Video)')), F.concat(b, F.lit(": "), n),
        F.concat(n, F.lit(" | "), b, F.lit(" | Official Audio")), F.concat(b, F.lit(" - "), n, F.lit(" | "), t),
        F.concat(n, F.lit(" - song and lyrics by "), b), F.concat(b, F.lit(" "), n, F.lit(" [HD]")), F.concat(n, F.lit(" (Live)")),
    ]
    title = F.coalesce(*[F.when(kind == i, f) for i, f in enumerate(forms)])
    return part.select(
        F.col("p_partkey").alias("title_id"), title.alias("raw_title"),
        F.when(kind == 6, F.concat(b, F.lit(" - Topic"))).otherwise("").alias("author"),
        F.when(kind == 7, F.when(F.col("p_size") % 2 == 0, n).otherwise("Another Thing")).otherwise("").alias("meta_track"),
        F.when(kind == 7, F.concat(F.lit("(3) "), b)).otherwise("").alias("meta_artist"),
    )


def part_wants(spark: SparkSession, sf: str) -> DataFrame:
    """Wanted songs: the part name with one character changed, by key."""
    part = table(spark, sf, "part")
    at = (F.col("p_partkey") % F.length("p_name") + 1).cast("int")
    changed = F.concat(F.substr("p_name", F.lit(1), at - 1), F.lit("x"), F.substr("p_name", at + 1))
    return part.select(
        F.col("p_partkey").alias("want_id"),
        F.col("p_type").alias("artist"),
        changed.alias("track"),
        (100 + 2 * F.col("p_size")).cast("double").alias("duration"),
    )


def part_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog rows by type and name; synced where the price is even."""
    part = table(spark, sf, "part")
    synced = F.col("p_size") % 2 == 0
    return part.select(
        F.col("p_partkey").alias("row_ord"),
        F.col("p_type").alias("artistName"),
        F.col("p_name").alias("trackName"),
        F.col("p_brand").alias("albumName"),
        (100 + 2 * F.col("p_size")).cast("double").alias("duration"),
        F.when(synced, "[00:01.00] la").alias("syncedLyrics"),
        F.lit("la").alias("plainLyrics"),
    )


def _text_lines(c: str = "text") -> Column:
    return parts(F.col(c), "\n")


def _stamp(seconds: Column) -> Column:
    """``mm:ss.00`` of whole seconds."""
    minutes = F.floor(seconds / 60)
    shown = minutes.cast("string")
    return F.concat(
        F.lpad(shown, F.greatest(F.length(shown), F.lit(2)), F.lit("0")), F.lit(":"),
        F.lpad((seconds - minutes * 60).cast("string"), 2, "0"), F.lit(".00"),
    )


def turn_id() -> Column:
    """A conversation's turn as one id."""
    return F.concat_ws("-", "conv_id", "turn")


def lrc_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn as a lyric document: line ``i`` at ``7·i`` seconds, the refrain twice."""
    turns = table(spark, sf, "conversations")

    def line(text: Column, i: Column) -> Column:
        again = F.when(i == 0, F.lit("[30:00.00]")).otherwise("")
        return F.concat(F.lit("["), _stamp(i * 7), F.lit("]"), again, text)

    body = F.array_join(F.transform(_text_lines(), line), "\n")
    return turns.select(turn_id().alias("song_id"), body.alias("lrc"))


def caption_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn as a caption document in one of four formats, cue ``i`` at ``7·i``."""
    turns = table(spark, sf, "conversations")
    lines = _text_lines()

    def vtt(text: Column, i: Column) -> Column:
        start = F.regexp_replace(_stamp(i * 7), r"\.00", ".000")
        return F.concat(start, F.lit(" --> 59:00.000\n"), text)

    def event(text: Column, i: Column) -> Column:
        return F.struct((i * 7000).alias("tStartMs"), F.array(F.struct(text.alias("utf8"))).alias("segs"))

    def srv3(text: Column, i: Column) -> Column:
        return F.concat(F.lit('<p t="'), (i * 7000).cast("string"), F.lit('">'), text, F.lit("</p>"))

    def srv1(text: Column, i: Column) -> Column:
        return F.concat(F.lit('<text start="'), (i * 7).cast("string"), F.lit('">'), text, F.lit("</text>"))

    kind = F.col("turn") % 4
    body = (
        F.when(kind == 0, F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(lines, vtt), "\n\n")))
        .when(kind == 1, F.to_json(F.struct(F.transform(lines, event).alias("events"))))
        .when(kind == 2, F.concat(F.lit("<timedtext><body>"), F.array_join(F.transform(lines, srv3), ""), F.lit("</body></timedtext>")))
        .otherwise(F.concat(F.lit("<transcript>"), F.array_join(F.transform(lines, srv1), ""), F.lit("</transcript>")))
    )
    return turns.select(turn_id().alias("doc_id"), body.alias("body"))


def conversation_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A conversation as a song: turn ``i`` is a line at ``7.5·i + 6``, its words 50 ms apart."""
    turns = table(spark, sf, "conversations")
    time = F.col("turn") * 7.5 + 6
    words = F.transform(
        F.filter(F.split("text", r"\s+"), lambda w: w != ""),
        lambda w, i: F.struct((time + i / 20).alias("time"), w.alias("text")),
    )
    return turns.select(
        F.col("conv_id").alias("song_id"),
        F.col("turn").cast("int").alias("line_idx"),
        time.cast("double").alias("time"),
        "text",
        words.alias("words"),
    )


def conversation_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Three clock ticks per turn; odd turns are paused."""
    turns = table(spark, sf, "conversations")
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate((0.0, 2.5, 5.25))]))
    ticks = turns.select("conv_id", "turn", step.alias("x"))
    return ticks.select(
        F.concat_ws("-", turn_id(), F.col("x.i")).alias("tick_id"),
        F.col("conv_id").alias("song_id"),
        (F.col("turn") * 7.5 + F.col("x.s")).cast("double").alias("t"),
        (F.col("turn") % 2 == 1).alias("paused"),
    )


def keyed_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their number ``k`` and the video key it stands for."""
    events = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("user_id").alias("user"),
        "ts",
        F.col("event_id").alias("ord"),
        F.col("event_type").alias("event"),
        "value",
        k.alias("k"),
        F.concat(F.lit("yt:k"), k.cast("string")).alias("video_key"),
    )


def listen_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a listening log: signup starts, view beats, click changes the mode,
    purchase changes the song, error stops."""
    events = keyed_events(spark, sf)
    kind = F.col("event")
    song = F.struct(
        F.col("video_key").alias("videoKey"),
        F.concat(F.lit("Song "), F.col("k").cast("string")).alias("songTitle"),
        F.concat(F.lit("Track "), F.col("k").cast("string")).alias("trackName"),
        F.concat(F.lit("Artist "), (F.col("k") % 10).cast("string")).alias("artistName"),
        F.concat(F.lit("https://www.youtube.com/watch?v=k"), F.col("k").cast("string")).alias("videoUrl"),
    )
    return events.select(
        "user",
        "ts",
        "ord",
        F.when(kind == "signup", "start").when(kind == "view", "beat").when(kind == "click", "mode")
        .when(kind == "purchase", "song").otherwise("stop").alias("kind"),
        F.when(kind == "signup", F.concat(F.lit("https://www.youtube.com/watch?v=k"), F.col("k").cast("string"))).alias("url"),
        F.when(kind.isin("signup", "click"), choose(F.col("k"), _MODES)).alias("mode"),
        F.when(kind == "purchase", song).alias("song"),
    )


def vote_log(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases are likes, errors dislikes, views legacy star ratings 0–5."""
    events = keyed_events(spark, sf).filter(F.col("event").isin("purchase", "error", "view"))
    liked = F.when(F.col("event") == "purchase", True).when(F.col("event") == "error", False)
    rating = F.when(F.col("event") == "view", F.col("ord") % 6).cast("int")
    return events.select("user", "video_key", "ts", "ord", liked.alias("liked"), rating.alias("rating"))


def mutation_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as playlist changes; each refers to the list its user created last."""
    from ..operators.ordered import neighbours, time_slice

    events = keyed_events(spark, sf)
    made = F.when(F.col("event") == "signup", F.concat(F.lit("L"), F.col("ord").cast("string")))
    seen = neighbours(
        events.withColumn("_made", made), ["user"], ["ts", "ord"], time_slice("ts", 3600), last={"_last": F.col("_made")}
    )
    action = (
        F.when(F.col("event") == "signup", "create").when(F.col("event") == "view", "add")
        .when(F.col("event") == "click", "rename").when(F.col("event") == "purchase", "remove").otherwise("delete")
    )
    key = F.concat(F.lit("k"), (F.col("k") % 4).cast("string"))
    return seen.select(
        F.col("user").cast("string").alias("user"),
        F.col("ord").alias("seq"),
        action.alias("action"),
        F.coalesce("_made", "_last", F.lit("none")).alias("list_id"),
        F.concat(F.lit("name "), F.col("k").cast("string")).alias("name"),
        key.alias("video_key"),
        F.lit("t").alias("title"),
        F.lit("u").alias("url"),
    )


def vector_clip(spark: SparkSession, sf: str) -> DataFrame:
    """All embeddings in order as one stereo clip: 32 samples per side and block."""
    vectors = table(spark, sf, "embeddings")
    return vectors.select(
        F.lit("all").alias("clip_id"),
        F.lit(48000).alias("sr"),
        F.col("vec_id").alias("block_idx"),
        F.slice("embedding", 1, 32).alias("left"),
        F.slice("embedding", 33, 32).alias("right"),
    )
