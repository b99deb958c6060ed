"""Long documents, long conversations and numbers of many digits."""

from songloom.functions import markup
from songloom.plans.queries import QUERIES


def test_long_documents_and_conversations_keep_their_lines_and_ids(spark, tmp_path):
    long = "\n".join(f"line {i}" for i in range(2000))
    turns = [(1, t, "user", "a\nb") for t in range(200)] + [(2, t, "user", "c") for t in range(200)] + [(3, 0, "user", long)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    lines = QUERIES["lrc_lines"](spark, str(tmp_path)).collect()
    assert len({r["song_id"] for r in lines}) == 401
    times = [r["time"] for r in lines if r["song_id"] == "3-0" and r["text"] != "line 0"]
    assert sorted(times) == [7.0 * i for i in range(1, 2000)]
    assert QUERIES["caption_cues"](spark, str(tmp_path)).groupBy("doc_id").count().count() == 401
    ticks = QUERIES["tick_line_asof"](spark, str(tmp_path))
    assert ticks.count() == ticks.select("tick_id").distinct().count() == 401 * 3


def test_entities_of_many_digits(value):
    assert value(markup.decode_entities, "&#0000000000000000000065;&#1000000000000000065;&#x00000000000000041;") == "AA"
