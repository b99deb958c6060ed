"""Headline queries on one table folder; prints one JSON line.

``BENCH_SF_DIR`` names the folder, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES`` an
optional comma-separated choice. Each query runs in full into a sink that drops rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from songloom.plans.queries import QUERIES  # noqa: E402
from songloom.session import build_session  # noqa: E402

HEADLINE = [
    "normalize_titles", "candidates_dash", "exact_link", "fuzzy_link", "score_pick", "token_search",
    "waterfall", "document_tokens", "lrc_lines", "caption_cues", "tick_line_asof", "tick_word",
    "listen_segments", "segments_stream", "scoreboard", "vote_tally", "debounce",
    "playlist_outcomes", "stft_filter",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__driver__memory="16g",
        spark__sql__shuffle__partitions=cpus,
        spark__songloom__inputPartitions=cpus,  # the files here are a split each
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
