import base64
import gzip
import hashlib

from songloom.llm import warc
from songloom.llm.tables import fresh_path

PAGES = "page_id long, url string, html string, key string, offset string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "x") for i, u, h in rows], PAGES)


ROWS = [
    (1, "http://a/", "<p>é</p>"), (2, "http://b/", "same"), (3, None, "same"), (4, "http://c/\r\nx", ""), (5, "http://d/", None),
    (6, "http://e/", "y\r\n\r\nWARC/1.1\r\n" * 3), (7, "http://f/", "z" * 300_000), (None, "http://g/", "same"),
    (8, "http://h/", "u"), (8, "http://h/", "u"),
]


def test_round_trip_digests_and_revisits(spark):
    got = warc.round_trip(pages(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    assert {(r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got} == {
        (i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for i, _, h in ROWS
    }
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got}
    assert kinds[3] == kinds[None] == ("revisit", 2) and kinds[5] == ("revisit", 4)
    assert all(kinds[i] == ("response", None) for i in (1, 2, 4, 6, 7, 8))
    payloads = {r["page_id"]: bytes(r["payload"]).decode() for r in got}
    assert payloads[6] == ROWS[5][2] and payloads[7] == ROWS[6][2] and payloads[3] == ""


def test_archives_are_members_of_gzip_and_roll_over(spark):
    folder = fresh_path(spark, "warc-test")
    index = warc.write_archives(pages(spark, [(i, "u", "text %d" % i) for i in range(40)]).coalesce(1), folder, 2000).collect()
    assert len({r["archive"] for r in index}) > 1
    for r in index:
        with open(r["archive"], "rb") as f:
            f.seek(r["offset"])
            assert gzip.decompress(f.read(r["length"])).endswith(b"text %d\r\n\r\n" % r["page_id"])


def test_runs_join_near_ranges_and_select(spark):
    folder = fresh_path(spark, "warc-test")
    index = warc.write_archives(pages(spark, [(i, "u", str(i) * 500) for i in range(60)]).coalesce(1), folder)
    chosen = index.filter("page_id % 3 = 0")
    assert warc.coalesced_runs(chosen, gap=10_000).count() == 1
    assert warc.coalesced_runs(chosen, gap=0).count() == 20
    assert warc.coalesced_runs(index, gap=0, run=3000).count() > 1
    assert sorted(r["page_id"] for r in warc.read_records(chosen, gap=0).collect()) == list(range(0, 60, 3))


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, [])).collect() == []
