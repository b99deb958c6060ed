import hashlib
import random
import re
from zlib import crc32

import numpy as np
from cases import DOCS, no_docs, odd_docs

from songloom.llm import periods as p
from songloom.llm import queries as q


def all_runs(words, least=12):
    """Every lag, every position: maximal stretches of equal words, smallest period of each."""
    found = {}
    for lag in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - lag:
            j = i
            while j < len(words) - lag and words[j] == words[j + lag]:
                j += 1
            if j > i and j - i + lag >= max(least, 2 * lag):
                found.setdefault((i, j - i + lag), lag)
            i = max(j, i + 1)
    return sorted((s, n, lag) for (s, n), lag in found.items())


def test_runs_equal_brute_force():
    r = random.Random(3)
    for _ in range(1500):
        n, k = r.randrange(0, 100), r.choice([1, 2, 3, 4, 8, 20, 60])
        words = [str(r.randrange(k)) for _ in range(n)]
        if n > 5 and r.random() < 0.6:
            a, period = r.randrange(n), r.randrange(1, max(2, n // 3))
            words = words[:a] + [words[a + (i - a) % period] for i in range(a, n)]
        assert p.runs_of(words) == all_runs(words)


def test_chunks_of_lags_do_not_matter():
    r = random.Random(4)
    words = np.array([r.randrange(2) for _ in range(400)])
    assert p.scan_lags(words, chunk=7) == p.scan_lags(words) == all_runs(words.tolist())


def test_surviving_segments_are_stable_and_hold_all_runs():
    r = random.Random(5)
    for _ in range(300):
        words = [r.choice([r.randrange(4), r.randrange(300)]) for _ in range(r.randrange(200))]
        kept = p.surviving(np.array(words, dtype=np.int64))
        for a, b in kept:
            assert b - a >= 12 and all(words[a:b].count(w) > 1 for w in words[a:b])
        for start, length, _ in all_runs(words):
            assert any(a <= start and start + length <= b for a, b in kept)


def test_a_braid_is_cut_word_by_word():
    words = [x for i in range(5000) for x in (i + 1, i)]  # every cut makes one more word rare
    assert p.surviving(np.array(words)) == []


def test_dropped_words():
    words = "x a b a b a b a b a b a b y".split()
    runs = p.runs_of(words)
    assert runs == [(1, 12, 2)]
    assert p.without_repeats(words, runs) == ["x", "a", "b", "y"]
    assert p.runs_of("a b a b a b a b a b a".split()) == []  # eleven words


def as_worded(doc_id, text):
    """The contract of the query, step by step."""
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        period = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % period] for i, w in enumerate(words)]
    runs = all_runs(words)
    dropped = {i for s, length, lag in runs for i in range(s + lag, s + length)}
    best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{length},{lag}\n" for s, length, lag in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_query_equals_the_contract(spark, data_dir):
    got = sorted(map(tuple, q.QUERIES["op13_periodic_runs"](spark, data_dir).collect()))
    table = spark.read.parquet(f"{data_dir}/documents.parquet").collect()
    want = sorted(as_worded(r["doc_id"], r["text"]) for r in table if len(r["text"] or "") < 20_000)
    long = {r["doc_id"] for r in table if len(r["text"] or "") >= 20_000}
    assert [x for x in got if x[0] not in long] == want
    assert sum(x[1] > 0 for x in got) > len(got) / 20


def test_odd_rows_and_empty_table(spark):
    rows = p.periodic_runs(odd_docs(spark)).collect()
    assert len(rows) == 13 and sum(r["doc_id"] is None for r in rows) == 2
    assert {r["doc_id"]: r["collapsed"] for r in rows if r["doc_id"] in (3, 4, 5, 6)} == {3: "", 4: "", 5: "", 6: "one"}
    assert p.periodic_runs(no_docs(spark)).collect() == []
    loop = spark.createDataFrame([(10, "one two three " * 100_000, None, None, None)] * 2, DOCS)
    found = p.periodic_runs(loop).collect()
    assert [(r["runs"][0]["length"], r["runs"][0]["period"], r["collapsed"]) for r in found] == [(300_000, 3, "one two three")] * 2
