import random
import re

from cases import DOCS, no_docs, odd_docs, prose

from songloom.llm import winnowing as w

ITEMS = "item_id long, text string, key string"


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items):
    windows = []
    for item, text in items:
        ws = words(text)
        size = min(13, len(ws))
        windows += [(item, tuple(ws[i : i + size])) for i in range(len(ws) - size + 1)] if ws else []
    out = []
    for doc_id, text in docs:
        ws, hit, found = words(text), set(), set()
        for item, window in set(windows):
            for i in range(len(ws) - len(window) + 1):
                if tuple(ws[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found |= {str(item)} if item is not None else set()
        out.append((doc_id, len(ws), len(hit), tuple(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(ws)))
    return sorted(out, key=str)


def found(docs, items):
    rows = w.contamination(docs, items).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"]), r["contaminated"]) for r in rows), key=str)


def test_random_texts_over_few_words(spark):
    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choice("abc") for _ in range(n))
    items = [(i, text(rnd.choice([3, 5, 12, 13, 14, 30]))) for i in range(8)] + [(8, "a a a a a a a a a a a a a a")]
    docs = [(i, text(rnd.randint(0, 60))) for i in range(20)]
    docs += [(100 + i, text(7) + " " + t + " " + text(4)) for i, (_, t) in enumerate(items)] + [(200, "a " * 40)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], DOCS)
    assert found(df, spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)) == brute(docs, items)


def test_every_span_of_thirteen_is_found_wherever_it_lies(spark):
    item = prose(40, 9)
    ws = item.split()
    docs = [(i, prose(30, 100 + i) + " " + " ".join(ws[i : i + 13]).upper() + ". " + prose(20, 200 + i)) for i in range(28)]
    docs += [(50, " ".join(ws[3:15]))]  # twelve words are too few
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], DOCS)
    got = found(df, spark.createDataFrame([(1, item, "x"), (None, item, "x"), (2, "", "x"), (3, None, "x")], ITEMS))
    assert [r[2] for r in got if r[0] != 50] == [13] * 28 and [r[2] for r in got if r[0] == 50] == [0]


def test_odd_rows_and_empty_tables(spark):
    items = spark.createDataFrame([(1, prose(60, 1), "x"), (2, "one", "x"), (3, "ünïcode Ünïcode", "x")], ITEMS)
    docs = odd_docs(spark)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] != 7], [(r["item_id"], r["text"]) for r in items.collect()])
    assert [r for r in found(docs, items) if r[0] != 7] == want
    assert all(r[2] == 0 and not r[4] for r in found(docs, items.limit(0)))
    assert found(no_docs(spark), items) == []
    assert w.clean(docs, items).columns == docs.columns
