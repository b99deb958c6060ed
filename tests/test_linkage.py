import random

import pytest
from pyspark.sql import functions as F

from songloom.functions import text as tx
from songloom.operators import linkage as lk

WANTS = "want_id int, artist string, track string, duration double"
ROWS = ("row_ord long, artistName string, trackName string, albumName string, duration double, "
        "syncedLyrics string, plainLyrics string")
LRC = "[00:01.00] la"


def wants_df(spark, rows):
    return spark.createDataFrame(rows, WANTS)


def rows_df(spark, rows):
    return spark.createDataFrame(rows, ROWS)


@pytest.mark.parametrize("row, want, expected", [
    (("Adele", "Hello", 295.0), ("Adele", "Hello", 296.0), True),
    (("Lionel Richie", "Hello", 0.0), ("Adele", "Hello", 0.0), False),
    (("Lionel Richie", "Hello", 245.0), ("Adele", "Hello", 296.0), False),
    (("Various Artists", "Hello", 295.0), ("Adele", "Hello", 296.0), True),
    (("Lionel Richie", "Hello", 0.0), ("", "Hello", 0.0), True),
    (("BTS (방탄소년단)", "Dynamite", 0.0), ("BTS", "Dynamite", 0.0), True),
    (("Adele", "Hello (Remastered)", 0.0), ("Adele", "Hello", 0.0), True),
    (("Adele", "Helo", 0.0), ("Adele", "Hello", 0.0), True),
    (("Someone Else", "abXdeXghXj", 296.0), ("Adele", "abcdefghij", 296.0), True),
])
def test_accept(spark, row, want, expected):
    rows = lk.catalog_signatures(rows_df(spark, [(1, row[0], row[1], None, row[2], LRC, None)]))
    wants = lk.signatures(lk.wanted(wants_df(spark, [(1, *want)])))
    assert wants.crossJoin(rows).select(lk.accepted().alias("r")).first()["r"] is expected
    assert (lk.fuzzy_link(wants, rows).count() == 1) is expected


def noisy_tables(spark, seed):
    rng = random.Random(seed)
    syllables = ["la", "mo", "ri", "te", "ka", "x", "un"]

    def name(n):
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, n)))

    def edit(s):
        for _ in range(rng.randint(0, 5)):
            i = rng.randint(0, len(s))
            s = rng.choice([s[:i] + rng.choice("abz ") + s[i:], s[:i] + s[i + 1:], s[:i] + "q" + s[i + 1:]])
        return s

    rows = [(i, name(4), name(8), None, float(rng.choice([0, 60, 62, 65, 70, 90])),
             rng.choice([LRC, None]), rng.choice(["text", None])) for i in range(150)]
    wants = [(i, edit(rng.choice(rows)[1]) if rng.random() < .8 else "", edit(rng.choice(rows)[2]),
              float(rng.choice([0, 60, 63, 66, 88]))) for i in range(120)]
    return wants_df(spark, wants), rows_df(spark, rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_blocked_join_equals_brute_force(spark, seed):
    wants, catalog = noisy_tables(spark, seed)
    w = lk.signatures(lk.wanted(wants)).cache()
    r = lk.catalog_signatures(catalog).cache()
    brute = w.crossJoin(r).filter(lk.accepted()).select(*lk.WANT, "row_ord")
    blocked = lk.fuzzy_link(w, r).select(*lk.WANT, "row_ord")
    expected = {tuple(x) for x in brute.collect()}
    got = [tuple(x) for x in blocked.collect()]
    assert len(got) == len(set(got)) and set(got) == expected and len(expected) > 100


def test_accepted_pairs_are_distinct_without_a_sort(spark, capsys):
    wants, catalog = noisy_tables(spark, 3)
    pairs = lk.fuzzy_link(lk.signatures(lk.wanted(wants)), lk.catalog_signatures(catalog))
    assert pairs.count() == pairs.select(*lk.WANT, "row_ord").distinct().count() > 100
    pairs.explain()
    plan = capsys.readouterr().out
    assert "Union" in plan.split("\n")[2] and "SortAggregate" not in plan


@pytest.mark.parametrize("percent, least", [(15, 2), (20, 2), (30, 3), (35, 4)])
def test_similar_strings_of_all_lengths(spark, percent, least):
    """Strings of 1 to 120 letters with edits around the tolerance, against all pairs."""
    rng = random.Random(percent)
    rows = ["".join(rng.choice("abcd ") for _ in range(n)) for n in [*range(1, 12), *range(14, 121, 9)]]

    def edited(s):
        for _ in range(int(max(least, len(s) * percent / 100) * rng.choice([0.5, 0.9, 1, 1.1, 1.3]))):
            i = rng.randint(0, len(s))
            s = rng.choice([s[:i] + rng.choice("abcd") + s[i:], s[:i] + s[i + 1 :], s[:i] + "e" + s[i + 1 :]])
        return s

    wants = [edited(s) for s in rows for _ in range(4)] + rows[::3]
    left, right = (spark.createDataFrame([(x,) for x in xs], f"{c} string") for xs, c in ((wants, "a"), (rows, "b")))
    near = tx.within(F.col("a"), F.col("b"), tx.tolerance(F.col("a"), F.col("b"), percent, least))
    want = {tuple(r) for r in left.crossJoin(right).filter("a <> ''").filter(near).collect()}
    got = [tuple(r) for r in lk.similar_strings(left, right, "a", "b", percent, least).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > len(rows)


@pytest.mark.parametrize("percent, least", [(30, 3), (35, 4)])
def test_pieces_of_long_titles_are_few(spark, percent, least):
    title = "".join(random.Random(1).choice("abcdefghij ") for _ in range(100))
    df = spark.createDataFrame([(1, title, 0)], "id long, s string, block int")
    assert lk.long_pieces(df, percent, least).count() + lk.short_pieces(df, percent, least).count() < 1000


def test_pick_best_keeps_the_synced_copy_and_ties_in_order(spark):
    catalog = rows_df(spark, [
        (1, "Adele", "Hello", None, 295.0, None, "plain"),
        (2, "ADELE", "hello", None, 295.0, LRC, None),
        (3, "Adele", "Hello!", None, 295.0, LRC, None),
        (4, "Adele", "Helo", None, 295.0, None, "plain"),
        (5, "Adele", "Hello", None, 295.0, None, None),
        (6, "Adel", "Hello", None, 900.0, LRC, None),
    ])
    wants = lk.signatures(lk.wanted(wants_df(spark, [(1, "Adele", "Hello", 295.0)])))
    pairs = lk.fuzzy_link(wants, lk.catalog_signatures(catalog))
    got = lk.pick_best(pairs).orderBy("position").collect()
    assert [(r["position"], r["row_ord"]) for r in got] == [(0, 2), (1, 3), (2, 4), (3, 6)]
    assert got[0]["score"] == -2 and abs(got[3]["score"] - 6.6) < 1e-9
    listed = lk.match_list(lk.pick_best(pairs)).first()["matches"]
    assert [m["row_ord"] for m in listed] == [2, 3, 4, 6]


def test_pairs_are_dealt_before_they_are_sorted(spark, capsys):
    wants, catalog = noisy_tables(spark, 3)
    pairs = lk.signatures(lk.wanted(wants)).crossJoin(lk.catalog_signatures(catalog))
    lk.pick_best(pairs).explain()
    plan = capsys.readouterr().out  # from the last step to the first
    dealt, joined = plan.index("REPARTITION_BY_NUM"), plan.index("BroadcastNestedLoopJoin") if "BroadcastNestedLoopJoin" in plan else plan.index("CartesianProduct")
    assert plan.rindex("WindowGroupLimit") < dealt < joined


def test_pick_without_alternatives_ranks_once(spark):
    """the same picks as position 0 of the full ranking, by one sort per want instead of two."""
    wants, catalog = noisy_tables(spark, 5)
    pairs = lk.signatures(lk.wanted(wants)).crossJoin(lk.catalog_signatures(catalog)).localCheckpoint()
    alone, full = lk.pick_best(pairs, alternatives=0), lk.pick_best(pairs).filter("position = 0")
    assert sorted(map(str, alone.collect())) == sorted(map(str, full.collect()))
    assert alone._jdf.queryExecution().optimizedPlan().toString().count("windowspecdefinition") == 1


def test_exact_links(spark):
    catalog = rows_df(spark, [
        (1, "Beyonce", "Halo", "I Am", 261.0, LRC, None),
        (2, "Beyonce", "Halo", "Live", 300.0, LRC, None),
        (3, "Other", "Halo", None, 261.0, LRC, None),
    ])
    wants = spark.createDataFrame(
        [(1, "Beyoncé", "Halo", 300.2, ""), (2, "Beyonce", "Halo", 300.2, ""),
         (3, "Beyonce", "Halo", 10.0, "live"), (4, "Nobody", "Halo", 1.0, "")],
        WANTS + ", album string")
    folded = {r["want_id"]: r["row_ord"] for r in lk.link_by_name(wants, catalog).collect()}
    assert folded == {1: 1, 2: 1, 3: 2, 4: None}
    parsed = {r["want_id"]: r["row_ord"] for r in lk.link_by_name(wants, catalog, "parsed").collect()}
    assert parsed == {1: None, 2: 2, 3: 2, 4: None}
    listens = spark.createDataFrame([("yt:a",), ("yt:b",)], "video_key string")
    links = spark.createDataFrame([("yt:a", 7), ("yt:a", 5)], "video_key string, row_ord long")
    hits = {r["video_key"]: (r["row_ord"], r["matchedBy"]) for r in lk.link_by_identity(listens, links).collect()}
    assert hits == {"yt:a": (5, "video-id"), "yt:b": (None, None)}


def test_token_searches_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)] + ["the"] * 6

    def phrase(n):
        return " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, n)))

    rows = [(i, phrase(2), phrase(4), None, 60.0, LRC, None) for i in range(80)]
    wants = [(i, rng.choice(["", phrase(2)]), phrase(3), 60.0) for i in range(60)]
    w, c = wants_df(spark, wants), rows_df(spark, rows)
    sig, cat = lk.signatures(lk.wanted(w)), lk.catalog_signatures(c)
    tokens = {(r["l_artist"], r["l_track"]): set((r["l_artist"] + " " + r["l_track"]).split()) for r in cat.collect()}
    got = {r["want_id"]: (r["row_ord"], r["score"]) for r in lk.search_all_terms(w, c).collect()}
    scored = sig.crossJoin(cat).withColumn("s", lk.score()).collect()
    for want_id, artist, track, _ in wants:
        need = set((track + " " + artist).split())
        hits = [(r["s"], r["row_ord"]) for r in scored if r["w_track"] == track and r["w_artist"] == artist
                and need <= tokens[r["l_artist"], r["l_track"]]]
        best = min(hits) if hits else (None, None)
        assert got[want_id] == (best[1], best[0]), (artist, track)
    broad = {(r["w_artist"], r["w_track"], r["row_ord"]) for r in lk.search_broad(w, c).collect()}
    expected = set()
    for r in sig.crossJoin(cat).filter(lk.accepted()).collect():
        need = set((r["w_track"] + " " + r["w_artist"]).split())
        if 2 * len(need & tokens[r["l_artist"], r["l_track"]]) >= len(need):
            expected.add((r["w_artist"], r["w_track"], r["row_ord"]))
    assert broad == expected and expected


def test_token_index_holds_wanted_words_only(spark, monkeypatch):
    """Words that no want asks for are left out before the index is shuffled and written."""
    indexed = []

    def watched(df):
        out = cut(df)
        if out.columns == ["row_ord", "t"]:
            indexed.extend(sorted(tuple(r) for r in out.collect()))
        return out

    cut = lk.cut
    monkeypatch.setattr(lk, "cut", watched)
    c = rows_df(spark, [(i, "", f"hello wörld number {i} of many", None, 0.0, LRC, None) for i in range(5)]
                + [(9, "", "Hello Wörld Number 3 of many", None, 0.0, LRC, None)])
    got = lk.search_all_terms(wants_df(spark, [(1, "", "world 3", 0.0), (2, "", "world absent", 0.0)]), c).collect()
    assert {r["want_id"]: r["row_ord"] for r in got} == {1: 3, 2: None}
    assert indexed == [(0, "world"), (1, "world"), (2, "world"), (3, "3"), (3, "world"), (4, "world")]


def broadcast_rows(plan):
    """Rows of each broadcast of a plan that has run."""
    kind = plan.getClass().getSimpleName()
    if kind == "BroadcastExchangeExec":
        yield plan.metrics().apply("numOutputRows").value()
    if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
        yield from broadcast_rows(plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan())
    for i in range(plan.children().size()):
        yield from broadcast_rows(plan.children().apply(i))


def test_token_search_broadcasts_no_index(spark, monkeypatch):
    """Five hundred titles of the same fifty words, of which forty wants ask for two each: index, hits
    and bounds are a few kilobytes of Parquet, but 20,000 rows each, and stay out of the driver."""
    sent = []

    def ran(df):
        rows = df.collect()
        sent.extend(broadcast_rows(df._jdf.queryExecution().executedPlan()))
        return rows

    cut = lk.cut
    monkeypatch.setattr(lk, "cut", lambda df: ran(df) and cut(df))
    monkeypatch.setattr(lk, "BROADCAST_ROWS", 500, raising=False)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    c = rows_df(spark, [(i, "", " ".join(rng.sample(words, 50) + ["x" * rng.randint(1, 9), f"n{i}"]), None, 0.0, LRC, None)
                        for i in range(500)])
    w = wants_df(spark, [(i, "", f"{words[i]} {words[i + 9]}", 0.0) for i in range(40)])
    got = {r["want_id"]: (r["score"], r["row_ord"]) for r in ran(lk.search_all_terms(w, c))}
    scored = lk.signatures(lk.wanted(w), "want_id").crossJoin(lk.catalog_signatures(c)).withColumn("s", lk.score())
    assert got == {r["want_id"]: tuple(r["b"]) for r in scored.groupBy("want_id").agg(F.min(F.struct("s", "row_ord")).alias("b")).collect()}
    assert 0 < max(sent) <= 500, sent


def test_broad_search_looks_at_words_once_per_pair_of_names(spark, monkeypatch):
    """Forty lengths of a want and fifty of three rows are three pairs of names, with all lengths found."""
    met = []

    def watched(*args):
        bags, hits = token_hits(*args)
        met.append(hits.count())
        return bags, hits

    token_hits = lk._token_hits
    monkeypatch.setattr(lk, "_token_hits", watched)
    w = wants_df(spark, [(i, "Adele Band", "Hello xo", 0.5 * i) for i in range(40)])
    names = [("Adele Band", "Hello"), ("Other", "Hello xo"), ("Adele Who", "Hollo no xo")]
    c = rows_df(spark, [(3 * i + j, *names[j], None, 0.5 * i, LRC, None) for i in range(50) for j in range(3)])
    columns = [*lk.WANT, *lk.ROW, "l_artist", "l_track", "row_ord"]
    got = [tuple(r) for r in lk.search_broad(w, c).select(columns).collect()]
    pairs = lk.signatures(lk.wanted(w)).crossJoin(lk.catalog_signatures(c)).filter(lk.accepted())
    assert len(got) == len(set(got)) and set(got) == {tuple(r) for r in pairs.select(columns).collect()}
    assert {r[-2] for r in got} == {"hello", "hello xo", "hollo no xo"} and met == [3]


def test_artist_confirmed_hits(spark):
    catalog = rows_df(spark, [(1, "Lionel Richie", "Hello", None, 0.0, None, "x"),
                              (2, "Adele", "Helo", None, 0.0, None, "x")])
    wants = lk.signatures(lk.wanted(wants_df(spark, [(1, "Adele", "Hello", 0.0), (2, "", "Hello", 0.0),
                                                     (3, "Muse", "Hello", 0.0)])))
    hits = wants.crossJoin(lk.catalog_signatures(catalog))
    got = {r["w_artist"]: r["row_ord"] for r in lk.artist_confirmed_hits(hits).collect()}
    assert got == {"adele": 2, "": 1}


def test_priority_resolve(spark):
    rows = [
        ("a", 0, True, False, "name", 1.0), ("a", 1, True, True, "name", 9.0), ("a", 2, True, True, "name", 0.0),
        ("b", 0, True, False, "name", 8.0), ("b", 1, True, False, "name", 3.0), ("b", 2, False, False, None, None),
        ("c", 0, True, True, "name", 0.0), ("c", 1, True, True, "video-id", -10.0),
        ("d", 0, False, False, None, None),
    ]
    df = spark.createDataFrame(rows, "song string, prio int, found boolean, synced boolean, matchedBy string, score double")
    got = {r["song"]: r["prio"] for r in lk.priority_resolve(df, "song").collect()}
    assert got == {"a": 1, "b": 1, "c": 1}


def test_waterfall_and_fallback(spark):
    wants = spark.createDataFrame([(i,) for i in range(6)], "want_id int")
    seen = []

    def stage(limit):
        def find(df):
            seen.append(df.count())
            return df.filter(F.col("want_id") < limit)
        return find

    out = lk.waterfall_link(wants, [("x", stage(2)), ("y", stage(4)), ("z", stage(5))], "want_id")
    assert {r["want_id"]: r["source"] for r in out.collect()} == {0: "x", 1: "x", 2: "y", 3: "y", 4: "z"}
    assert seen == [6, 4, 2]
    c = "array<struct<artist:string,track:string>>"
    df = spark.createDataFrame([([("A, B", "t"), ("A", "u")],), ([("A & B", "t"), ("", "u")],), ([("A & B", "t")],)], f"c {c}")
    got = [r[0]["track"] for r in df.select(lk.fallback_candidate(F.col("c"))).collect()]
    assert got == ["u", "u", "t"]
