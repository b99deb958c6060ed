"""Operators against a replay of the rule, row by row, on random logs; batch equals stream."""

import random
from datetime import timedelta

import pytest

from songloom.operators import feedback as fb
from songloom.operators import linkage as lk
from songloom.operators import usage as us
from songloom.streaming import machines as m

from test_linkage import LRC, rows_df, wants_df
from test_usage import T0

SECOND = 1_000_000


def replay(machine, rows, key):
    """What a machine says about rows in time order, per key."""
    states, out = {}, []
    for row in sorted(rows, key=lambda r: (r["ts"], r["ord"])):
        out += [(row["ord"], said) for said in machine.step(states.setdefault(row[key], {}), row)]
    return out


def log(seed, n=300, **columns):
    rng = random.Random(seed)
    seconds = sorted(rng.choice(range(0, 40 * 86_400, 1800)) for _ in range(n))
    return [{"k": rng.choice("ab"), "ts": s * SECOND, "ord": i, **{c: f(rng) for c, f in columns.items()}} for i, s in enumerate(seconds)]


def frame(spark, rows, schema):
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(T0 + timedelta(microseconds=r[c]) if c == "ts" else r[c] for c in names) for r in rows], schema)


@pytest.mark.parametrize("seed", [1, 2])
def test_queue_depth_is_a_replayed_queue(spark, seed):
    rows = log(seed, kind=lambda r: r.choices(["add", "next", "other", "end"], [10, 12, 3, 0.1])[0], song=lambda r: "s")
    want = {o: said[1] for o, said in replay(m.QueueMachine(), rows, "k")}
    df = frame(spark, rows, "k string, ts timestamp, ord long, kind string")
    got = {r["ord"]: r["depth"] for r in us.queue_depth(df, "k", slice_seconds=7200).collect()}
    assert got == want and 0 in got.values()


@pytest.mark.parametrize("seed", [1, 2])
def test_unrequested_is_a_replay_of_outcomes(spark, seed):
    kinds = [None, None, None, "queued", "rate_limited", "upstream", "recently_failed"]
    rows = log(seed, reason=lambda r: r.choice(kinds))
    # an outcome of the same instant comes before the request
    rows = sorted(rows, key=lambda r: (r["ts"], r["reason"] is None, r["ord"]))
    rows = [r | {"ord": i} for i, r in enumerate(rows)]
    want = {o for o, _ in replay(m.OutcomeMachine(), rows, "k")}
    df = frame(spark, rows, "k string, ts timestamp, ord long, reason string")
    asked = df.filter("reason is null").drop("reason")
    told = df.filter("reason is not null")
    assert {r["ord"] for r in fb.unrequested(asked, told, "k", slice_seconds=3 * 86_400).collect()} == want
    assert 0 < len(want) < asked.count()


@pytest.mark.parametrize("seed", [1, 2])
def test_drop_stale_is_a_replay_of_generations(spark, seed):
    rows = log(seed, generation=lambda r: r.randint(0, 9), value=lambda r: "v")
    want = {o for o, _ in replay(m.GenerationMachine(), rows, "k")}
    df = frame(spark, rows, "k string, ts timestamp, ord long, generation int")
    assert {r["ord"] for r in us.drop_stale(df, "k", slice_seconds=86_400).collect()} == want


def test_named_wants_with_an_empty_key_do_not_match_by_title_alone(spark):
    rows = lk.catalog_signatures(rows_df(spark, [(1, "Adele", "Hello", None, 295.0, LRC, None), (2, "!!!", "Hello", None, 200.0, LRC, None)]))
    wants = [(1, "!!!", "Hello", 0.0), (2, "Live", "Hello", 0.0), (3, "", "Hello", 0.0), (4, "!!!", "Hello", 296.0)]
    sig = lk.signatures(lk.wanted(wants_df(spark, wants)))
    assert sig.count() == 3  # "!!!" and "Live" without length ask the same, the nameless want does not
    got = {(r["w_named"], r["w_duration"], r["row_ord"]) for r in lk.fuzzy_link(sig, rows).collect()}
    assert got == {(False, 0.0, 1), (False, 0.0, 2), (True, 296.0, 1)}
    scores = {(r["w_named"], r["row_ord"]): r["s"] for r in lk.fuzzy_link(sig, rows).withColumn("s", lk.score()).collect()}
    assert scores[(True, 1)] == pytest.approx(0.6 * 5 - 2) and scores[(False, 1)] == pytest.approx(0.6 * 5 - 2)
