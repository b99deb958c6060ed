import random

import pytest
from pyspark.sql import functions as F

from songloom.operators import playlists as pl

LOG = "user string, seq long, action string, list_id string, name string, video_key string, title string, url string"


def spec(log, max_lists, max_items):
    """Plain in-memory meaning of a log, for one user."""
    lists, out, default = {}, {}, None
    for _, seq, action, lid, name, key, title, url in log:
        ok, why = lid in lists, "no_list"
        if action == "create":
            ok = len(lists) < max_lists
            if ok:
                lists[lid] = [name, {}]
                default = lid
        elif action == "rename" and ok:
            lists[lid][0] = name
        elif action == "delete" and ok:
            del lists[lid]
            default = None if default == lid else default
        elif action == "add" and ok:
            items = lists[lid][1]
            why = "full" if len(items) >= max_items else "duplicate" if key in items else "added"
            ok = why == "added"
            if ok:
                items[key] = (title, url)
        elif action == "remove" and ok:
            lists[lid][1].pop(key, None)
        elif action == "pick":
            default = lid
            continue
        if action in ("create", "rename", "delete"):
            why = "ok" if ok else "too_many" if action == "create" else "no_list"
        elif action == "remove" and ok:
            why = "removed"
        out[seq] = (ok, why)
    if default not in lists:
        default = next(iter(lists), None)
    return lists, out, default


def random_log(user, rng, n):
    log, made = [], []
    for seq in range(n):
        action = rng.choice(["create", "rename", "delete", "add", "add", "add", "add", "remove", "pick"])
        if action == "create" or not made:
            action = "create"
            made.append(f"{user}-{seq}")
            lid = made[-1]
        else:
            lid = rng.choice(made[-6:])
        log.append((user, seq, action, lid, f"n{seq}", f"k{rng.randint(0, 7)}", f"t{seq}", f"u{seq}"))
    return log


@pytest.mark.parametrize("caps", [(50, 500), (3, 4)])
def test_fold_equals_sequential_meaning(spark, monkeypatch, caps):
    monkeypatch.setattr(pl, "SEQ_SLICE", 16)
    rng = random.Random(11)
    logs = {u: random_log(u, rng, 140) for u in ("a", "b", "c")}
    log = spark.createDataFrame([r for l in logs.values() for r in l], LOG)
    lists, items, outcomes = pl.apply_mutations(log, *caps)
    got_out = {(r["user"], r["seq"]): (r["ok"], r["result"]) for r in outcomes.collect()}
    got_lists = {(r["user"], r["list_id"]): r["name"] for r in lists.collect()}
    got_items = {(r["user"], r["list_id"], r["video_key"]): (r["title"], r["url"]) for r in items.collect()}
    got_default = {r["user"]: r["active_id"] for r in pl.default_list(log, lists, outcomes).collect()}
    sizes = {(r["user"], r["list_id"]): r["size"] for r in pl.list_sizes(items, lists).collect()}
    for user, rows in logs.items():
        want, out, default = spec(rows, *caps)
        assert {s: v for (u, s), v in got_out.items() if u == user} == out
        assert {l: n for (u, l), n in got_lists.items() if u == user} == {l: v[0] for l, v in want.items()}
        assert {(l, k): v for (u, l, k), v in got_items.items() if u == user} == {
            (l, k): v for l, (_, its) in want.items() for k, v in its.items()}
        assert got_default[user] == default
        assert {l: n for (u, l), n in sizes.items() if u == user} == {l: len(v[1]) for l, v in want.items()}
    if caps == (3, 4):
        assert {"too_many", "full", "duplicate", "no_list"} <= {v for _, v in got_out.values()}
    nested = {r["user"]: r["lists"] for r in pl.nested_lists(lists, items).collect()}
    assert all(len(l["items"]) == sizes[u, l["id"]] for u, ls in nested.items() for l in ls)


def test_a_full_list_is_folded_by_few_rows(spark, monkeypatch):
    """Very many additions to one list; of them only those that can change it reach the fold."""
    seen, fold = [], pl._fold
    monkeypatch.setattr(pl, "_fold", lambda df, *more: seen.append(df.count()) or fold(df, *more))
    n = 300_000
    row = F.when(F.col("id") == 0, "create").when(F.col("id") % 60_000 == 59_999, "remove").otherwise("add")
    key = F.concat(F.lit("k"), F.when(F.col("id") % 60_000 == 59_999, F.floor(F.col("id") / 60_000) + 1).otherwise(F.col("id") % 5_000).cast("string"))
    log = spark.range(n).select(
        F.lit("u").alias("user"), F.col("id").alias("seq"), row.alias("action"), F.lit("L").alias("list_id"), F.lit("n").alias("name"),
        key.alias("video_key"), F.lit("t").alias("title"), F.lit("u").alias("url"),
    )
    _, items, outcomes = pl.apply_mutations(log, 50, 500)
    told = {(r["action"], r["result"]): r["count"] for r in outcomes.groupBy("action", "result").count().collect()}
    want = {}
    for action, (_, why) in zip(row_actions := [r["action"] for r in log.orderBy("seq").collect()], spec([tuple(r) for r in log.orderBy("seq").collect()], 50, 500)[1].values()):
        want[action, why] = want.get((action, why), 0) + 1
    assert told == want and items.count() == 499 and len(row_actions) == n
    assert max(seen) <= 6 * 501


def test_snapshot(spark):
    fresh = spark.createDataFrame([("a", 200, ["x"]), ("b", 401, None), ("c", 503, None)], "user string, status int, lists array<string>")
    snap = spark.createDataFrame([("a", ["old"]), ("b", ["old"])], "user string, lists array<string>")
    got = {r["user"]: (r["lists"], r["signedOut"], r["stale"]) for r in pl.snapshot_or_stale(fresh, snap).collect()}
    assert got == {"a": (["x"], False, False), "b": (["old"], True, False), "c": (None, False, True)}
