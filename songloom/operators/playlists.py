"""A log of playlist changes folded into current lists, items and outcomes.

Log columns: ``user, seq, action, list_id, name, video_key, title, url`` with actions
``create, rename, delete, add, remove`` and ``pick`` (explicit choice of the default).
``seq`` is unique per user and gives the order; ids of created lists are unique.

Most lists never reach a cap, and without caps every outcome follows from the row before
on the same key: that part is joins and slices. For users or lists that do reach a cap, the few
rows that can change something go through an ordered fold, which holds at most ``cap`` keys
(see :func:`capped`); the outcomes of all others follow from theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.records import NAME_MAX, TITLE_MAX
from ..functions.regex import text
from ..session import cut
from .ordered import neighbours

MAX_LISTS, MAX_ITEMS = 50, 500
SEQ_SLICE = 4096


def _slice() -> Column:
    return F.floor(F.col("seq") / SEQ_SLICE)


def bounded_fold(
    batches: Iterator[pd.DataFrame], group: list[str], key: str, cap: int, grow: str
) -> Iterator[pd.DataFrame]:
    """Ordered pass over sorted rows: a set of keys per group that never exceeds ``cap``.

    ``grow`` adds the key unless the set is full or holds it; other actions remove it.
    Adds ``effective`` and ``result``.
    """
    current, held = None, set()
    for pdf in batches:
        effective, result = [], []
        for row in zip(*(pdf[c] for c in group), pdf["action"], pdf[key]):
            *owner, action, item = row
            if owner != current:
                current, held = owner, set()
            if action == grow:
                why = "full" if len(held) >= cap else "duplicate" if item in held else "added"
                ok = why == "added"
                if ok:
                    held.add(item)
            else:
                ok, why = item in held, "removed"
                held.discard(item)
            effective.append(ok)
            result.append(why)
        yield pdf.assign(effective=effective, result=result)


def _fold(df: DataFrame, group: list[str], key: str, cap: int, grow: str) -> DataFrame:
    schema = df.schema.simpleString()[len("struct<") : -1]
    schema = f"{schema},effective:boolean,result:string"
    ordered = df.repartition(*group).sortWithinPartitions(*group, "seq")
    return ordered.mapInPandas(partial(bounded_fold, group=group, key=key, cap=cap, grow=grow), schema)


def capped(df: DataFrame, group: list[str], key: str, cap: int, grow: str) -> DataFrame:
    """``df`` with ``effective`` and ``result``: sets of at most ``cap`` keys per group.

    Only a removal of a key that an earlier row added can make room, so these cut a group into
    epochs. In an epoch the set never shrinks: after the first ``cap`` keys that it names, new or
    held, the set is full, and nothing after them changes it. So the fold reads, of any
    number of rows, the removals and up to ``cap`` rows per epoch; another addition names a
    key that the epoch has named, or comes when the set is full, which its size so far tells.
    """
    adds = F.col("action") == grow
    per_key = [*group, key]
    seen = neighbours(df, per_key, ["seq"], _slice(), previous={"_before": F.col("action")})
    # a null key is a key like any other
    frees = ~adds & F.coalesce(F.col("_before") == grow, F.lit(False))
    seen = seen.withColumn("_frees", frees)
    epochs = neighbours(seen, group, ["seq"], _slice(), total={"_epoch": F.col("_frees").cast("long")})
    known = neighbours(epochs, per_key, ["seq"], _slice(), previous={"_named": F.struct("_epoch", F.col("action").alias("a"))})
    again = (F.col("_named.a") == grow) & (F.col("_named._epoch") == F.col("_epoch"))
    known = cut(known.withColumn("_first", adds & ~F.coalesce(again, F.lit(False))).drop("_before", "_named"))
    rank = F.row_number().over(W.partitionBy(*group, "_epoch").orderBy("seq"))  # cut before the shuffle
    early = known.filter("_first").select(*per_key, "seq", "action", "_epoch").withColumn("_rank", rank)
    matter = early.filter(F.col("_rank") <= cap).drop("_rank", "_epoch").unionByName(
        known.filter("_frees").select(*per_key, "seq", "action")
    )
    folded = _fold(matter, group, key, cap, grow).select(*group, "seq", "effective", "result")
    told = known.join(cut(folded), [*group, "seq"], "left")
    step = F.when(F.col("effective"), F.when(adds, 1).otherwise(-1)).otherwise(0)
    left = neighbours(told, group, ["seq"], _slice(), total={"_size": step})
    otherwise = F.when(~adds, F.lit("removed")).when(F.col("_size") >= cap, "full").otherwise("duplicate")
    return left.select(
        *df.columns, F.coalesce("effective", F.lit(False)).alias("effective"), F.coalesce("result", otherwise).alias("result")
    )


def list_lives(log: DataFrame, max_lists: int = MAX_LISTS) -> DataFrame:
    """Accepted lists: ``[user, list_id, name, from_seq, to_seq]``, ``to_seq`` null if alive."""
    keys = ["user", "list_id"]
    events = log.filter(F.col("action").isin("create", "delete")).select(*keys, "seq", "action", "name")
    creates = events.filter("action = 'create'").select(*keys, "name", F.col("seq").alias("from_seq"))
    deletes = events.filter("action = 'delete'").select(*keys, F.col("seq").alias("d"))
    lives = (
        creates.join(deletes, keys, "left")
        .groupBy(*keys, "name", "from_seq")
        .agg(F.min(F.when(F.col("d") > F.col("from_seq"), F.col("d"))).alias("to_seq"))
    )
    lives = cut(lives)
    steps = lives.select("user", F.col("from_seq").alias("seq"), F.lit(1).alias("step")).union(
        lives.filter("to_seq is not null").select("user", "to_seq", F.lit(-1))
    )
    counted = neighbours(steps, ["user"], ["seq"], _slice(), total={"n": F.col("step")})
    over = counted.filter(F.col("n") > max_lists).select("user").distinct()
    free = lives.join(over, "user", "left_anti")
    crowded = events.join(over, "user", "left_semi").select("user", "seq", "action", "list_id", "name")
    kept = capped(crowded, ["user"], "list_id", max_lists, "create").filter("effective")
    accepted = kept.groupBy(*keys).agg(
        F.max(F.when(F.col("action") == "create", F.col("name"))).alias("name"),
        F.min(F.when(F.col("action") == "create", F.col("seq"))).alias("from_seq"),
        F.max(F.when(F.col("action") == "delete", F.col("seq"))).alias("to_seq"),
    )
    return free.unionByName(accepted)


def _item_steps(log: DataFrame, lives: DataFrame, max_items: int) -> DataFrame:
    """Item changes of live lists with ``effective`` and ``result``."""
    group = ["user", "list_id"]
    items = log.filter(F.col("action").isin("add", "remove")).join(
        lives.select(*group, "from_seq", "to_seq"), group
    )
    alive = (F.col("seq") > F.col("from_seq")) & (F.col("to_seq").isNull() | (F.col("seq") < F.col("to_seq")))
    items = items.filter(alive).drop("from_seq", "to_seq")
    seen = neighbours(items, [*group, "video_key"], ["seq"], _slice(), previous={"_before": F.col("action")})
    held = F.coalesce(F.col("_before") == "add", F.lit(False))
    adds = F.col("action") == "add"
    seen = seen.withColumn("effective", F.when(adds, ~held).otherwise(held)).drop("_before")
    step = F.when(F.col("effective"), F.when(adds, 1).otherwise(-1)).otherwise(0)
    counted = cut(neighbours(seen, group, ["seq"], _slice(), total={"n": step}))
    # An add met a full list if the list held ``cap`` before it.
    before = F.col("n") - F.when(F.col("effective"), 1).otherwise(0)
    over = counted.filter((F.col("action") == "add") & (before >= max_items)).select(*group).distinct()
    result = F.when(~adds, "removed").when(F.col("effective"), "added").otherwise("duplicate")
    free = counted.join(over, group, "left_anti").drop("n").withColumn("result", result)
    full = counted.join(over, group, "left_semi").select(*items.columns)
    return free.unionByName(capped(full, group, "video_key", max_items, "add"))


def apply_mutations(
    log: DataFrame, max_lists: int = MAX_LISTS, max_items: int = MAX_ITEMS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M1: current lists, current items, and one outcome per mutation.

    * lists ``[user, list_id, name, created_seq]``
    * items ``[user, list_id, video_key, title, url, added_seq]``
    * outcomes ``[user, seq, action, ok, result]``
    """
    group = ["user", "list_id"]
    lives = cut(list_lives(log, max_lists))
    steps = cut(_item_steps(log, lives, max_items))

    renames = log.filter("action = 'rename'").select(*group, "seq", F.col("name").alias("new_name"))
    latest = (
        lives.filter("to_seq is null")
        .join(renames, group, "left")
        .groupBy(*group, "name", "from_seq")
        .agg(F.max_by("new_name", F.when(F.col("seq") > F.col("from_seq"), F.col("seq"))).alias("new_name"))
    )
    name = F.left(F.coalesce(F.nullif(F.coalesce("new_name", "name"), F.lit("")), F.lit("Untitled")), F.lit(NAME_MAX))
    lists = latest.select(*group, name.alias("name"), F.col("from_seq").alias("created_seq"))

    final = (
        steps.filter("effective")
        .groupBy(*group, "video_key")
        .agg(F.max_by(F.struct("action", "title", "url", "seq"), "seq").alias("s"))
        .filter("s.action = 'add'")
    )
    items = final.join(lists.select(*group), group, "left_semi").select(
        *group,
        "video_key",
        F.left(text(F.col("s.title")), F.lit(TITLE_MAX)).alias("title"),
        text(F.col("s.url")).alias("url"),
        F.col("s.seq").alias("added_seq"),
    )

    span = lives.select(*group, "from_seq", "to_seq")
    alive = (
        F.col("from_seq").isNotNull()
        & (F.col("seq") > F.col("from_seq"))
        & (F.col("to_seq").isNull() | (F.col("seq") <= F.col("to_seq")))
    )
    structural = log.filter(F.col("action").isin("create", "rename", "delete")).join(span, group, "left")
    created = F.coalesce(F.col("seq") == F.col("from_seq"), F.lit(False))
    ok = F.when(F.col("action") == "create", created).otherwise(F.coalesce(alive, F.lit(False)))
    failed = F.when(F.col("action") == "create", "too_many").otherwise("no_list")
    structural = structural.select(
        "user", "seq", "action", ok.alias("ok"), F.when(ok, F.lit("ok")).otherwise(failed).alias("result")
    )
    known = steps.select(
        "user", "seq", F.when(F.col("action") == "add", F.col("effective")).otherwise(True).alias("ok"), "result"
    )
    changes = log.filter(F.col("action").isin("add", "remove")).select("user", "seq", "action")
    changes = changes.join(known, ["user", "seq"], "left").select(
        "user", "seq", "action", F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("result", F.lit("no_list")).alias("result")
    )
    return lists, items, structural.union(changes)


def active_list(lists: DataFrame, prefs: DataFrame) -> DataFrame:
    """Per user the preferred list if it exists, else the first, else null.

    ``lists`` hold ``[user, list_id, created_seq]``, ``prefs`` hold ``[user, list_id]``.
    """
    first = lists.groupBy("user").agg(F.min_by("list_id", "created_seq").alias("first_id"))
    valid = prefs.join(lists.select("user", "list_id"), ["user", "list_id"], "left_semi")
    valid = valid.select("user", F.col("list_id").alias("pref_id"))
    users = prefs.select("user").union(lists.select("user")).distinct()
    return users.join(valid, "user", "left").join(first, "user", "left").select(
        "user", F.coalesce("pref_id", "first_id").alias("active_id")
    )


def default_list(log: DataFrame, lists: DataFrame, outcomes: DataFrame) -> DataFrame:
    """M2: the default is the list last created or picked, while it exists.

    ``lists`` and ``outcomes`` come from :func:`apply_mutations`. Deleting the default
    clears it, which equals finding it gone.
    """
    good = outcomes.filter((F.col("action") == "create") & F.col("ok")).select("user", "seq")
    created = log.filter("action = 'create'").join(good, ["user", "seq"], "left_semi")
    picked = log.filter("action = 'pick'")
    sets = created.select("user", "seq", "list_id").union(picked.select("user", "seq", "list_id"))
    prefs = sets.groupBy("user").agg(F.max_by("list_id", "seq").alias("list_id"))
    return active_list(lists, prefs)


def list_sizes(items: DataFrame, lists: DataFrame) -> DataFrame:
    """Item count per list, zero for empty lists."""
    counts = items.groupBy("user", "list_id").agg(F.count(F.lit(1)).alias("size"))
    return lists.select("user", "list_id").join(counts, ["user", "list_id"], "left").fillna(0, ["size"])


def nested_lists(lists: DataFrame, items: DataFrame) -> DataFrame:
    """Current state as one row per user; the caps bound both arrays."""
    inner = items.groupBy("user", "list_id").agg(
        F.sort_array(F.collect_list(F.struct("added_seq", F.struct("video_key", "title", "url").alias("item")))).alias("i")
    )
    whole = lists.join(inner, ["user", "list_id"], "left")
    entry = F.struct(
        "created_seq",
        F.struct(
            F.col("list_id").alias("id"),
            "name",
            F.transform(F.coalesce("i", F.array()), lambda x: x["item"]).alias("items"),
        ).alias("list"),
    )
    return whole.groupBy("user").agg(
        F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["list"]).alias("lists")
    )


def snapshot_or_stale(fresh: DataFrame, snapshot: DataFrame, user: str = "user", value: str = "lists") -> DataFrame:
    """Fresh state where the answer is good, else the last snapshot with a flag.

    ``fresh`` holds ``[user, status, lists]``; 401 marks ``signedOut``, any other failure
    marks ``stale``. Changes sent while offline are refused, never queued.
    """
    good = F.col("status") == 200
    old = snapshot.select(user, F.col(value).alias("_old"))
    return fresh.join(old, user, "left").select(
        user,
        F.when(good, F.col(value)).otherwise(F.col("_old")).alias(value),
        (~good & (F.col("status") == 401)).alias("signedOut"),
        (~good & (F.col("status") != 401)).alias("stale"),
    )
