"""Mixing sources to target weights: a token budget handed down a tree, filled from seeded epochs.

The tree has one level per column of ``levels`` (domain, language, source). The budget of a
node is shared among its children by their weights, but no child gets more than its subtree
holds in ``max_epochs`` passes; what a child cannot take goes to its siblings, again by weight,
and only what all of them cannot take was never given to their parent. This is a filling to a
common level: ``min(capacity, level * weight)``, the level being found from running sums over
the siblings in the order in which they run full.

A leaf takes whole epochs while they fit. Each epoch has an order of its own, by a seeded hash,
and the last one is cut: the prefix of that order whose tokens do not exceed what is left.
Running sums of a leaf are made in stretches of the hash, so that a leaf that holds most rows
is many small windows: one sum per stretch, then sums within stretches.

Null level values are a child of their own; null texts have no token and cost nothing; nodes
without a weight get ``default_weight``; rows that repeat are drawn each; an empty table, or a
budget of 0, gives no rows. Columns of the input are kept, those added start with ``mix_``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.llm.tables import saved

#: Rows in a stretch of a leaf's order, on average.
STRETCH = 2048


def n_words(text: Column | str) -> Column:
    """Tokens of a text where no tokenizer is at hand: runs without white space."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def filled(children: DataFrame, parents: list[str]) -> DataFrame:
    """``children`` (budget, weight, capacity, under ``parents``) with ``given``.

    The children that run full do so in the order of capacity / weight. With the first k full,
    the level of the others is (budget - their capacity) / (weight of the rest); the right k is
    the first at which the next child does not run full.
    """
    group = ", ".join(f"`{p}`" for p in parents) or "1"
    order = f"over (partition by {group} order by _full, mix_node rows between unbounded preceding and 1 preceding)"
    ranked = children.withColumn("_full", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf"))))
    ranked = ranked.withColumns({
        "_taken": F.expr(f"coalesce(sum(capacity) {order}, 0)"),
        "_past": F.expr(f"coalesce(sum(weight) {order}, 0)"),
        "_all": F.expr(f"sum(weight) over (partition by {group})"),
    })
    rest = F.col("_all") - F.col("_past")
    level = F.when(rest > 0, F.greatest(F.col("budget") - F.col("_taken"), F.lit(0.0)) / rest)
    ranked = ranked.withColumn("_level", F.when(level <= F.col("_full"), level))
    # valid levels fall from the first child that does not run full onwards; null if all run full
    ranked = ranked.withColumn("_level", F.expr(f"max(_level) over (partition by {group})"))
    given = F.when(F.col("weight") <= 0, 0.0).otherwise(F.least("capacity", F.coalesce(F.col("_level") * F.col("weight"), "capacity")))
    return ranked.withColumn("given", given.cast("double")).drop("_full", "_taken", "_past", "_all", "_level")


def leaf_budgets(
    leaves: DataFrame, levels: list[str], weights: Mapping[str, Mapping[str, float]], budget: float,
    max_epochs: int,
) -> DataFrame:
    """``leaves`` (levels, tokens) with ``mix_budget``: the tokens each leaf is to give.

    ``weights[level]`` maps a level's values to relative weights among siblings; the children of
    a level without weights, and values not named, count by their tokens in relation to siblings.
    """
    tree = leaves.withColumns({"_capacity": (F.col("tokens") * max_epochs).cast("double"), "given": F.lit(float(budget))})
    for depth, level in enumerate(levels):
        parents = levels[:depth]
        children = tree.groupBy(*levels[: depth + 1]).agg(F.sum("_capacity").alias("capacity"), F.first("given").alias("budget"))
        # by tokens: the share of the siblings' capacity
        siblings = ", ".join(f"`{p}`" for p in parents) or "1"
        weight = F.expr(f"if(capacity > 0, capacity / sum(capacity) over (partition by {siblings}), 0D)")
        for value, w in weights.get(level, {}).items():
            weight = F.when(F.col(level) == value, float(w)).otherwise(weight)
        children = children.withColumns({"weight": weight, "mix_node": F.coalesce(F.col(level).cast("string"), F.lit(""))})
        shares = filled(children, parents).select(*[F.col(c).alias(f"_{c}") for c in levels[: depth + 1]], F.col("given").alias("_given"))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in levels[: depth + 1]]
        tree = tree.drop("given").join(shares, same).drop(*[f"_{c}" for c in levels[: depth + 1]]).withColumnRenamed("_given", "given")
    return tree.drop("_capacity").withColumnRenamed("given", "mix_budget")


def mix(
    docs: DataFrame, levels: list[str], weights: Mapping[str, Mapping[str, float]], budget: float | None = None,
    share: float = 0.5, max_epochs: int = 4, seed: int = 0, key: str = "doc_id", tokens: Column | None = None,
) -> DataFrame:
    """The drawn rows of ``docs``, one per epoch that a row is in, with
    ``mix_tokens``, ``mix_epoch``, ``mix_budget`` (of the leaf), ``mix_before`` (tokens of the
    epoch's order before the row).

    Without a ``budget`` it is ``share`` of all tokens.
    """
    cost = tokens if tokens is not None else n_words(F.col("text"))
    slim = docs.select(key, *levels, F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("mix_text"), cost.alias("mix_tokens"))
    slim = saved(slim.groupBy(key, *levels, "mix_text").agg(F.sum("mix_tokens").alias("mix_tokens")), "mix-rows")
    leaves = slim.groupBy(*levels).agg(F.sum("mix_tokens").alias("tokens"), F.count("*").alias("rows"))
    if budget is None:
        budget = share * (leaves.agg(F.sum("tokens")).first()[0] or 0)
    plan = leaf_budgets(leaves, levels, weights, budget, max_epochs)
    left = F.col("mix_budget") - F.col("_whole") * F.col("tokens")
    plan = plan.withColumn("_whole", F.floor(F.when(F.col("tokens") > 0, F.col("mix_budget") / F.col("tokens")).otherwise(0)))
    plan = plan.withColumns({"_left": F.floor(left + 1e-6), "_parts": F.ceil(F.col("rows") / STRETCH)})
    plan = saved(plan.withColumn("mix_leaf", F.xxhash64(*levels, *[F.col(c).isNull() for c in levels])), "mix-plan")
    leaf = F.xxhash64(*levels, *[F.col(c).isNull() for c in levels])
    rows = slim.withColumn("mix_leaf", leaf).join(
        plan.select("mix_leaf", "mix_budget", "_whole", "_left", "_parts"), "mix_leaf"
    )
    # the order of the epoch that is cut: a hash of row and epoch, its upper part names a stretch
    at = F.pmod(F.xxhash64(F.lit(seed), "_whole", key, "mix_text"), F.lit(1 << 40))
    rows = rows.withColumn("_at", at).withColumn("_part", F.floor(F.col("_at") * F.col("_parts") / (1 << 40)))
    sums = rows.groupBy("mix_leaf", "_part").agg(F.sum("mix_tokens").alias("_n"))
    sums = sums.withColumn("_start", F.expr("coalesce(sum(_n) over (partition by mix_leaf order by _part rows between unbounded preceding and 1 preceding), 0)"))
    rows = rows.join(sums.drop("_n"), ["mix_leaf", "_part"])
    within = f"over (partition by mix_leaf, _part order by _at, `{key}`, mix_text rows between unbounded preceding and 1 preceding)"
    rows = rows.withColumn("mix_before", F.col("_start") + F.expr(f"coalesce(sum(mix_tokens) {within}, 0)"))
    last = F.col("mix_before") + F.col("mix_tokens") <= F.col("_left")
    times = F.col("_whole") + F.when(last & (F.col("_left") > 0), 1).otherwise(0)
    drawn = rows.withColumn("_times", times.cast("int")).filter("_times > 0")
    return drawn.select(
        key, *levels, "mix_text", "mix_tokens", "mix_budget", "mix_before", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)).alias("mix_epoch")
    )


def drawn_rows(docs: DataFrame, drawn: DataFrame, levels: list[str], key: str = "doc_id") -> DataFrame:
    """Whole rows of ``docs`` for rows of :func:`mix`, once per epoch."""
    names = [key, *levels]
    slim = drawn.select(*[F.col(c).alias(f"mix_{c}") for c in names], "mix_text")
    text = F.md5(F.coalesce(docs["text"], F.lit("")))
    same = [docs[c].eqNullSafe(slim[f"mix_{c}"]) for c in names] + [text == slim["mix_text"]]
    return docs.join(slim, same).select(*[docs[c] for c in docs.columns])


#: Weights of the registered mixture: three invented domains of sources, languages within each.
DOMAINS = {"web": 0.5, "books": 0.3, "forum": 0.2}
LANGUAGES = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}


def domain_of(source: Column) -> Column:
    """The domain of a source: the sources are dealt to the domains by the hash of their name."""
    names = F.array(*[F.lit(d) for d in DOMAINS])
    return F.get(names, F.pmod(F.crc32(F.coalesce(source, F.lit(""))), F.lit(len(DOMAINS))).cast("int"))


def mixture(docs: DataFrame, share: float = 0.5, max_epochs: int = 4, seed: int = 0) -> DataFrame:
    """The registered mixture over domain, language and source."""
    placed = docs.withColumn("domain", domain_of(F.col("source")))
    return mix(placed, ["domain", "lang", "source"], {"domain": DOMAINS, "lang": LANGUAGES}, share=share, max_epochs=max_epochs, seed=seed)
