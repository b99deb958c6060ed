from collections import defaultdict

from cases import no_docs, odd_docs, prose
from pyspark.sql import functions as F

from songloom.llm import mixing as m


def shares(node, budget, depth, levels, weights):
    """Budgets of the leaves by sharing out what is left again and again."""
    if not levels[depth:]:
        return {(): min(budget, node)}
    cap = lambda x: x if not isinstance(x, dict) else sum(map(cap, x.values()))
    total = cap(node)
    weight = {k: weights.get(levels[depth], {}).get(k, cap(v) / total if total else 0) for k, v in node.items()}
    given, open_, left = dict.fromkeys(node, 0.0), set(node), min(budget, total)
    while left > 1e-9 and open_:
        w = sum(weight[k] for k in open_)
        part = {k: min(cap(node[k]) - given[k], left * weight[k] / w) for k in open_}
        for k, x in part.items():
            given[k] += x
        left -= sum(part.values())
        open_ = {k for k in open_ if cap(node[k]) - given[k] > 1e-9}
    return {(k, *rest): b for k in node for rest, b in shares(node[k], given[k], depth + 1, levels, weights).items()}


def test_shortages_go_to_siblings_before_ancestors(spark):
    leaves = [("web", "en", "a", 1000), ("web", "en", "b", 10), ("web", "de", "c", 5), ("book", "en", "d", 300), ("book", "fr", "e", 40)]
    weights = {"domain": {"web": 0.5, "book": 0.5}, "lang": {"en": 0.4, "de": 0.6, "fr": 0.6}, "source": {"a": 1.0, "b": 1.0}}
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    tree = {"web": {"en": {"a": 2000, "b": 20}, "de": {"c": 10}}, "book": {"en": {"d": 600}, "fr": {"e": 80}}}
    for budget in (0, 50, 400, 1100, 2000, 9000):
        got = {(r["domain"], r["lang"], r["source"]): r["mix_budget"] for r in m.leaf_budgets(df, ["domain", "lang", "source"], weights, budget, 2).collect()}
        want = shares(tree, budget, 0, ["domain", "lang", "source"], weights)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got), budget
    # what German web text lacks goes to English web text, books get no more than their half
    got = {(r["domain"], r["lang"]): r["mix_budget"] for r in m.leaf_budgets(df, ["domain", "lang"], weights, 400, 2).collect()}
    assert abs(got["web", "de"] - 10) < 1e-6 and sum(v for k, v in got.items() if k[0] == "web") - 200 < 1e-6


def test_leaves_give_prefixes_of_seeded_epochs(spark):
    rows = [(i, prose(1 + i % 50, i), "en", "hot" if i % 3 else f"s{i % 4}", None) for i in range(9000)]
    docs = spark.createDataFrame(rows, odd_docs(spark, False).schema)
    got = m.mix(docs, ["source"], {"source": {"hot": 0.1, "s0": 0.8}}, share=0.6, max_epochs=3, seed=7)
    whole, part = defaultdict(set), defaultdict(list)
    for r in got.collect():
        whole[r["source"], r["mix_epoch"]].add(r["doc_id"])
        part[r["source"]].append(r)
    sizes = {i: len(t.split()) for i, t, *_ in rows}
    leaf = {i: s for i, _, _, s, _ in rows}
    for source, found in part.items():
        members = [i for i in leaf if leaf[i] == source]
        total, budget = sum(sizes[i] for i in members), found[0]["mix_budget"]
        last = max(r["mix_epoch"] for r in found)
        assert all(len(whole[source, e]) == len(members) for e in range(last))  # whole epochs first
        taken = sum(r["mix_tokens"] for r in found)
        assert taken <= budget + 1e-6 and (budget - taken < 50 or taken == 3 * total)
        ends = sorted((r["mix_before"], r["mix_tokens"]) for r in found if r["mix_epoch"] == last)
        assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))  # a prefix without gaps
    assert got.count() == m.mix(docs.repartition(5), ["source"], {"source": {"hot": 0.1, "s0": 0.8}}, share=0.6, max_epochs=3, seed=7).count()
    assert len(whole["hot", 0] ^ {r["doc_id"] for r in m.mix(docs, ["source"], {"source": {"hot": 0.1}}, share=0.3, seed=8).filter("source = 'hot'").collect()}) > 0


def test_odd_rows_and_empty_table(spark):
    docs = odd_docs(spark)
    drawn = m.mixture(docs, share=1.0)
    placed = docs.withColumn("domain", m.domain_of(F.col("source")))
    rows = m.drawn_rows(placed, drawn, ["domain", "lang", "source"])
    assert rows.columns == [*docs.columns, "domain"] and rows.count() > 0
    assert m.mixture(docs, share=0.0).filter("mix_tokens > 0").count() == 0
    assert m.mixture(no_docs(spark)).collect() == []
