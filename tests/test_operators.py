"""Behaviour on hand-made rows, and invariants of the iterative operators."""

import math
import os
import random
import shutil
import subprocess
import sys

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegraph.functions import scores as S
from tidegraph.functions import text as T
from tidegraph.operators import accounts, cascade, chains, communities, compare, merge, metrics, nullmodel, posts, project, scoring, statistics
from tidegraph.operators.components import connected_components, contracted
from tidegraph.operators.iterate import cut, left_by, rows_in
from tidegraph.plans import io_queries
from tidegraph.sources import readers, writers


def test_nan_is_absent(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5), (3, None), (4, 1.0)], "id long, probability double")
    assert {r.id for r in posts.at_least(df).collect()} == {2, 4}
    assert {r.bin: r.n for r in statistics.histogram(df).collect()} == {0: 0, 1: 0, 2: 1, 3: 0, 4: 1}


def test_html_is_decoded(spark):
    df = spark.createDataFrame([("<p>a&nbsp;&amp; b</p><br>c",), (None,), ("",)], "x string")
    assert [r[0] for r in df.select(T.clean_html(F.col("x"))).collect()] == ["a & b c", None, ""]


def test_percentage_rounds_half_even(spark):
    assert spark.range(1).select(S.ai_percentage(F.lit(0.9))).collect()[0][0] == 50.0


def test_page_is_clamped(spark):
    rows = posts.page(spark.range(12), [F.asc("id")], 0, 1).collect()
    assert [r.id for r in rows] == [0, 1, 2, 3, 4] and rows[0].total == 12 and rows[0].has_next


def test_systematic_sample_spacing(spark):
    df = spark.range(103).select("id", F.lit(1).alias("g"))
    assert sorted(r.id for r in statistics.systematic(df, 10, ["g"]).collect()) == [i * 103 // 10 for i in range(10)]
    assert statistics.systematic(df, 200, ["g"]).count() == 103


def test_components_of_a_long_path(spark):
    edges = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    nodes = spark.createDataFrame([(999,)], "id long")
    assert {r.id: r.component for r in connected_components(edges, nodes).collect()} == {**{i: 0 for i in range(201)}, 999: 999}


def test_chain_depths_and_deleted_parents(spark):
    rows = [(1, None, None, None), (2, 1, None, None), (3, 2, None, None), (4, None, 3, None), (5, 1, None, "x"), (6, 5, None, None), (7, 99, None, None)]
    df = spark.createDataFrame(rows, "id long, in_reply_to_id long, reblog_of_id long, deleted_at string")
    assert {(r.id, r.root, r.depth) for r in chains.depths(df).collect()} == {(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 4)}


def two_cliques(spark):
    edges = [(a, b, 1) for g in (range(6), range(10, 16)) for a in g for b in g if a < b] + [(0, 10, 1)]
    return spark.createDataFrame(edges, "src long, dst long, weight long"), spark.createDataFrame([(i,) for g in (range(6), range(10, 16)) for i in g], "id long")


def test_modularity_finds_planted_blocks(spark):
    edges, nodes = two_cliques(spark)
    found = {r.id: r.community for r in communities.modularity_communities(edges, nodes).collect()}
    assert len({found[i] for i in range(6)}) == 1 and len({found[i] for i in range(10, 16)}) == 1 and found[1] != found[11]


def test_codelength_of_one_module_is_flow_entropy(spark):
    edges, nodes = two_cliques(spark)
    flow = metrics.page_rank(edges, nodes)
    p = [r.flow for r in flow.collect()]
    assert abs(sum(p) - 1) < 1e-9
    whole = nodes.select("id", F.lit(0).cast("long").alias("community"))
    assert abs(metrics.codelength(edges, flow, whole).collect()[0].codelength + sum(x * math.log2(x) for x in p)) < 1e-9
    assert metrics.mutual_information(whole, whole).collect()[0].nmi == 1.0


def test_null_model_keeps_degrees_up_to_collapsed_pairs(spark):
    edges, _ = two_cliques(spark)
    out = {r.src: r["count"] for r in nullmodel.configuration(edges).groupBy("src").count().collect()}
    real = {r.src: r["count"] for r in edges.groupBy("src").count().collect()}
    assert out and all(out[k] <= real[k] for k in out)


def test_cascade_tree_never_revisits(spark):
    nodes = spark.createDataFrame([(i, f"u{i}", i, False, i == 0, min(i, 11)) for i in range(40)], "id long, acct string, followers long, is_ia boolean, is_seed boolean, activation_step int")
    edges = spark.createDataFrame([(a, b, 0.1, (a + b) % 3 != 0, 1) for a in range(40) for b in range(40) if a != b and (a * b) % 7 == 1], "source long, target long, p_ic double, fired boolean, step int")
    shown, _ = cascade.tree(nodes, edges, 0)
    ids = [r.id for r in shown.collect()]
    assert len(ids) == len(set(ids)) and 0 in ids


def test_conventions_of_the_two_comparisons_differ_only_where_they_say(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, float("nan"))], "id long, probability double")
    b = spark.createDataFrame([(1, 0.6), (4, None)], "id long, probability double")
    strict = compare.comparison({"a": a, "b": b}, inclusive=False, count_unscored=True).collect()[0]
    loose = compare.comparison({"a": a, "b": b}).collect()[0]
    assert (strict.votes_0, strict.votes_1, strict.votes_2) == (2, 2, 0) and (loose.votes_0, loose.votes_1, loose.votes_2) == (0, 1, 1)


# directions and times of edges, written down by hand: 1 wrote post 10; 2 boosted it (table), 3 boosted it by a post of its own,
# 4 replied to it and mentions 5; 6 follows 1
def network(spark):
    instances = spark.createDataFrame([(1, "a.example"), (2, "b.example")], "id long, domain string")
    people = spark.createDataFrame([(i, 1, f"u{i}", i == 2, i * 10) for i in range(1, 7)] + [(7, 2, "u5@a.example", True, 99), (8, 1, "U5", False, 1)], "id long, instance_id long, acct string, bot boolean, followers long")
    day = "timestamp'2024-01-0{}'".format
    rows = [(10, 1, None, None, 1, None), (11, 3, 10, None, 2, None), (12, 4, None, 10, 3, None), (13, 2, None, 10, 4, 5)]
    statuses = spark.createDataFrame([r[:4] for r in rows], "id long, account_id long, reblog_of_id long, in_reply_to_id long").withColumn("instance_id", F.lit(1).cast("long"))
    at = lambda k: F.expr("CASE id " + " ".join(f"WHEN {r[0]} THEN {day(r[k]) if r[k] else 'NULL'}" for r in rows) + " END").cast("timestamp")
    statuses = statuses.withColumn("created_at", at(4)).withColumn("deleted_at", at(5))
    reblogs = spark.createDataFrame([(10, 2), (13, 1)], "status_id long, booster_account_id long")
    mentions = spark.createDataFrame([(12, "u5"), (13, "u1")], "status_id long, mentioned_acct string")
    follows = spark.createDataFrame([(6, 1), (6, 6)], "follower_account_id long, followed_account_id long")
    return instances, people, statuses, reblogs, mentions, follows


def test_directions_and_times_by_hand(spark):
    instances, people, statuses, reblogs, mentions, follows = network(spark)
    fused = project.fused_accounts(people, instances)
    assert {(r.id, r.node) for r in fused.collect()} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 5), (8, 8)}  # case parts accounts
    ends = lambda df: {(r.src, r.dst, r.weight, r.first_ts and r.first_ts.day, r.last_ts and r.last_ts.day) for r in df.collect()}
    assert ends(project.boost_edges(statuses, reblogs)) == {(1, 2, 1, None, None), (1, 3, 1, 2, 2)}
    assert ends(project.reply_edges(statuses)) == {(1, 4, 1, 3, 3)}
    assert ends(project.mention_edges(statuses, mentions, fused, instances)) == {(4, 5, 1, 3, 3), (4, 7, 1, 3, 3)}
    assert ends(project.mention_edges(statuses, mentions, fused, instances, dedup_copies=True)) == {(4, 5, 1, 3, 3)}
    assert ends(project.follow_edges(follows)) == {(6, 1, 1, None, None)}
    parts = [project.boost_edges(statuses, reblogs), project.reply_edges(statuses), project.mention_edges(statuses, mentions, fused, instances), project.follow_edges(follows)]
    got = {(r.src, r.dst): (r.weight, r.w_boost, r.w_reply, r.w_mention, r.w_follow) for r in project.user_graph(parts, fused, ("boost", "reply", "mention", "follow")).collect()}
    assert got == {(1, 2): (1, 1, 0, 0, 0), (1, 3): (1, 1, 0, 0, 0), (1, 4): (1, 0, 1, 0, 0), (4, 5): (2, 0, 0, 2, 0), (6, 1): (1, 0, 0, 0, 1)}


def test_mentions_are_summed_before_their_copies_are_looked_up(spark):
    instances, people, statuses, _, mentions, _ = network(spark)
    fused = project.fused_accounts(people, instances)
    weights = lambda df: {(r.src, r.dst): (r.weight, r.w_mention, r.first_ts, r.last_ts) for r in project.user_graph([df], fused, ("mention",)).collect()}
    said = mentions.unionByName(mentions).unionByName(spark.createDataFrame([(10, "u5"), (10, "u1")], mentions.schema))
    short = project.mention_node_edges(statuses, said, fused, instances)
    assert {(r.src, r.dst): r.weight for r in short.collect()} == {(4, 5): 4, (1, 5): 2, (1, 1): 1}  # one row a name, not one a copy
    assert weights(short) == weights(project.mention_edges(statuses, said, fused, instances)) != {}
    plan = project.mention_edges(statuses, said, fused, instances)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # rows by copy are not shuffled again


def test_graph_from_the_tables_sums_once_by_nodes(spark):
    instances, people, statuses, reblogs, mentions, follows = network(spark)
    fused = project.fused_accounts(people, instances)
    said = mentions.unionByName(spark.createDataFrame([(10, "u5"), (10, "u1"), (11, "nobody")], mentions.schema))
    strangers = reblogs.unionByName(spark.createDataFrame([(10, 99), (99, 2), (10, 7), (10, 1)], reblogs.schema))
    parts = [project.boost_edges(statuses, strangers), project.reply_edges(statuses), project.mention_edges(statuses, said, fused, instances), project.follow_edges(follows)]
    kinds = ("boost", "reply", "mention", "follow")
    rows = lambda df: {tuple(r[c] for c in sorted(df.columns)) for r in df.collect()}
    got = project.graph_of(fused, statuses, strangers, said, instances, follows)
    assert rows(got) == rows(project.user_graph(parts, fused, kinds)) and got.count() == 6
    assert rows(project.graph_of(fused, statuses, strangers)) == rows(project.user_graph(parts[:2], fused, kinds[:2])) != set()
    plan = project.graph_of(fused, statuses, strangers)._jdf.queryExecution().optimizedPlan().toString()
    sums = [x for x in plan.splitlines() if "Aggregate" in x]
    assert len([x for x in sums if "src" in x]) == 1  # no sums by pairs of accounts before


def test_few_accounts_go_to_the_rows(spark):
    instances, people, statuses, reblogs, mentions, follows = network(spark)
    fused = project.fused_accounts(people, instances)
    said = mentions.unionByName(mentions).unionByName(spark.createDataFrame([(10, "u5"), (10, "u1"), (11, "nobody")], mentions.schema))
    strangers = reblogs.unionByName(spark.createDataFrame([(10, 99), (99, 2), (10, 7), (10, 1)], reblogs.schema))
    rows = lambda df: {tuple(r[c] for c in sorted(df.columns)) for r in df.collect()}
    graph = lambda few: project.graph_of(fused, statuses, strangers, said, instances, follows, few=few)
    assert rows(graph(True)) == rows(graph(False)) != set()
    plan = graph(True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=broadcast)") == 10 > graph(False)._jdf.queryExecution().optimizedPlan().toString().count("(strategy=broadcast)")  # authors by use, boosters, names, both ends of follows
    assert "canon" not in "".join(x for x in plan.splitlines() if "Aggregate" in x and "src" in x)  # mentions are not summed by name


def test_graph_is_computed_once_for_its_figures(spark):
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            runs.add(len(b))
            yield b

    edges = spark.createDataFrame([(1, 2, 3), (2, 1, 1), (2, 3, 2)], "src long, dst long, weight long").mapInPandas(seen, "src long, dst long, weight long")
    part = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "id long, community long")
    assert metrics.modularity(edges, part).first()[0] == pytest.approx(4 / 6 - (10 * 10 + 2 * 2) / (4 * 36))
    assert runs.value == 3
    got = project.top_subgraph(part, edges, top=2)[1]
    assert {(r.src, r.dst, r.weight) for r in got.collect()} == {(1, 2, 3), (2, 1, 1)}
    assert runs.value == 6


def test_components_leave_only_what_their_result_reads(spark, tmp_path):
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        path = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
        got = connected_components(path.unionByName(spark.createDataFrame([(500, 500)], "src long, dst long")))
        assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(201)} | {(500, 500)}
        assert len(list(tmp_path.glob("*/table-*"))) == 2  # the edges and the last round
    finally:
        spark.sparkContext._jsc.setCheckpointDir(before)


def test_listings_leave_deleted_posts_out_and_name_the_posts_server(spark):
    instances, people, statuses, *_ = network(spark)
    rows = statuses.withColumn("instance_id", F.lit(2).cast("long")).withColumn("content", F.lit("<p>x</p>"))
    assert {(r.id, r.domain, r.content) for r in posts.with_authors(rows, people, instances).collect()} == {(10, "b.example", "x"), (11, "b.example", "x"), (12, "b.example", "x")}


def test_account_detail_prefers_the_document(spark):
    instances, people, statuses, _, _, follows = network(spark)
    raw = '{"followers_count": 7, "following_count": 0, "statuses_count": 12, "display_name": "", "uri": "http://x", "avatar": "", "avatar_static": "http://y", "fields": [{"name": "k"}], "note": "n"}'
    rows = people.where("id IN (1, 6)").withColumn("username", F.col("acct")).withColumn("raw", F.when(F.col("id") == 1, raw))
    a, b = accounts.detail(rows, follows, statuses, instances).orderBy("id").collect()
    assert (a.label, a.display_name, a.domain, a.followers, a.following, a.statuses, a.url, a.avatar, a.note, a.fields) == ("@u1", "u1", "a.example", 7, 0, 12, "http://x", "http://y", "n", '[{"name":"k"}]')
    assert (b.display_name, b.followers, b.following, b.statuses, b.url, b.avatar, b.note, b.fields) == ("u6", 1, 2, 0, "https://a.example/@u6", None, "", "[]")


def test_probability_fields(spark):
    df = spark.createDataFrame([('{"probability": 0.2, "score": 9}',), ('{"ai_probability": 40}',), ('{"prob": null, "score": 0.5}',), ('{"score": "0.5"}',), ("{}",), ("broken",), (None,)], "raw string")
    assert [r[0] for r in df.select(S.first_probability(F.col("raw"))).collect()] == [0.2, 0.4, None, 0.5, None, None, None]
    assert spark.range(1).select(S.percent_probability(F.lit(0.5)), S.to_unit(F.lit("50")), S.to_unit(F.lit("x"))).collect()[0][:] == (0.005, 0.5, None)


def test_orderings_of_a_page(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.9), (4, 0.5)], "id long, probability double")
    order = lambda name: [r.id for r in df.orderBy(*posts.order_by(name)).collect()]
    assert (order("id"), order("id_desc"), order("top"), order("bottom")) == ([1, 2, 3, 4], [4, 3, 2, 1], [3, 1, 4, 2], [1, 4, 3, 2])


def test_quantiles_and_places_by_brute_force(spark):
    rng = random.Random(3)
    for n in (1, 2, 7, 300):
        values = [rng.choice([0.25, rng.random(), rng.random()]) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(3)
        got = statistics.quantiles(df, "v", {"a": 0.25, "b": 0.5, "c": 1.0}).collect()[0]
        assert [got.a, got.b, got.c] == pytest.approx([pd.Series(values).quantile(q) for q in (0.25, 0.5, 1.0)])
        assert statistics.upper_median(df, "v", "m").collect()[0].m == sorted(values)[n // 2]
    rows = spark.createDataFrame([(g, rng.randint(0, 10**12) if g else i) for g in range(2) for i in range(200)], "g int, id long")
    want = {(g, i): k for g in range(2) for k, i in enumerate(sorted(r.id for r in rows.where(f"g = {g}").collect()))}
    assert {(r.g, r.id): r.rn for r in statistics.numbered(rows, ["g"]).collect()} == want


def test_components_by_brute_force(spark):
    rng = random.Random(4)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)]
    group = {i: i for i in range(301)}
    for a, b in links:
        a, b = group[a], group[b]
        for k, v in group.items():
            if v == max(a, b):
                group[k] = min(a, b)
    got = connected_components(spark.createDataFrame(links, "src long, dst long"), spark.range(301))
    assert {r.id: r.component for r in got.collect()} == group
    none = connected_components(spark.createDataFrame([], "src long, dst long"), spark.range(3))
    assert {r.id: r.component for r in none.collect()} == {0: 0, 1: 1, 2: 2}


def test_flow_by_brute_force(spark):
    rng = random.Random(5)
    links = {(a, b): rng.randint(1, 5) for a in range(12) for b in range(12) if a != b and a < 10 and rng.random() < 0.3}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "src long, dst long, weight long")
    got = {r.id: r.flow for r in metrics.page_rank(df, spark.range(12)).collect()}
    out = {a: sum(w for (x, _), w in links.items() if x == a) for a in range(12)}
    flow = [1 / 12] * 12
    for _ in range(200):
        dead = sum(flow[a] for a in range(12) if not out[a])
        flow = [0.15 / 12 + 0.85 * (sum(flow[a] * w / out[a] for (a, b), w in links.items() if b == i) + dead / 12) for i in range(12)]
    assert [got[i] for i in range(12)] == pytest.approx(flow, rel=1e-9)


def cascade_by_hand(nodes, edges, seed, first=40, fill=10, idle=25, steps=11):
    followers, step_of = {n[0]: n[2] for n in nodes}, {n[0]: n[5] for n in nodes}
    hot, cold = [(e[0], e[1]) for e in edges if e[3]], [(e[0], e[1]) for e in edges if not e[3]]
    level = sorted((b for a, b in hot if a == seed and b != seed), key=lambda b: (-followers[b], b))[:first]
    seen, links = {seed: 0, **dict.fromkeys(level, 1)}, [(seed, b, 1) for b in level]
    for d in range(2, steps + 1):
        new = {}
        for a, b in sorted(hot):
            if a in level and b not in seen:
                new[b] = min(a, new.get(b, a))
        links += [(a, b, d) for b, a in new.items()]
        if len(new) < fill:
            rest = sorted((i for i in followers if step_of[i] == d and i not in seen and i not in new), key=lambda i: (-followers[i], i))[: fill - len(new)]
            for i in rest:
                sources = [a for a, b in hot if b == i]
                links += [(min(sources), i, d)] if sources else []
            new |= dict.fromkeys(rest)
        seen |= dict.fromkeys(new, d)
        level = list(new)
    off = sorted((b for a, b in cold if a == seed), key=lambda b: (-followers[b], b))[:idle]
    roles = {(i, d, "seed" if i == seed else "active") for i, d in seen.items()} | {(i, None, "inactive") for i in off if i not in seen}
    return roles, {(a, b, d, True) for a, b, d in links} | {(seed, b, None, False) for b in off}


def test_cascade_tree_by_brute_force(spark):
    rng = random.Random(6)
    people = [(i, f"u{i}", rng.randint(0, 50), False, i == 0, rng.randint(1, 11)) for i in range(120)]
    edges = [(a, b, 0.1, rng.random() < 0.6, 1) for a in range(120) for b in range(120) if a != b and rng.random() < 0.03] + [(0, b, 0.1, b % 2 == 0, 1) for b in range(100, 120)]
    edges = list({(e[0], e[1]): e for e in edges}.values())
    nodes = spark.createDataFrame(people, "id long, acct string, followers long, is_ia boolean, is_seed boolean, activation_step int")
    shown, links = cascade.tree(nodes, spark.createDataFrame(edges, "source long, target long, p_ic double, fired boolean, step int"), 0, first=5)
    want = cascade_by_hand(people, edges, 0, first=5)
    assert ({tuple(r) for r in shown.collect()}, {tuple(r) for r in links.select("source", "target", "depth", "fired").collect()}) == want


def test_moves_reach_the_best_partition_of_two_cliques(spark):
    edges, nodes = two_cliques(spark)
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    found = communities.flow_communities(both, nodes, flow=metrics.page_rank(both, nodes))
    assert len({r.community for r in found.where("id < 6").collect()}) == 1 and found.select("community").distinct().count() == 2


def planted(spark, blocks=4, size=15, seed=3):
    rng = random.Random(seed)
    n = blocks * size
    rows = [(a, b, 1) for a in range(n) for b in range(n) if a != b and rng.random() < (0.5 if a // size == b // size else 0.02)]
    return spark.createDataFrame(rows, "src long, dst long, weight long"), spark.range(n)


def test_communities_are_the_planted_ones_and_hold_together(spark):
    edges, nodes = planted(spark)
    truth = nodes.select("id", F.floor(F.col("id") / 15).alias("community"))
    moved, refined, flow = (
        communities.modularity_communities(edges, nodes).cache(), communities.modularity_communities(edges, nodes, refine=True).cache(),
        communities.flow_communities(edges, nodes).cache(),
    )
    nmi = {(r.x, r.y): r.nmi for r in metrics.agreements({"truth": truth, "moved": moved, "refined": refined, "flow": flow}).collect()}
    assert min(nmi["truth", k] for k in ("moved", "refined", "flow")) > 0.9 and nmi["flow", "flow"] == pytest.approx(1.0)
    assert nmi["truth", "moved"] == pytest.approx(metrics.mutual_information(truth, moved).collect()[0].nmi)
    q = lambda p: metrics.modularity(edges, p).collect()[0].modularity
    assert q(refined) >= q(moved) - 1e-9 and q(moved) > q(truth) - 0.02
    assert communities.split_disconnected(edges, refined).select("community").distinct().count() == refined.select("community").distinct().count()


def test_null_graphs_go_together_and_planted_blocks_are_significant(spark):
    edges, nodes = planted(spark)
    null = nullmodel.configurations(edges, 3).cache()
    pairs = {(r.g, r.src, r.dst) for r in null.collect()}
    assert len(pairs) == null.count() and {g for g, _, _ in pairs} == {1, 2, 3} and all(a != b for _, a, b in pairs)
    real_out, real_in = ({r[0]: r[1] for r in edges.groupBy(c).count().collect()} for c in ("src", "dst"))
    for g in (1, 2, 3):
        for k, real in ((1, real_out), (2, real_in)):
            got = {}
            for p in pairs:
                if p[0] == g:
                    got[p[k]] = got.get(p[k], 0) + 1
            assert all(n <= real[i] for i, n in got.items()) and sum(got.values()) > 0.8 * sum(real.values())
    row = nullmodel.significance(edges, nodes, 3).collect()[0]
    assert row.significant and row.real > row.null_mean
    assert -1e-9 <= row.null_mean < 0.2


def test_ids_pass_scorers_whole(spark):
    big = 2**60
    rows = spark.createDataFrame([(big + 1, "en", "a b"), (big + 2, "en", None), (None, "en", "c")], "id long, lang string, text string")
    assert {r.id for r in scoring.score_texts(rows, scoring.mock_scorer).collect()} == {big + 1, big + 2, None}
    claims = rows.withColumn("date", F.lit("d")).withColumn("evidence", F.lit("e"))
    judge = lambda b: pd.DataFrame({"verdict": "VERA", "confidence": 0.5, "reasoning": b["text"]})
    assert {(r.id, r.veracity) for r in scoring.judge_claims(claims, judge).collect()} == {(big + 1, 4), (big + 2, 4), (None, 4)}
    named = rows.withColumn("id", F.concat(F.lit("p"), F.col("id").cast("string")))
    assert {r.id for r in scoring.score_texts(named, scoring.mock_scorer).collect()} == {f"p{big + 1}", f"p{big + 2}", None}


def test_reports_are_written_and_absent_ones_are_empty(spark, tmp_path):
    totals, bins = spark.createDataFrame([(3, 0.5)], "total long, mean double"), spark.createDataFrame([(1, 2), (0, None)], "bin int, n long")
    lines = [r.value for r in writers.write_report(totals, {"bins": bins}, str(tmp_path / "r"), "Title").orderBy("place").collect()]
    assert lines == ["# Title", "", "| figure | value |", "| --- | --- |", "| total | 3 |", "| mean | 0.5 |", "", "## bins", "", "| bin | n |", "| --- | --- |", "| 0 | - |", "| 1 | 2 |"]
    assert sorted(x.value for x in spark.read.text(str(tmp_path / "r" / "md")).collect()) == sorted(lines)
    schema = "total long, bins array<struct<bin: int, n: long>>"
    assert readers.report(spark, str(tmp_path / "r" / "json"), schema).collect()[0].total == 3
    assert readers.report(spark, str(tmp_path / "none"), schema).count() == 0


def test_bundle_merge_resolves_references(spark):
    more = [F.lit("en").alias("language"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("deleted_at")]
    known = {
        "topics": spark.createDataFrame([(1, "t")], "id long, name string"), "instances": spark.createDataFrame([(1, "a", 1, 5)], "id long, domain string, topic_id long, active_users int"),
        "accounts": spark.createDataFrame([(1, 1, "x", "x", "x", False)], "id long, instance_id long, mastodon_id string, acct string, username string, bot boolean"),
        "statuses": spark.createDataFrame([(1, 1, "s1", 1, None, None, "web")], "id long, instance_id long, mastodon_id string, account_id long, reblog_of_id long, in_reply_to_id long, source string").select("*", *more),
        "status_hashtags": spark.createDataFrame([(1, "h")], "status_id long, hashtag string"), "mentions": spark.createDataFrame([], "status_id long, mentioned_acct string"),
        "topic_hashtags": spark.createDataFrame([(1, 1, "h", 2)], "topic_id long, instance_id long, hashtag string, usage_count int"),
        "reblogs": spark.createDataFrame([], "status_id long, booster_account_id long"), "follows": spark.createDataFrame([], "follower_account_id long, followed_account_id long"),
    }
    out = merge.export_bundle(known)
    ref = "struct<instance_domain: string, mastodon_id: string>"
    new = {
        "instances": spark.createDataFrame([("a", "t", 9), ("b", None, 1)], out["instances"].schema), "accounts": spark.createDataFrame([("b", "y", "y", "y", True)], out["accounts"].schema),
        "statuses": spark.createDataFrame([("b", "s2", ("b", "y"), ("a", "s1"), None, "web"), ("b", "s3", ("b", "y"), None, ("b", "s2"), "web"), ("b", "s4", ("b", "lost"), None, None, "web")], f"instance_domain string, mastodon_id string, account_ref {ref}, reblog_of_ref {ref}, in_reply_to_ref {ref}, source string").select("*", *more),
        "reblogs": spark.createDataFrame([(("b", "s3"), ("a", "x")), (("b", "s4"), ("a", "x"))], f"status_ref {ref}, booster_account_ref {ref}"),
    }
    merged, summary = merge.merge_bundle(known, {**out, **new})
    counts = {r.table_name: (r.new_rows, r.existing_rows) for r in summary.collect()}
    assert counts == {"topics": (0, 1), "instances": (1, 1), "accounts": (1, 0), "statuses": (2, 0), "status_hashtags": (0, 1), "mentions": (0, 0), "topic_hashtags": (0, 1), "reblogs": (1, 0), "follows": (0, 0)}
    st = {r.mastodon_id: r for r in merged["statuses"].collect()}
    assert st["s2"].reblog_of_id == 1 and st["s3"].in_reply_to_id == st["s2"].id and merged["unresolved"].collect()[0].mastodon_id == "s4"
    assert {r.active_users for r in merged["instances"].where("domain = 'a'").collect()} == {5}  # existing rows stay as they are


def test_the_rest_works_without_the_optional_folders(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(here, tmp_path / "r", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'g1_user_graph' in q and not any(n.startswith('op') or n == 'pipeline' for n in [*q, *o])"
    for gone in ((), ("corpus_pipeline.py",)):
        for name in gone:
            os.remove(tmp_path / "r" / name)
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={**os.environ, "PYTHONPATH": ""})


def test_a_statuss_own_document_goes_before_its_copy_in_a_reblog(spark):
    own = '{"id": "1", "account": {"id": "7", "acct": "a"}, "tags": [{"name": "Own"}]}'
    copy = '{"id": "2", "account": {"id": "8", "acct": "b"}, "reblog": {"id": "1", "account": {"id": "7", "acct": "0"}, "tags": [{"name": "copy"}]}}'
    for order in ([own, copy], [copy, own]):
        got = readers.status_rows(spark.createDataFrame([(x,) for x in order], "raw string").coalesce(1))
        assert {tuple(r) for r in got["hashtags"].collect()} == {("1", "own")}
        assert {(r.id, r.acct) for r in got["accounts"].collect()} == {("7", "a"), ("8", "b")}
        assert {(r.id, r.reblog_of) for r in got["statuses"].collect()} == {("1", None), ("2", "1")}


def test_rows_without_a_key_are_not_sent_to_one_task(spark):
    rows = spark.range(4000).withColumn("k", F.when(F.col("id") % 100 == 0, F.col("id") % 7))
    right = spark.createDataFrame([(i, i * 10) for i in range(5)] + [(None, 9)], "k long, v long")
    keep = {n: spark.conf.get(n) for n in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = left_by(rows, right, "k", "id")
        want = rows.join(right, "k", "left").select("id", "k", "v")
        assert sorted(map(repr, got.select("id", "k", "v").collect())) == sorted(map(repr, want.collect()))
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 1300
    finally:
        for n, v in keep.items():
            spark.conf.set(n, v)


def test_documents_and_drops_grow_in_number_and_not_in_size(spark):
    assert [io_queries._slices(n) for n in (0, 400_000, 36_000_000)] == [8, 8, 720]


def test_contracted_links_have_the_same_components(spark):
    rng = random.Random(17)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] * 3 + [(900 + i, 901 + i) for i in range(20)] + [(950, 950), (951, None), (None, 3)]
    links += [(a, b) for a in range(1000, 1040) for b in range(1000, 1040)]
    edges = spark.createDataFrame(links, "src long, dst long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    short = contracted(edges)
    assert rows(connected_components(short, spark.range(1100), "u", "v")) == rows(connected_components(edges, spark.range(1100)))
    assert rows(connected_components(short, None, "u", "v")) == rows(connected_components(edges))
    assert short.where("u >= 1000").count() == 40  # of 1,600
    assert contracted(edges.limit(0)).count() == 0


def test_components_shuffle_no_link_of_the_graph(spark, monkeypatch):
    from tidegraph.fixtures import Tables
    from tidegraph.plans import graph_queries as q

    t, seen = Tables(spark, "/root/testdata/sf0.001"), []
    monkeypatch.setattr(q, "contracted", lambda pairs, *ends: seen.append(pairs) or contracted(pairs, *ends))
    rows = lambda df: sorted(map(tuple, df.collect()))
    g = q.Graph(t)
    for every, edges in ((True, g.edges(follows=True)), (False, g.diffusion())):
        assert rows(connected_components(g.links(every), g.nodes().select("id"))) == rows(connected_components(edges, g.nodes().select("id")))
        assert rows(seen[-1].distinct()) == rows(edges.select("src", "dst"))
        plan = seen[-1]._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.splitlines() if "Aggregate" in x and ("status_id" in x or "follower" in x or "src" in x)]  # neither repeats nor pairs are summed


def test_mentions_are_made_distinct_by_the_key_of_their_join(spark):
    from tidegraph import plans

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = plans.QUERIES["j8_mention_edges"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    shuffles = [x for x in plan.splitlines() if "Exchange hashpartitioning(status_id" in x]
    assert len(shuffles) == 2 and "mentioned_acct" not in "".join(shuffles)  # mentions and statuses, once each


def test_methods_share_their_mergers_and_moves(spark, monkeypatch):
    """What refines begins where plain modularity ends, so nodes are moved twice for three methods; equal to each method alone."""
    pairs = [(a, b) for k in (0, 5) for a in range(k, k + 5) for b in range(k, k + 5) if a != b] + [(0, 5), (5, 0)]
    edges, nodes = cut(spark.createDataFrame(pairs, "src long, dst long").withColumn("weight", F.lit(1).cast("long"))), cut(spark.range(10))
    assert (rows_in(edges), rows_in(nodes), rows_in(spark.range(7))) == (42, 10, 7)
    moved, real = [], communities._moved
    monkeypatch.setattr(communities, "_moved", lambda *a: moved.append(1) or real(*a))
    settings = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    flow, found = communities.by_methods(edges, nodes)
    assert len(moved) == 2 and settings == {k: spark.conf.get(k) for k in settings}
    assert abs(flow.agg(F.sum("flow")).first()[0] - 1) < 1e-9
    groups = lambda df: sorted(sorted(r.ids) for r in df.groupBy("community").agg(F.collect_list("id").alias("ids")).collect())
    assert set(found) == {"modularity", "refined", "flow"} and all(groups(p) == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9]] for p in found.values())
    assert groups(communities.modularity_communities(edges, nodes, refine=True)) == groups(found["refined"])
