"""Projecting accounts, posts, boosts, replies, mentions and follows to one weighted user graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.text import canonical_acct, log_weight

from .iterate import cut

EDGE = ("src", "dst", "kind", "weight", "first_ts", "last_ts")
#: Up to this many accounts their nodes and names go to every task, some 100 bytes each.
BROADCAST_ACCOUNTS = 1_000_000


def fused_accounts(accounts: DataFrame, instances: DataFrame) -> DataFrame:
    """(id, canon, node): the copies of an account share the smallest id of their canonical name."""
    home = instances.select(F.col("id").alias("instance_id"), "domain")
    named = accounts.join(home, "instance_id").withColumn("canon", canonical_acct(F.col("acct"), F.col("domain")))
    first = named.groupBy("canon").agg(F.min("id").alias("node"))
    return named.join(first, "canon")


def nodes_of(fused: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """G1 nodes: (id, acct, bot, followers, topics) with any bot flag, the most followers, and the sorted topics."""
    out = fused.groupBy("node", "canon").agg(F.max(F.col("bot").cast("int")).cast("boolean").alias("bot"), F.max("followers").alias("followers"))
    if topics is not None:
        named = fused.select("id", "node").join(topics.select(F.col("account_id").alias("id"), "topic"), "id")
        named = named.groupBy("node").agg(F.array_join(F.sort_array(F.collect_set("topic")), ",").alias("topics"))
        out = out.join(named, "node", "left")
    else:
        out = out.withColumn("topics", F.lit(None).cast("string"))
    return out.select(F.col("node").alias("id"), F.col("canon").alias("acct"), "bot", "followers", F.coalesce("topics", F.lit("")).alias("topics"))


def account_topics(statuses: DataFrame, post_topics: DataFrame) -> DataFrame:
    """(account_id, topic) of the posts that an account wrote."""
    return statuses.select(F.col("id").alias("status_id"), "account_id").join(post_topics, "status_id").select("account_id", "topic").distinct()


def _live(statuses: DataFrame) -> DataFrame:
    return statuses.where("deleted_at IS NULL")


def boost_edges(statuses: DataFrame, reblogs: DataFrame) -> DataFrame:
    """Author to booster, from the boosts table and from reblog posts (counted twice where both know it).

    The boosts table has no times, so only reblog posts give first and last time.
    """
    author = _live(statuses).select(F.col("id").alias("status_id"), F.col("account_id").alias("src"))
    listed = reblogs.join(author, "status_id").select("src", F.col("booster_account_id").alias("dst"), F.lit(None).cast("timestamp").alias("ts"))
    copies = _live(statuses).where("reblog_of_id IS NOT NULL").select(F.col("reblog_of_id").alias("status_id"), F.col("account_id").alias("dst"), F.col("created_at").alias("ts"))
    posted = copies.join(author, "status_id").select("src", "dst", "ts")
    return _summed(listed.unionByName(posted), "boost")


def reply_edges(statuses: DataFrame) -> DataFrame:
    """Author of the parent to author of the reply."""
    author = _live(statuses).select(F.col("id").alias("in_reply_to_id"), F.col("account_id").alias("src"))
    replies = _live(statuses).where("in_reply_to_id IS NOT NULL").select("in_reply_to_id", F.col("account_id").alias("dst"), F.col("created_at").alias("ts"))
    return _summed(replies.join(author, "in_reply_to_id").select("src", "dst", "ts"), "reply")


def _mentioned(statuses: DataFrame, mentions: DataFrame, instances: DataFrame) -> DataFrame:
    """(src, canon, weight, first_ts, last_ts): how often an author names an account, before its copies are looked up."""
    home = instances.select(F.col("id").alias("instance_id"), "domain")
    said = mentions.join(_live(statuses).select(F.col("id").alias("status_id"), "instance_id", F.col("account_id").alias("src"), F.col("created_at").alias("ts")), "status_id")
    said = said.join(home, "instance_id").withColumn("canon", canonical_acct(F.col("mentioned_acct"), F.col("domain")))
    return said.groupBy("src", "canon").agg(F.count("*").alias("weight"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def mention_edges(statuses: DataFrame, mentions: DataFrame, fused: DataFrame, instances: DataFrame, dedup_copies: bool = False) -> DataFrame:
    """The author to the mentioned account.  Every cached copy of an account matches, unless ``dedup_copies``.

    Mentions are summed by name first and a copy has one name, so the rows by copy go straight to the result.
    """
    who = fused.select("canon", F.col("node" if dedup_copies else "id").alias("dst")).distinct()
    return _mentioned(statuses, mentions, instances).join(who, "canon").where("src <> dst").select("src", "dst", F.lit("mention").alias("kind"), "weight", "first_ts", "last_ts")


def mention_node_edges(statuses: DataFrame, mentions: DataFrame, fused: DataFrame, instances: DataFrame) -> DataFrame:
    """J8 for ``user_graph``: one row for a name, at its node, with the weight that the rows by copy would have together.

    Pairs with mentions of oneself by another copy are loops between nodes, which ``user_graph`` leaves out.
    """
    who = fused.groupBy("canon").agg(F.min("node").alias("dst"), F.countDistinct("id").alias("copies"))
    return _mentioned(statuses, mentions, instances).join(who, "canon").select("src", "dst", F.lit("mention").alias("kind"), (F.col("weight") * F.col("copies")).alias("weight"), "first_ts", "last_ts")


def follow_edges(follows: DataFrame) -> DataFrame:
    """The follower to the followed account, one for each row."""
    return _summed(follows.select(F.col("follower_account_id").alias("src"), F.col("followed_account_id").alias("dst"), F.lit(None).cast("timestamp").alias("ts")), "follow")


def _summed(rows: DataFrame, kind: str) -> DataFrame:
    return rows.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).select("src", "dst", F.lit(kind).alias("kind"), "weight", "first_ts", "last_ts")


def user_graph(parts: list[DataFrame], fused: DataFrame, kinds: tuple[str, ...] = ("boost", "reply", "mention")) -> DataFrame:
    """One edge for each pair of fused accounts: total and weight by kind, first and last time; loops and unknown ends out."""
    node = fused.select("id", "node")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    ends = rows.join(node.select(F.col("id").alias("src"), F.col("node").alias("a")), "src").join(node.select(F.col("id").alias("dst"), F.col("node").alias("b")), "dst").where("a <> b")
    by_kind = [F.sum(F.when(F.col("kind") == k, F.col("weight")).otherwise(0)).alias(f"w_{k}") for k in kinds]
    return ends.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight"), *by_kind, F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def graph_of(fused: DataFrame, statuses: DataFrame, reblogs: DataFrame, mentions: DataFrame | None = None, instances: DataFrame | None = None, follows: DataFrame | None = None, few: bool = False, pairs: bool = False) -> DataFrame:
    """G1, G2, J9 from the tables: ``user_graph`` of their parts, boosts and replies always, mentions and follows where given.

    Every end becomes its node where its row is first joined, and rows are summed once, by pairs of nodes;
    sums by pairs of accounts, of which there are nearly as many as rows, are not shuffled.  With ``few`` (no more than
    ``BROADCAST_ACCOUNTS`` accounts) no row is shuffled to find its node, and mentions are not summed by name before.  With ``pairs`` only the ends of the rows
    come out, unsummed and with repeats.
    """
    spread = F.broadcast if few else (lambda frame: frame)
    node = spread(fused.select("id", "node"))
    end = lambda rows, name, into: rows.join(node.select(F.col("id").alias(name), F.col("node").alias(into)), name).drop(name)
    posted = end(_live(statuses).select("id", "account_id", "instance_id", "reblog_of_id", "in_reply_to_id", F.col("created_at").alias("ts")), "account_id", "by")
    author = posted.select(F.col("id").alias("status_id"), F.col("by").alias("src"))
    row = lambda rows, kind, n: rows.where("src <> dst").select("src", "dst", F.lit(kind).alias("kind"), n.cast("long").alias("n"), "ts")
    no_time, one = F.lit(None).cast("timestamp").alias("ts"), F.lit(1)

    def answers(parent: str, kind: str) -> DataFrame:
        made = posted.where(F.col(parent).isNotNull()).select(F.col(parent).alias("status_id"), F.col("by").alias("dst"), "ts")
        return row(made.join(author, "status_id"), kind, one)

    listed = end(reblogs.select("status_id", "booster_account_id"), "booster_account_id", "dst").join(author, "status_id")
    kinds = ["boost", "reply"]
    rows = row(listed.select("src", "dst", no_time), "boost", one).unionByName(answers("reblog_of_id", "boost")).unionByName(answers("in_reply_to_id", "reply"))
    if mentions is not None:
        home = instances.select(F.col("id").alias("instance_id"), "domain")
        said = mentions.join(posted.select(F.col("id").alias("status_id"), "instance_id", F.col("by").alias("src"), "ts"), "status_id").join(home, "instance_id")
        # one row for a name, with the weight that the rows by copy would have together
        who = spread(fused.groupBy("canon").agg(F.min("node").alias("dst"), F.countDistinct("id").alias("copies")))
        named = said.withColumn("canon", canonical_acct(F.col("mentioned_acct"), F.col("domain")))
        if few:
            named = named.select("src", "canon", one.cast("long").alias("n"), F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts"))
        else:
            named = named.groupBy("src", "canon").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        named = named.join(who, "canon").where("src <> dst").select("src", "dst", F.lit("mention").alias("kind"), (F.col("n") * F.col("copies")).alias("n"), "first_ts", "last_ts")
        kinds.append("mention")
    rows = rows.select("src", "dst", "kind", "n", F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts"))
    if mentions is not None:
        rows = rows.unionByName(named)
    if follows is not None:
        ends = follows.where("follower_account_id <> followed_account_id").select("follower_account_id", "followed_account_id")
        ends = end(end(ends, "follower_account_id", "src"), "followed_account_id", "dst")
        rows = rows.unionByName(row(ends.withColumn("ts", no_time), "follow", one).select("src", "dst", "kind", "n", F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts")))
        kinds.append("follow")
    if pairs:
        return rows.select("src", "dst")
    by_kind = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"w_{k}") for k in kinds]
    return rows.groupBy("src", "dst").agg(F.sum("n").alias("weight"), *by_kind, F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def mixed_edges(edges: DataFrame, kinds: tuple[str, ...] = ("boost", "reply", "mention", "follow")) -> DataFrame:
    """How many edges have more than one kind."""
    n = sum((F.when(F.col(f"w_{k}") > 0, 1).otherwise(0) for k in kinds), F.lit(0))
    return edges.agg(F.count("*").alias("edges"), F.count_if(n > 1).alias("mixed"))


def normalized(edges: DataFrame) -> DataFrame:
    """Edges with their weight on a log scale in [0, 1]."""
    return edges.crossJoin(edges.agg(F.max("weight").alias("largest"))).withColumn("weight_norm", log_weight(F.col("weight"), F.col("largest"))).drop("largest")


def diffusion(edges: DataFrame) -> DataFrame:
    """boosts and replies only."""
    return edges.select("src", "dst", (F.col("w_boost") + F.col("w_reply")).alias("weight")).where("weight > 0")


def degrees(edges: DataFrame) -> DataFrame:
    """In, out and total degree and out-strength of every node with an edge."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("weight").alias("w"))
    ends = ends.unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"), (F.col("weight") * 0).alias("w")))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count("*").alias("degree"), F.sum("w").alias("out_strength"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def top_subgraph(nodes: DataFrame, edges: DataFrame, top: int | None = None, topic: str | None = None, communities: DataFrame | None = None, community: int | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes by topic and community, then the strongest by outgoing weight, and the edges among them."""
    if topic:
        nodes = nodes.where(F.lower("topics").contains(topic.lower()))
    if community is not None:
        nodes = nodes.join(communities.where(F.col("community") == community).select("id"), "id", "left_semi")
    if top is None:
        return nodes, induced(edges, nodes)
    inside = cut(induced(edges, nodes).select("src", "dst", *[c for c in edges.columns if c not in ("src", "dst")]))  # the edges are computed once
    strength = inside.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("__s"))
    nodes = nodes.join(strength, "id", "left").orderBy(F.coalesce("__s", F.lit(0)).desc(), "id").limit(top).drop("__s")
    return nodes, induced(inside, nodes)


def large_components(components: DataFrame, nodes: DataFrame, communities: DataFrame, larger_than: int) -> DataFrame:
    """F16: nodes of components above a size, with their community or -1."""
    size = components.groupBy("component").agg(F.count("*").alias("size"))
    big = components.join(size.where(F.col("size") > larger_than), "component").select("id", "component", "size")
    return nodes.join(big, "id").join(communities, "id", "left").withColumn("community", F.coalesce("community", F.lit(-1)))


PALETTE = ("#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#bcbd22", "#17becf")
GREY = "#999999"


def viewer(nodes: DataFrame, edges: DataFrame, communities: DataFrame, drop_mention_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Links, and the nodes that have one with colour by community and size by degree."""
    if drop_mention_only:
        edges = edges.where("w_boost + w_reply > 0")
    degree = degrees(edges).select("id", "degree")
    rows = nodes.join(degree, "id").join(communities, "id", "left")
    colour = F.element_at(F.array(*map(F.lit, PALETTE)), F.pmod(F.col("community"), F.lit(len(PALETTE))).cast("int") + 1)
    rows = rows.select("id", "acct", "community", "followers", F.coalesce(F.when(F.col("community") >= 0, colour), F.lit(GREY)).alias("colour"), (2 + F.sqrt("degree")).alias("size"))
    return rows, edges.select("src", "dst", "weight")


def report(nodes: DataFrame, edges: DataFrame, components: DataFrame, kinds: tuple[str, ...] = ("boost", "reply", "mention")) -> DataFrame:
    """Nodes, edges, edges by kind, isolated share, components, giant share, mean out-degree of nodes with outgoing edges."""
    n = nodes.agg(F.count("*").alias("nodes"))
    e = edges.agg(F.count("*").alias("edges"), *[F.count_if(F.col(f"w_{k}") > 0).alias(f"edges_{k}") for k in kinds], F.countDistinct("src").alias("sources"))
    touched = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().agg(F.count("*").alias("touched"))
    sizes = components.groupBy("component").agg(F.count("*").alias("size")).agg(F.count("*").alias("components"), F.max("size").alias("giant"))
    one = n.crossJoin(e).crossJoin(touched).crossJoin(sizes)
    pct = lambda a: F.when(F.col("nodes") > 0, 100.0 * a / F.col("nodes")).otherwise(0.0)
    return one.select("nodes", "edges", *[f"edges_{k}" for k in kinds], pct(F.col("nodes") - F.col("touched")).alias("isolated_pct"), "components", pct(F.col("giant")).alias("giant_pct"), F.when(F.col("sources") > 0, F.col("edges") / F.col("sources")).otherwise(0.0).alias("mean_out_degree"))


def ego_expansion(seeds: DataFrame, follows: DataFrame, accounts: DataFrame, per_seed: int = 80) -> tuple[DataFrame, DataFrame]:
    """Each seed's followed accounts, at most ``per_seed`` of them (most followed first), and all accounts reached."""
    out = follows.select(F.col("follower_account_id").alias("src"), F.col("followed_account_id").alias("dst")).join(seeds.select(F.col("id").alias("src")), "src", "left_semi").distinct()
    ranked = out.join(accounts.select(F.col("id").alias("dst"), "followers"), "dst")
    w = Window.partitionBy("src").orderBy(F.desc("followers"), "dst")
    edges = ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_seed).select("src", "dst")
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).unionByName(seeds.select("id")).distinct()
    return edges, accounts.join(ids, "id", "left_semi")
