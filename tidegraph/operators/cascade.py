"""Analytics over recorded influence cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.text import efficiency

from .iterate import cut


def fired(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges that fired and those that did not."""
    return edges.where("fired"), edges.where("NOT fired")


def fired_by_step(edges: DataFrame) -> DataFrame:
    """K1: fired edges by step."""
    return edges.where("fired").groupBy("step").agg(F.count("*").alias("fired_edges"))


def direct_reach(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """K1: fired edges leaving each seed, 0 where none does."""
    seeds = nodes.where("is_seed").select("id")
    n = edges.where("fired").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"))
    return seeds.join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("direct_reached"))


def step_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """New nodes of each step, AI and human, their running total and its share, fired edges."""
    new = nodes.where("activation_step IS NOT NULL").groupBy(F.col("activation_step").alias("step")).agg(F.count("*").alias("new_nodes"), F.count_if("is_ia").alias("new_ai"), F.count_if(~F.col("is_ia")).alias("new_human"))
    run = F.sum("new_nodes").over(Window.orderBy("step"))  # one row for each step
    rows = new.withColumn("cumulative", run).crossJoin(nodes.agg(F.count("*").alias("total"))).join(fired_by_step(edges), "step", "left")
    return rows.select("step", "new_nodes", "new_ai", "new_human", "cumulative", (100.0 * F.col("cumulative") / F.col("total")).alias("cumulative_pct"), F.coalesce("fired_edges", F.lit(0)).alias("fired_edges"))


def seed_leaderboard(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """K3: seeds with direct reach and reach per follower."""
    rows = direct_reach(nodes, edges).join(nodes.select("id", "acct", "followers"), "id")
    return rows.withColumn("efficiency", efficiency(F.col("direct_reached"), F.col("followers")))


def leader_order():
    """K3: by reach, then followers, then id."""
    return [F.desc("direct_reached"), F.desc("followers"), F.asc("id")]


def search_seeds(leaders: DataFrame, term: str) -> DataFrame:
    """seeds whose name holds a term."""
    return leaders.where(F.lower("acct").contains(term.lower()))


def active_nodes(nodes: DataFrame, step: int | None = None, kind: str | None = None, term: str = "") -> DataFrame:
    """reached nodes by step, type ('ai' or 'human') and search in name or id."""
    rows = nodes.where("activation_step IS NOT NULL")
    if step is not None:
        rows = rows.where(F.col("activation_step") == step)
    if kind is not None:
        rows = rows.where(F.col("is_ia") == (kind == "ai"))
    return rows.where(F.lower("acct").contains(term.lower()) | F.col("id").cast("string").contains(term)) if term else rows


def top_targets(nodes: DataFrame, k: int = 50) -> DataFrame:
    """K4: reached humans by followers, then step."""
    return nodes.where("NOT is_ia AND activation_step IS NOT NULL").orderBy(F.desc("followers"), "activation_step", "id").limit(k)


def demographics(nodes: DataFrame) -> DataFrame:
    """K5: reached nodes by type, and seeds."""
    on = F.col("activation_step").isNotNull()
    return nodes.agg(F.count_if(on).alias("activated"), F.count_if(on & F.col("is_ia")).alias("activated_ai"), F.count_if(on & ~F.col("is_ia")).alias("activated_human"), F.count_if("is_seed").alias("seeds"))


def display_edges(nodes: DataFrame, edges: DataFrame, top: int = 60, per_seed: int = 6) -> DataFrame:
    """Of the top seeds' fired edges the first few of each by (step, target), and those between seeds."""
    seeds = seed_leaderboard(nodes, edges).orderBy(*leader_order()).limit(top).select("id")
    own = edges.where("fired").join(seeds.select(F.col("id").alias("source")), "source", "left_semi")
    own = own.join(seeds.select(F.col("id").alias("target"), F.lit(True).alias("to_seed")), "target", "left")
    rank = F.row_number().over(Window.partitionBy("source").orderBy("step", "target"))
    return own.withColumn("rank", rank).where((F.col("rank") <= per_seed) | F.col("to_seed")).select("source", "target", "p_ic", "step")


def reached_until(nodes: DataFrame, step: int) -> DataFrame:
    """K8: nodes reached by a step, and their share."""
    n = F.count_if(F.col("activation_step") <= step)
    return nodes.agg(n.alias("activated"), (100.0 * n / F.count("*")).alias("pct"))


def reached_per_seed(nodes: DataFrame) -> DataFrame:
    """K9: reached nodes for each seed."""
    return nodes.agg((F.count_if(F.col("activation_step").isNotNull()) / F.count_if("is_seed")).alias("mean_reached"))


def tree(nodes: DataFrame, edges: DataFrame, seed: int, first: int = 40, fill: int = 10, idle: int = 25, steps: int = 11) -> tuple[DataFrame, DataFrame]:
    """K7: the cascade below one seed as nodes (id, depth, role) and links (source, target, depth, fired).

    The seed's best targets by followers, then level by level the fired edges to nodes not seen
    before (a node reached by several takes the smallest source).  A level with fewer than
    ``fill`` edges is filled with the most followed nodes that the recorded cascade reached at that
    step, each with one incoming fired edge (the smallest source) where it has one.  Last, some
    neighbours that the seed did not convince.
    """
    spark = nodes.sparkSession
    hot, cold = fired(edges)
    info = nodes.select(F.col("id").alias("target"), "followers", "activation_step")
    start = hot.where(F.col("source") == seed).join(info, "target").where(F.col("target") != seed).orderBy(F.desc("followers"), "target").limit(first)
    links = cut(start.select("source", "target", F.lit(1).alias("depth")))
    seen = cut(links.select(F.col("target").alias("id"), "depth").unionByName(spark.createDataFrame([(seed, 0)], "id long, depth int")))
    front = links.select(F.col("target").alias("source"))
    for step in range(2, steps + 1):
        nxt = hot.join(front, "source", "left_semi").join(seen.select(F.col("id").alias("target")), "target", "left_anti")
        nxt = cut(nxt.groupBy("target").agg(F.min("source").alias("source")).select("source", "target", F.lit(step).alias("depth")))
        short = fill - nxt.limit(fill).count()
        new = nxt.select(F.col("target").alias("id"), "depth")
        links = links.unionByName(nxt)
        if short > 0:
            more = nodes.where(F.col("activation_step") == step).join(seen.select("id").unionByName(new.select("id")), "id", "left_anti")
            more = cut(more.orderBy(F.desc("followers"), "id").limit(short).select("id", F.lit(step).alias("depth")))
            into = hot.join(more.select(F.col("id").alias("target")), "target", "left_semi").groupBy("target").agg(F.min("source").alias("source"))
            links = links.unionByName(into.select("source", "target", F.lit(step).alias("depth")))
            new = new.unionByName(more)
        links, seen = cut(links), cut(seen.unionByName(new))
        front = new.select(F.col("id").alias("source"))
    off = cold.where(F.col("source") == seed).join(info, "target").orderBy(F.desc("followers"), "target").limit(idle)
    off = cut(off.select("source", "target"))
    rest = off.select(F.col("target").alias("id")).join(seen, "id", "left_anti").select("id", F.lit(None).cast("int").alias("depth"), F.lit("inactive").alias("role"))
    roles = seen.select("id", "depth", F.when(F.col("id") == seed, "seed").otherwise("active").alias("role"))
    shown = links.select("source", "target", "depth", F.lit(True).alias("fired")).unionByName(off.select("source", "target", F.lit(None).cast("int").alias("depth"), F.lit(False).alias("fired")))
    return roles.unionByName(rest), shown
