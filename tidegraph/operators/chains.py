"""Reply and reblog chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .iterate import cut, forget, left_by


def depths(posts: DataFrame) -> DataFrame:
    """(id, root, depth) of every post that hangs on a root through posts that are not deleted.

    Pointers are doubled each round (a post's 2**k-th ancestor), so a chain of depth d takes
    log2(d) joins; there is no limit on depth or rows.  Posts that have arrived are not joined again.
    """
    live = posts.where("deleted_at IS NULL").select("id", F.coalesce("in_reply_to_id", "reblog_of_id").alias("parent"))
    known = live.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    linked = left_by(live, known, "parent", "id")
    # up: the ancestor reached so far (null: a root was reached, hops says how far); lost: the way up is broken
    state = linked.select("id", F.when(F.col("there"), F.col("parent")).alias("up"), (F.col("parent").isNotNull() & F.col("there").isNull()).alias("lost"))
    state = cut(state.select("id", "up", "lost", F.when(F.col("up").isNotNull(), 1).otherwise(0).alias("hops"), F.coalesce("up", "id").alias("top")))
    while not state.where("up IS NOT NULL").isEmpty():
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("lost").alias("next_lost"), F.col("hops").alias("more"), F.col("top").alias("next_top"))
        on = state.where("up IS NOT NULL").join(above, "up", "left").select(
            "id", F.col("next").alias("up"), (F.col("lost") | F.coalesce("next_lost", F.lit(False))).alias("lost"),
            (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.coalesce("next_top", "top").alias("top"),
        )
        last, state = state, cut(on.unionByName(state.where("up IS NULL")))
        forget(last)
    return state.where("NOT lost").select("id", F.col("top").alias("root"), (F.col("hops") + 1).alias("depth"))


def per_depth(chain: DataFrame) -> DataFrame:
    """Chains and posts by the depth of the chain."""
    roots = chain.groupBy("root").agg(F.max("depth").alias("depth"), F.count("*").alias("members"))
    return roots.groupBy("depth").agg(F.count("*").alias("chains"), F.sum("members").alias("posts"))


def summary(chain: DataFrame) -> DataFrame:
    """Number of chains, their mean and largest depth, and the share with more than one level."""
    roots = chain.groupBy("root").agg(F.max("depth").alias("depth"), F.count("*").alias("members"))
    return roots.agg(F.count("*").alias("chains"), F.sum("members").alias("posts"), F.avg("depth").alias("mean_depth"), F.max("depth").alias("max_depth"), (100.0 * F.count_if(F.col("depth") >= 2) / F.count("*")).alias("multi_pct"))


def conversation_chains(turns: DataFrame) -> DataFrame:
    """G14 on conversations: a turn answers the one before it; (conv_id, depth, members) of each chain."""
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    key = lambda c: F.when(F.col(c).isNotNull(), F.struct("conv_id", F.col(c).alias("turn")))
    linked = turns.withColumn("parent", before).select(key("turn").alias("id"), key("parent").alias("in_reply_to_id"))
    none = F.lit(None)
    found = depths(linked.withColumn("reblog_of_id", none.cast(linked.schema["id"].dataType)).withColumn("deleted_at", none.cast("timestamp")))
    return found.groupBy("root").agg(F.max("depth").alias("depth"), F.count("*").alias("members")).select("root.conv_id", "depth", "members")
