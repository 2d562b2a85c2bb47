"""A null model with the same degrees, and the significance of communities against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import communities, metrics
from .iterate import cut
from .statistics import numbered


#: A spread of savings up to this is that of rounding, and none.
SPREAD = 1e-12


def _shuffled(rows: DataFrame, seed: int, *cols: str) -> DataFrame:
    """Rows with a place in their graph, in an order given by a seeded hash (ranges of the hash are sorted apart)."""
    key = F.pmod(F.xxhash64(F.lit(seed), "g", *cols), F.lit(1 << 40))
    return cut(numbered(rows.withColumn("key", key), ["g"], "key").drop("key", "n"))


def configurations(edges: DataFrame, replicates: int, seed: int = 1) -> DataFrame:
    """(g, src, dst, weight): null graphs 1, 2, ... together: outgoing and incoming link ends matched at random; repeated pairs collapse, loops go, weights are dealt anew."""
    each = cut(edges.select("src", "dst", "weight").withColumn("g", F.explode(F.sequence(F.lit(1), F.lit(replicates)))))
    out = _shuffled(each.select("g", "src", "dst"), 3 * seed, "src", "dst").select("g", "src", "rn")
    into = _shuffled(each.select("g", "src", "dst"), 3 * seed + 1, "src", "dst").select("g", "dst", "rn")
    pairs = out.join(into, ["g", "rn"]).where("src <> dst").select("g", "src", "dst").distinct()
    placed = _shuffled(pairs, 3 * seed + 2, "src", "dst")
    weights = _shuffled(each, 3 * seed + 2, "dst", "src").select("g", "weight", "rn")
    return placed.join(weights, ["g", "rn"]).select("g", "src", "dst", "weight")


def configuration(edges: DataFrame, seed: int = 1) -> DataFrame:
    """One null graph (src, dst, weight)."""
    return configurations(edges, 1, seed).drop("g")


def savings(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(g, saved): how much shorter communities make the code of each graph: 1 - L / L of one module."""
    flow = cut(metrics.page_rank(edges, nodes))
    found = communities.flow_communities(edges, nodes, flow=flow)
    whole = nodes.select("g", "id", F.lit(0).cast("bigint").alias("community"))
    a, b = metrics.codelength(edges, flow, found).select("g", F.col("codelength").alias("l")), metrics.codelength(edges, flow, whole).select("g", F.col("codelength").alias("l1"))
    return a.join(b, "g").select("g", F.when(F.col("l1") > 0, 1 - F.col("l") / F.col("l1")).otherwise(0.0).alias("saved"))


def significance(edges: DataFrame, nodes: DataFrame, replicates: int = 5) -> DataFrame:
    """Real savings against null graphs: mean, deviation, z (infinite without spread), verdict z > 3.

    The real graph is number 0; it and all null graphs go through the same rounds.
    """
    real = edges.select(F.lit(0).alias("g"), "src", "dst", F.col("weight").cast("double").alias("weight"))
    all_edges = cut(real.unionByName(configurations(edges, replicates).withColumn("weight", F.col("weight").cast("double"))))
    all_nodes = cut(nodes.select("id").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(replicates)))))
    saved = savings(all_edges, all_nodes)
    null = F.when(F.col("g") > 0, F.col("saved"))
    stats = saved.agg(F.max(F.when(F.col("g") == 0, F.col("saved"))).alias("real"), F.avg(null).alias("null_mean"), F.stddev_pop(null).alias("null_std"))
    z: Column = F.when(F.col("null_std") > SPREAD, (F.col("real") - F.col("null_mean")) / F.col("null_std")).otherwise(F.lit(float("inf")))
    return stats.withColumn("z", z).withColumn("significant", F.col("z") > 3)
