"""Weakly connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import cut, forget


#: Up to this many links one task holds them all, and the rounds need no shuffle (32 bytes each); more are dealt out.
FEW_LINKS = 100_000


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component): the smallest node id of each node's component.

    Every round replaces the graph by edges from nodes to smaller labels: each node links its
    neighbours to the smallest of them ("large star", then "small star"), which contracts
    long paths in a logarithmic number of rounds, until every node is linked to one label that is
    no node with a smaller one.  Nothing but the answer to that, and the number of links, reaches
    the driver.  Self loops, repeated edges and edges with a null end are allowed; the latter are ignored.
    """
    known = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    known = cut(known.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())  # the edges are computed once
    ids = known.select(F.explode(F.array("u", "v")).alias("id"))
    if nodes is not None:
        ids = ids.unionByName(nodes.select("id"))
    links = known.where("u <> v")
    n = links.count()
    if not n:
        return ids.distinct().select("id", F.col("id").alias("component"))
    if n <= FEW_LINKS:
        links = links.coalesce(1)
    two = lambda *pairs: F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])).alias("x")
    while True:
        # large star: a node's larger neighbours link to the smallest of it and its neighbours
        both = links.select(two(("u", "v"), ("v", "u"))).select("x.*")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least.withColumnRenamed("u", "own"), F.col("u") == F.col("own")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its smaller neighbours link to the smallest of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.withColumnRenamed("u", "own"), F.col("u") == F.col("own")).select(two(("v", "m"), ("u", "m"))).select("x.*")
        last, links = links, cut(small.where("u <> v").distinct())
        forget(last)
        ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("label")), F.struct(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("label")))).alias("x"))
        seen = ends.select("x.*").groupBy("id").agg(F.sum("up").alias("up"), F.max("label").alias("label"))
        if seen.where("up > 1 OR up > 0 AND label > 0").isEmpty():
            break
    return ids.distinct().join(links.select(F.col("u").alias("id"), "v"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))


def contracted(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(u, v): links with the same components, little more than one a node, for very many links among nodes few enough to broadcast.

    Each node links to the smallest of it and its neighbours, and a link becomes one between its ends' smallest: what
    "large star" does, but only minima by node and pairs of such minima are shuffled, no link by its ends.
    """
    known = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    known = cut(known)  # read twice, computed once
    ends = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")
    least = cut(known.select(ends).select("x.*").groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
    of = lambda end, into: F.broadcast(least.select(F.col("u").alias(end), F.col("m").alias(into)))
    among = known.where("u <> v").join(of("u", "a"), "u").join(of("v", "b"), "v").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    out = cut(least.select("u", F.col("m").alias("v")).unionByName(among).distinct())
    forget(known, least)
    return out
