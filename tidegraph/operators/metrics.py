"""Flow and quality of a partition of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .iterate import cut, forget, rows_in, sized, with_graph


#: Links of one source that are laid out in one row; hubs have several rows.
LINKS_A_ROW = 4096
#: Pushes in one plan, between two written tables.
PUSHES = 4


def _laid_out(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(g, id, first, links): the links of each node with the share of its weight, once by source; ``first`` marks one row of each node."""
    out = edges.groupBy("g", "src").agg(F.sum("weight").alias("out"), F.count("*").alias("n"))
    row = F.pmod(F.xxhash64("dst"), F.ceil(F.col("n") / LINKS_A_ROW))
    rows = edges.join(out, ["g", "src"]).groupBy("g", F.col("src").alias("id"), row.alias("row")).agg(F.collect_list(F.struct("dst", (F.col("weight") / F.col("out")).alias("p"))).alias("links"))
    firsts = nodes.select("g", "id", F.lit(0).cast("long").alias("row"))
    return rows.join(firsts, ["g", "id", "row"], "full_outer").select("g", "id", (F.col("row") == 0).alias("first"), F.coalesce("links", F.array().cast(rows.schema["links"].dataType)).alias("links"))


def page_rank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, tolerance: float = 1e-12) -> DataFrame:
    """(id, flow): stationary flow by weighted links, with the flow of dead ends spread evenly.

    Spreading dead ends evenly only rescales the flow without it, so that one is solved for and scaled
    to 1.  Residuals are pushed along the links, which lie by source and do not move; a node whose
    residual is under its share of the tolerance keeps it.  ``PUSHES`` pushes make one plan and one
    written table, after which the residual that shrinks evenly, along the last push, is summed
    up to its limit at once.  It ends when all residuals that are left add up to no more than the
    tolerance, as a share of the whole flow; there is no limit to the rounds.  With a column ``g`` in both frames
    all graphs are solved together, and each gives a flow of 1.
    """
    with sized(nodes.sparkSession, max(rows_in(edges), rows_in(nodes))) as few:
        return _ranked(edges, nodes, damping, tolerance, few)


def _ranked(edges: DataFrame, nodes: DataFrame, damping: float, tolerance: float, few: bool) -> DataFrame:
    batched = "g" in nodes.columns
    edges, nodes = with_graph(edges), with_graph(nodes)
    spark = nodes.sparkSession
    sizes = nodes.groupBy("g").agg(F.count("*").alias("size"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(_laid_out(edges, nodes), few)
    links = rows.repartition(parts, "g", "id").persist()
    start = nodes.join(F.broadcast(sizes), "g")
    zero = F.lit(0.0)
    state = cut(start.select("g", "id", (1.0 / F.col("size")).alias("share"), zero.alias("y"), (1.0 / F.col("size")).alias("r"), zero.alias("prev")), few)
    small = tolerance * (1 - damping) / 4

    def push(state: DataFrame) -> DataFrame:
        goes = F.abs("r") > small * F.col("share")
        own = F.array(F.struct("id", F.col("share"), (F.col("y") + F.when(goes, F.col("r")).otherwise(0.0)).alias("y"), F.when(goes, 0.0).otherwise(F.col("r")).alias("r"), F.col("r").alias("prev")))
        sent = F.transform("links", lambda x: F.struct(x["dst"].alias("id"), zero.alias("share"), zero.alias("y"), (damping * F.col("r") * x["p"]).alias("r"), zero.alias("prev")))
        none = F.slice(own, 1, 0)
        each = F.concat(F.when(F.col("first"), own).otherwise(none), F.when(goes, sent).otherwise(none))
        told = state.join(links, ["g", "id"]).select("g", F.explode(each).alias("x")).select("g", "x.*")
        return told.groupBy("g", "id").agg(F.sum("share").alias("share"), F.sum("y").alias("y"), F.sum("r").alias("r"), F.sum("prev").alias("prev"))

    written = state
    while True:
        for _ in range(PUSHES):
            state = push(state)
        state = cut(state, few)
        forget(written)
        written = state
        product = lambda a, b: F.sum(F.col(a) * F.col(b))
        sums = state.groupBy("g").agg(F.sum("y").alias("y"), F.sum(F.abs("r")).alias("left"), product("r", "r").alias("rr"), product("r", "prev").alias("rp"), product("prev", "prev").alias("pp")).collect()
        if all(x["left"] <= tolerance * (1 - damping) * x["y"] for x in sums):
            break
        # y + a * pushed has the residual (1 + a) * r - a * prev, least for this a
        along = {x["g"]: x["rp"] / x["pp"] if x["pp"] else 0.0 for x in sums}
        better = {x["g"]: k / (1 - k) for x in sums if 0 < (k := along[x["g"]]) < 1 and max(x["rr"] - k * x["rp"], 0.0) < x["rr"] * (1 - k) ** 2}
        if better:
            a = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in better.items() for v in kv]), F.col("g")), zero)
            pushed = F.when(F.abs("prev") > small * F.col("share"), F.col("prev")).otherwise(0.0)
            state = state.select("g", "id", "share", (F.col("y") + a * pushed).alias("y"), ((1 + a) * F.col("r") - a * F.col("prev")).alias("r"), "prev")
    links.unpersist()
    forget(rows)
    total = state.groupBy("g").agg(F.sum("y").alias("total"))
    return state.join(F.broadcast(total), "g").select(*["g"] * batched, "id", (F.col("y") / F.col("total")).alias("flow"))


def plogp(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))


def codelength(edges: DataFrame, flow: DataFrame, partition: DataFrame) -> DataFrame:
    """Bits to describe a random walk with one codebook for each module of a given partition (no optimisation).

    A module's exit flow is that of its links to other modules; teleports are not coded.  With a column ``g`` in
    all three there is a row for each graph.
    """
    batched = "g" in partition.columns
    edges, flow, partition = with_graph(edges), with_graph(flow), with_graph(partition)
    out = edges.groupBy("g", "src").agg(F.sum("weight").alias("out"))
    a = partition.select("g", F.col("id").alias("src"), F.col("community").alias("ca"))
    b = partition.select("g", F.col("id").alias("dst"), F.col("community").alias("cb"))
    walked = edges.join(out, ["g", "src"]).join(flow.withColumnRenamed("id", "src"), ["g", "src"]).join(a, ["g", "src"]).join(b, ["g", "dst"])
    leaves = walked.where("ca <> cb").groupBy("g", F.col("ca").alias("community")).agg(F.sum(F.col("flow") * F.col("weight") / F.col("out")).alias("leave"))
    module = flow.join(partition, ["g", "id"]).groupBy("g", "community").agg(F.sum("flow").alias("p"), F.sum(plogp(F.col("flow"))).alias("node_plogp"))
    rows = module.join(leaves, ["g", "community"], "left").withColumn("q", F.coalesce("leave", F.lit(0.0)))
    one = rows.groupBy("g").agg(F.sum("q").alias("q"), F.sum(plogp(F.col("q"))).alias("qlogq"), F.sum(plogp(F.col("q") + F.col("p"))).alias("plogp"), F.sum("node_plogp").alias("nodes"), F.count("*").alias("modules"))
    return one.select(*["g"] * batched, "modules", (plogp(F.col("q")) - 2 * F.col("qlogq") - F.col("nodes") + F.col("plogp")).alias("codelength"))


def modularity(edges: DataFrame, partition: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Modularity on the undirected view; both directions of a pair add up."""
    a = partition.select(F.col("id").alias("src"), F.col("community").alias("ca"))
    b = partition.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    between = edges.where("src <> dst").join(a, "src").join(b, "dst").groupBy("ca", "cb").agg(F.sum("weight").alias("weight"))
    both = cut(between)  # the edges are computed once
    inside = both.agg(F.coalesce(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight"))), F.lit(0)).alias("inside"), F.sum("weight").alias("m"))
    ends = both.select(F.col("ca").alias("c"), "weight").unionByName(both.select(F.col("cb").alias("c"), "weight"))
    squares = ends.groupBy("c").agg(F.sum("weight").cast("double").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("squares"))
    q = F.col("inside") / F.col("m") - gamma * F.col("squares") / (4.0 * F.col("m") * F.col("m"))
    return inside.crossJoin(squares).select(F.coalesce(q, F.lit(0.0)).alias("modularity"))


def intra(edges: DataFrame, partition: DataFrame, factor: float = 3.0) -> DataFrame:
    """Share of distinct undirected pairs inside communities, the share that chance gives, and whether it is passed by a factor."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    a = partition.select(F.col("id").alias("src"), F.col("community").alias("ca"))
    b = partition.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    seen = pairs.join(a, "src").join(b, "dst").agg(F.count("*").alias("pairs"), F.count_if(F.col("ca") == F.col("cb")).alias("inside"))
    sizes = partition.groupBy("community").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum("n").alias("all"))
    one = seen.crossJoin(sizes).select("pairs", F.when(F.col("pairs") > 0, 100.0 * F.col("inside") / F.col("pairs")).otherwise(0.0).alias("intra_pct"), (100.0 * F.col("squares") / (F.col("all") * F.col("all"))).alias("expected_pct"))
    return one.withColumn("passes", F.col("intra_pct") >= factor * F.col("expected_pct"))


def containment(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Share of the weight inside communities; communities, and the share of nodes in the largest."""
    a = partition.select(F.col("id").alias("src"), F.col("community").alias("ca"))
    b = partition.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    w = edges.join(a, "src").join(b, "dst").agg(F.sum("weight").alias("all"), F.coalesce(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight"))), F.lit(0)).alias("inside"))
    sizes = partition.groupBy("community").agg(F.count("*").alias("n")).agg(F.count("*").alias("communities"), (100.0 * F.max("n") / F.sum("n")).alias("largest_pct"))
    return w.crossJoin(sizes).select(F.when(F.col("all") > 0, 100.0 * F.col("inside") / F.col("all")).otherwise(0.0).alias("containment_pct"), "communities", "largest_pct")


def sizes(partition: DataFrame) -> DataFrame:
    """Communities by size rank (one row per community)."""
    from pyspark.sql import Window

    n = partition.groupBy("community").agg(F.count("*").alias("size"))
    return n.select("community", "size", F.row_number().over(Window.orderBy(F.desc("size"), "community")).alias("rank"))


def mutual_information(x: DataFrame, y: DataFrame) -> DataFrame:
    """Normalised mutual information of two partitions of the same nodes; 1 when neither has any entropy."""
    both = x.select("id", F.col("community").alias("a")).join(y.select("id", F.col("community").alias("b")), "id")
    joint = cut(both.groupBy("a", "b").agg(F.count("*").cast("double").alias("n")))
    ma, mb = joint.groupBy("a").agg(F.sum("n").alias("na")), joint.groupBy("b").agg(F.sum("n").alias("nb"))
    total = joint.agg(F.sum("n").alias("all"))
    mi = joint.join(ma, "a").join(mb, "b").crossJoin(total).agg(F.sum(F.col("n") / F.col("all") * F.ln(F.col("n") * F.col("all") / (F.col("na") * F.col("nb")))).alias("mi"))
    entropy = lambda m, c, name: m.crossJoin(total).agg((-F.sum(F.col(c) / F.col("all") * F.ln(F.col(c) / F.col("all")))).alias(name))
    one = mi.crossJoin(entropy(ma, "na", "ha")).crossJoin(entropy(mb, "nb", "hb"))
    return one.select(F.when(F.col("ha") + F.col("hb") > 1e-12, 2 * F.col("mi") / (F.col("ha") + F.col("hb"))).otherwise(1.0).alias("nmi"))


def agreements(partitions: dict[str, DataFrame]) -> DataFrame:
    """(x, y, nmi) of every two of the partitions of the same nodes, both ways and with themselves, from one pass over their joint counts."""
    names, wide = list(partitions), None
    for name, p in partitions.items():
        one = p.select("id", F.col("community").alias(name))
        wide = one if wide is None else wide.join(one, "id")
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(x).alias("a"), F.col(y).alias("b")) for x in names for y in names])).alias("p")
    joint = cut(wide.select(pairs).select("p.*").groupBy("x", "y", "a", "b").agg(F.count("*").cast("double").alias("n")))
    total = joint.groupBy("x", "y").agg(F.sum("n").alias("all"))
    ma, mb = joint.groupBy("x", "y", "a").agg(F.sum("n").alias("na")), joint.groupBy("x", "y", "b").agg(F.sum("n").alias("nb"))
    mi = joint.join(ma, ["x", "y", "a"]).join(mb, ["x", "y", "b"]).join(total, ["x", "y"]).groupBy("x", "y").agg(F.sum(F.col("n") / F.col("all") * F.ln(F.col("n") * F.col("all") / (F.col("na") * F.col("nb")))).alias("mi"))
    entropy = lambda m, c, h: m.join(total, ["x", "y"]).groupBy("x", "y").agg((-F.sum(F.col(c) / F.col("all") * F.ln(F.col(c) / F.col("all")))).alias(h))
    both = mi.join(entropy(ma, "na", "ha"), ["x", "y"]).join(entropy(mb, "nb", "hb"), ["x", "y"])
    return both.select("x", "y", F.when(F.col("ha") + F.col("hb") > 1e-12, 2 * F.col("mi") / (F.col("ha") + F.col("hb"))).otherwise(1.0).alias("nmi"))


def method_table(edges: DataFrame, flow: DataFrame, partitions: dict[str, DataFrame]) -> DataFrame:
    """Each method's communities, modularity, containment, expected share, largest share and codelength, its agreement with the others, and what it wins.

    Highest modularity and containment and shortest codelength win; methods that tie all win.
    """
    out = None
    for name, p in partitions.items():
        row = modularity(edges, p).crossJoin(containment(edges, p)).crossJoin(intra(edges, p).select("intra_pct", "expected_pct")).crossJoin(codelength(edges, flow, p).select("codelength"))
        row = row.withColumn("method", F.lit(name))
        out = row if out is None else out.unionByName(row)
    out = cut(out)
    best = out.agg(F.max("modularity").alias("__q"), F.max("containment_pct").alias("__c"), F.min("codelength").alias("__l"))
    wins = [(F.col("modularity") == F.col("__q")).alias("best_modularity"), (F.col("containment_pct") == F.col("__c")).alias("best_containment"), (F.col("codelength") == F.col("__l")).alias("best_codelength")]
    near = agreements(partitions).groupBy(F.col("x").alias("method")).agg(*[F.max(F.when(F.col("y") == n, F.col("nmi"))).alias(f"nmi_{n}") for n in partitions])
    return out.crossJoin(best).select(*out.columns, *wins).join(near, "method")
