"""Communities by merging modules of a graph that shrinks and by moving nodes: modularity and the map equation.

Merging: every module that gains by joining a neighbour offers its best merger; many are taken at once,
the merged modules become the nodes of a smaller graph, and so on until no merger gains.  Modules that
grow this way are connected.  Moving: every node that gains by another module offers its best move,
until a round of moves improves the objective by less than ``TOLERANCE`` of it.  In both

* a module whose best offer is one to come to it only takes in this round, one whose best offer is one to
  leave it only gives, so no two neighbours swap and what takes keeps what others come for;
* what a module is offered is weighed together: of all, and ever smaller shares of them (by a hash),
  it takes the set with the largest joint gain, or its best single one;
* the best offer of a graph is always taken.

Moves look at the frontier only, the movers of the last round and their neighbours; when it offers no
gain, all nodes are looked at once more.  Module sums come from node sums, which only change in the
frontier.  A round of moves after which the objective is not better is undone, and the next one takes single
movers only, the best of both their modules; if that does not help either, the graph is settled.

Only objectives and counts reach the driver.  A column ``g`` in edges and nodes keeps several graphs apart
that go through the same rounds together.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics
from .components import connected_components
from .iterate import cut, forget, rows_in, sized, with_graph

#: The least gain that counts: in modularity (of 1), or in bits.
LEAST = 1e-9
#: Moves end when a round improves the objective by less than this share of it.
TOLERANCE = 1e-3
#: A module takes all its movers, or a half, a quarter, ... of them.
SHARES = 6
#: Links are cut down to the frontier when it is at most this share of the nodes.
FEW = 0.25
#: Up to this many nodes all are looked at in each round.
MANY = 10_000
#: Mergers whose names are looked up in one plan.
STEPS = 8


def _plogp(x: Column) -> Column:
    """x log2 x of a number that is not negative."""
    return x * F.log2(F.greatest(x, F.lit(1e-300)))


@dataclass(frozen=True)
class Modularity:
    """Sums of nodes and modules: strength ``a``; links ``to`` and ``back`` are equal and all weights of a graph add up to 1."""

    gamma: float = 1.0

    def target(self, m: dict[str, Column], a: Column, x: Column) -> Column:
        """Gain of a module that takes nodes which change its flow out by ``x``."""
        return -self.gamma * a * (2 * m["a"] + a) - x

    def source(self, m: dict[str, Column], a: Column, b: Column, to: Column, back: Column) -> Column:
        """Gain of a module that loses a node, links included."""
        return self.gamma * a * (2 * m["a"] - a) - to - back + b

    def objective(self) -> Column:
        return F.sum(F.col("b") - F.col("q")) - self.gamma * F.sum(F.col("a") * F.col("a"))


@dataclass(frozen=True)
class Codelength:
    """Sums of nodes and modules: flow ``a`` and flow to other nodes or modules ``b``; links have the flow ``to`` and ``back``.  Gains are bits saved."""

    def target(self, m: dict[str, Column], a: Column, x: Column) -> Column:
        return self.part(m["a"], m["q"]) - self.part(m["a"] + a, m["q"] + x) + self.whole(m["all"], x)

    def source(self, m: dict[str, Column], a: Column, b: Column, to: Column, back: Column) -> Column:
        x = to + back - b
        return self.part(m["a"], m["q"]) - self.part(m["a"] - a, m["q"] + x) + self.whole(m["all"], x)

    @staticmethod
    def part(a: Column, q: Column) -> Column:
        q = F.greatest(q, F.lit(0.0))
        return _plogp(q + F.greatest(a, F.lit(0.0))) - 2 * _plogp(q)

    @staticmethod
    def whole(q: Column, x: Column) -> Column:
        return _plogp(q) - _plogp(F.greatest(q + x, F.lit(0.0)))

    def objective(self) -> Column:
        return -_plogp(F.sum("q")) - F.sum(self.part(F.col("a"), F.col("q")))


def _modules(state: DataFrame) -> DataFrame:
    """(g, community, a, b, q): sums of the nodes; ``q`` is what leaves the module."""
    return state.groupBy("g", "community").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("b") - F.col("inner")).alias("q"))


def _best(goal, options: DataFrame, ends: dict[str, DataFrame], sums: DataFrame) -> DataFrame:
    """(g, id, home, community, ...): for each node that gains, its best option (g, id, home, community, a, b, to, back, home_to, home_back)."""
    side = lambda name, a, q: ends[name].select("g", F.col("community").alias(name), F.col("a").alias(a), F.col("q").alias(q))
    options = options.join(side("community", "ta", "tq"), ["g", "community"]).join(side("home", "ha", "hq"), ["g", "home"]).join(sums, "g")
    source = goal.source({"a": F.col("ha"), "q": F.col("hq"), "all": F.col("all")}, F.col("a"), F.col("b"), F.col("home_to"), F.col("home_back"))
    x = F.col("b") - F.col("to") - F.col("back")
    gain = source + goal.target({"a": F.col("ta"), "q": F.col("tq"), "all": F.col("all")}, F.col("a"), x)
    options = options.select("g", "id", "home", "community", "a", x.alias("x"), source.alias("rest"), gain.alias("gain"), "ta", "tq", "all").where(F.col("gain") > LEAST)
    best = options.groupBy("g", "id").agg(F.max_by(F.struct("home", "community", "a", "x", "rest", "gain", "ta", "tq", "all"), F.struct("gain", "community")).alias("o"))
    return best.select("g", "id", "o.*")


def _taken(goal, offers: DataFrame, careful: list[int]) -> DataFrame:
    """(g, id, next): the offers that are taken, one at least in each graph that has some.

    A module whose best offer is one to come to it takes nodes, one whose best offer is one to leave it gives some.
    """
    u = F.pmod(F.xxhash64("id", "community", F.lit(7)), F.lit(1 << SHARES))
    key = F.struct("gain", F.xxhash64("id", "home", "community").alias("tie"), "id")
    ends = offers.select("g", F.explode(F.array(F.struct(F.col("home").alias("module"), key.alias("gives"), F.lit(None).alias("takes")), F.struct(F.col("community").alias("module"), F.lit(None).alias("gives"), key.alias("takes")))).alias("x"))
    roles = ends.select("g", "x.*").groupBy("g", "module").agg(F.max("gives").alias("gives"), F.max("takes").alias("takes"))
    roles = roles.select("g", "module", F.coalesce(F.col("takes").isNull() | (F.col("gives") > F.col("takes")), F.lit(False)).alias("giver"), F.col("gives.id").alias("leaves"), F.col("takes.id").alias("comes"))
    givers = roles.where("giver").select("g", F.col("module").alias("home"), "leaves")
    both = offers.join(givers, ["g", "home"]).join(roles.where("NOT giver").select("g", F.col("module").alias("community"), "comes"), ["g", "community"])
    if careful:  # single movers, the best of both their modules
        single = both.where(F.col("g").isin(careful) & (F.col("leaves") == F.col("id")) & (F.col("comes") == F.col("id")))
        both = both.where(~F.col("g").isin(careful))
    # a row for each share that an offer is in, two on average; the last is its module's best single one
    ranks = F.floor(SHARES - F.log2(u + 1.0)).cast("int")
    each = both.select("g", "community", "a", "x", "rest", "ta", "tq", "all", F.explode(F.sequence(F.lit(0), F.least(ranks, F.lit(SHARES - 1)))).alias("share"))
    sets = each.groupBy("g", "community", "share").agg(*[F.sum(c).alias(c) for c in ("a", "x", "rest")], *[F.max(c).alias(c) for c in ("ta", "tq", "all")])
    joint = F.col("rest") + goal.target({"a": F.col("ta"), "q": F.col("tq"), "all": F.col("all")}, F.col("a"), F.col("x"))
    sets = sets.select("g", "community", F.struct(joint.alias("gain"), (-F.col("share")).alias("back"), F.lit(None).cast(offers.schema["id"].dataType).alias("id")).alias("o"))
    alone = both.select("g", "community", F.struct(F.col("gain"), F.lit(-SHARES).alias("back"), "id").alias("o"))
    by = sets.unionByName(alone).groupBy("g", "community").agg(F.max("o").alias("o")).select("g", "community", F.col("o.id").alias("one"), (-F.col("o.back")).alias("share"))
    taken = both.withColumn("ranks", ranks).join(by, ["g", "community"]).where(F.when(F.col("one").isNotNull(), F.col("id") == F.col("one")).otherwise(F.col("ranks") >= F.col("share")))
    taken = taken.select("g", "id", F.col("community").alias("next"))
    return taken.unionByName(single.select("g", "id", F.col("community").alias("next"))) if careful else taken


COLUMNS = ("g", "id", "community", "a", "b", "inner", "active")


def _moved(goal, links: DataFrame, nodes: DataFrame, few: bool) -> DataFrame:
    """(g, id, community) where moves of nodes gain no more, beginning with the communities of ``nodes`` (g, id, community, a, b)."""
    state = cut(nodes.select("g", "id", "community", "a", "b", F.lit(0.0).alias("inner"), F.lit(True).alias("active")), few)
    size, full = rows_in(state), True
    before, scores, tried, careful, settled = None, {}, set(), set(), set()
    while size:
        some = links if full else links.join(state.where("active").select("g", F.col("id").alias("src")), ["g", "src"], "left_semi")
        around = cut(some.join(state.select("g", F.col("id").alias("dst"), "community"), ["g", "dst"]).groupBy("g", F.col("src").alias("id"), "community").agg(F.sum("to").alias("to"), F.sum("back").alias("back")), few)
        now = state.join(around, ["g", "id", "community"], "left").withColumn("inner", F.when(F.col("active"), F.coalesce("to", F.lit(0.0))).otherwise(F.col("inner")))
        now = cut(now.select(*COLUMNS, F.coalesce("back", F.lit(0.0)).alias("home_back")), few)
        modules = _modules(now)
        sums = modules.groupBy("g").agg(F.sum("q").alias("all"), goal.objective().alias("objective"))
        home = now.where("active").select("g", "id", F.col("community").alias("home"), "a", "b", F.col("inner").alias("home_to"), "home_back")
        options = around.join(home, ["g", "id"]).where("community <> home").where(~F.col("g").isin(sorted(settled)) if settled else F.lit(True))
        offers = cut(_best(goal, options, {"home": modules, "community": modules}, F.broadcast(sums.select("g", "all"))), few)
        found = sums.join(offers.groupBy("g").agg(F.count("*").alias("offers")), "g", "left").collect()
        score, gaining = {x["g"]: x["objective"] for x in found}, {x["g"] for x in found if x["offers"]}
        forget(around)

        if worse := sorted(g for g in tried if score[g] <= scores[g]):  # undone; what failed with single movers is settled
            settled |= careful & set(worse)
            careful = set(worse) - settled
            undone = now.where(~F.col("g").isin(worse)).select(*COLUMNS).unionByName(before.where(F.col("g").isin(worse)).select(*COLUMNS))
            state, full, tried = cut(undone.withColumn("active", F.lit(True)), few), True, set()
            forget(offers, now, before)
            before = None
            if settled == set(score):
                break
            continue
        careful -= tried
        settled |= {g for g in tried if score[g] - scores[g] < TOLERANCE * abs(score[g])}
        gaining -= settled
        scores |= score
        if before is not None:
            forget(before)
        before = now
        if not gaining:
            forget(offers)
            state = now.select(*COLUMNS[:-1], F.lit(True).alias("active"))
            if full:
                break
            state, full, tried = cut(state, few), True, set()
            continue
        taken = cut(_taken(goal, offers.where(F.col("g").isin(sorted(gaining))), sorted(careful)), few)
        # looked at next: the movers, their neighbours, and the nodes that gain but did not go
        near = links.join(taken.select("g", F.col("id").alias("dst")), ["g", "dst"], "left_semi").select("g", F.col("src").alias("id"))
        near = near.unionByName(taken.select("g", "id")).unionByName(offers.select("g", "id")).distinct().withColumn("near", F.lit(True))
        state = cut(now.join(taken, ["g", "id"], "left").join(near, ["g", "id"], "left").select("g", "id", F.coalesce("next", "community").alias("community"), "a", "b", "inner", F.coalesce("near", F.lit(False)).alias("active")), few)
        forget(offers, taken)
        tried = gaining  # the best offer of a graph is always taken
        full = size <= MANY or state.where("active").count() > FEW * size
        if full:
            state = state.withColumn("active", F.lit(True))
    return state.select("g", "id", "community")


def _contracted(links: DataFrame, nodes: DataFrame, part: DataFrame, few: bool) -> tuple[DataFrame, DataFrame]:
    """Links and nodes (g, id, a, b) of the graph whose nodes are the communities of a partition (g, id, community)."""
    end = lambda name, to: part.select("g", F.col("id").alias(name), F.col("community").alias(to))
    across = links.join(end("src", "ca"), ["g", "src"]).join(end("dst", "cb"), ["g", "dst"]).where("ca <> cb")
    less = cut(across.groupBy("g", F.col("ca").alias("src"), F.col("cb").alias("dst")).agg(F.sum("to").alias("to"), F.sum("back").alias("back")), few)
    out = less.groupBy("g", F.col("src").alias("id")).agg(F.sum("to").alias("b"))
    sums = nodes.select("g", "id", "a").join(part, ["g", "id"]).groupBy("g", F.col("community").alias("id")).agg(F.sum("a").alias("a"))
    return less, cut(sums.join(out, ["g", "id"], "left").select("g", "id", "a", F.coalesce("b", F.lit(0.0)).alias("b")), few)


def _merged(goal, links: DataFrame, nodes: DataFrame, part: DataFrame) -> DataFrame:
    """(g, id, community): a partition of the nodes whose communities merge until no merger gains."""
    whole, steps = cut(part.select("g", "id", "community")), []
    n = max(rows_in(links), rows_in(nodes))
    with sized(links.sparkSession, n) as few:
        links, nodes = _contracted(links, nodes, whole, few)
    while True:
        with sized(links.sparkSession, max(rows_in(links), rows_in(nodes))) as few:
            ends = nodes.select("g", F.col("id").alias("community"), "a", F.col("b").alias("q"))
            sums = nodes.groupBy("g").agg(F.sum("b").alias("all"))
            options = links.join(nodes.select("g", F.col("id").alias("src"), "a", "b"), ["g", "src"])
            options = options.select("g", F.col("src").alias("id"), F.col("src").alias("home"), F.col("dst").alias("community"), "a", "b", "to", "back", F.lit(0.0).alias("home_to"), F.lit(0.0).alias("home_back"))
            offers = cut(_best(goal, options, {"home": ends, "community": ends}, F.broadcast(sums)), few)
            if not rows_in(offers):
                return _followed(whole, steps)
            step = cut(nodes.select("g", "id").join(_taken(goal, offers, []), ["g", "id"], "left").select("g", "id", F.coalesce("next", "id").alias("community")), few)
            fewer = _contracted(links, nodes, step, few)
            forget(offers, links, nodes)
            links, nodes = fewer
        steps.append(step)
        if len(steps) == STEPS:
            whole, steps = _followed(whole, steps), []


def _followed(part: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """A partition (g, id, community) whose communities merged in some steps (g, id, community), one after the other."""
    if not steps:
        return part
    out = part
    for step in steps:
        out = out.join(step.select("g", F.col("id").alias("community"), F.col("community").alias("next")), ["g", "community"]).select("g", "id", F.col("next").alias("community"))
    out = cut(out)
    forget(part, *steps)
    return out


def _found(goal, links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(g, id, community): mergers from single nodes, then moves."""
    part = _merged(goal, links, nodes, nodes.select("g", "id", F.col("id").alias("community")))
    with sized(links.sparkSession, max(rows_in(links), rows_in(nodes))) as few:
        return _moved(goal, cut(links, True) if few else links, nodes.join(part, ["g", "id"]), few)


def _refined(goal, links: DataFrame, nodes: DataFrame, part: DataFrame) -> DataFrame:
    """(g, id, community): the connected pieces of what moved merge again."""
    return _merged(goal, links, nodes, cut(_pieces(links, part)))


def _pieces(links: DataFrame, part: DataFrame) -> DataFrame:
    """(g, id, community): the connected pieces of each community."""
    end = lambda name, to: part.select("g", F.col("id").alias(name), F.col("community").alias(to))
    inside = links.join(end("src", "ca"), ["g", "src"]).join(end("dst", "cb"), ["g", "dst"]).where("ca = cb")
    named = connected_components(inside.select(F.struct("g", F.col("src").alias("id")).alias("src"), F.struct("g", F.col("dst").alias("id")).alias("dst")), part.select(F.struct("g", "id").alias("id")))
    return named.select("id.g", "id.id", F.col("component.id").alias("community"))


def modularity_communities(edges: DataFrame, nodes: DataFrame, gamma: float = 1.0, refine: bool = False) -> DataFrame:
    """(id, community) by modularity on the undirected view.

    With ``refine`` no community is disconnected: after the moves each is cut into its connected pieces, which
    never lowers modularity, and pieces merge along links as long as that gains.
    """
    goal, links, start = _undirected(edges, nodes, gamma)
    part = _found(goal, links, start)
    return _named(_refined(goal, links, start, part) if refine else part, nodes)


def modularity_both(edges: DataFrame, nodes: DataFrame, gamma: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """G6 without and with ``refine``, which begins where the other ends: mergers and moves are made once."""
    goal, links, start = _undirected(edges, nodes, gamma)
    part = cut(_found(goal, links, start))
    return _named(part, nodes), _named(_refined(goal, links, start, part), nodes)


def _named(part: DataFrame, nodes: DataFrame) -> DataFrame:
    return part.select(*["g"] * ("g" in nodes.columns), "id", "community")


def _undirected(edges: DataFrame, nodes: DataFrame, gamma: float) -> tuple[Modularity, DataFrame, DataFrame]:
    """The objective, links (g, src, dst, to, back) and nodes (g, id, a, b) of the undirected view."""
    edges, nodes = with_graph(edges), with_graph(nodes)
    flip = edges.select("g", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    both = cut(edges.select("g", "src", "dst", "weight").unionByName(flip).groupBy("g", "src", "dst").agg(F.sum("weight").cast("double").alias("w")))
    total = both.groupBy("g").agg(F.sum("w").alias("all"))
    both = both.join(F.broadcast(total), "g").withColumn("w", F.col("w") / F.col("all"))
    sums = both.groupBy("g", F.col("src").alias("id")).agg(F.sum("w").alias("a"), F.sum(F.when(F.col("src") != F.col("dst"), F.col("w")).otherwise(0.0)).alias("b"))
    links = cut(both.where("src <> dst").select("g", "src", "dst", F.col("w").alias("to"), F.col("w").alias("back")))
    start = cut(nodes.select("g", "id").join(sums, ["g", "id"], "left").fillna(0.0, ["a", "b"]))
    return Modularity(gamma), links, start


def flow_communities(edges: DataFrame, nodes: DataFrame, flow: DataFrame | None = None) -> DataFrame:
    """(id, community) by moves that lower the codelength of a random walk on the directed graph."""
    flow, given = metrics.page_rank(edges, nodes) if flow is None else flow, nodes
    edges, nodes, flow = with_graph(edges), with_graph(nodes), with_graph(flow)
    out = edges.groupBy("g", "src").agg(F.sum("weight").alias("out"))
    walked = edges.where("src <> dst").join(out, ["g", "src"]).join(flow.withColumnRenamed("id", "src"), ["g", "src"]).select("g", "src", "dst", (F.col("flow") * F.col("weight") / F.col("out")).alias("f"))
    there = walked.select("g", "src", "dst", F.col("f").alias("to"), F.lit(0.0).alias("back"))
    here = walked.select("g", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("to"), F.col("f").alias("back"))
    links = cut(there.unionByName(here).groupBy("g", "src", "dst").agg(F.sum("to").alias("to"), F.sum("back").alias("back")))
    sums = links.groupBy("g", F.col("src").alias("id")).agg(F.sum("to").alias("b"))
    start = cut(nodes.select("g", "id").join(flow.withColumnRenamed("flow", "a"), ["g", "id"]).join(sums, ["g", "id"], "left").select("g", "id", "a", F.coalesce("b", F.lit(0.0)).alias("b")))
    return _named(_found(Codelength(), links, start), given)


def by_methods(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The flow, and the partitions of all three methods.

    On a graph of which one task takes a round (``sized``) jobs are short and cores idle, so flow and modularity go side by side.
    """
    spark = nodes.sparkSession

    def by_flow() -> tuple[DataFrame, DataFrame]:
        flow = cut(metrics.page_rank(edges, nodes))
        return flow, cut(flow_communities(edges, nodes, flow=flow))

    def by_modularity() -> list[DataFrame]:
        return [cut(part) for part in modularity_both(edges, nodes)]

    with sized(spark, max(2 * rows_in(edges), rows_in(nodes))) as few:  # settings are the session's; all rounds here are then of this size
        if few:
            with ThreadPoolExecutor(2) as pool:
                jobs = [pool.submit(inheritable_thread_target(spark)(f)) for f in (by_flow, by_modularity)]
                (flow, moved), (plain, refined) = (job.result() for job in jobs)
        else:
            (flow, moved), (plain, refined) = by_flow(), by_modularity()
    return flow, {"modularity": plain, "refined": refined, "flow": moved}


def split_disconnected(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Each connected piece of a community becomes one of its own (named by its smallest node)."""
    return _pieces(with_graph(edges.select("src", "dst")), with_graph(partition.select("id", "community"))).select("id", "community")
