"""Near-duplicate documents with ProbMinHash, banding and exact verification.

A text is the bag of its five-word shingles, each weighted by its count.  Every shingle is a
Poisson process whose rate is its weight: its arrivals fall on random registers, each
register keeps the shingle of its earliest arrival, and a shingle's process stops at the
latest register time ("early termination").  Two texts agree in a register with
the probability Jaccard of their weighted shingles.  Bands of registers name buckets.

Copies (equal words) are one node, named by their smallest id.  In each bucket the smallest
node is a candidate partner of every other one; candidates whose registers agree often enough
are verified (weighted Jaccard of at least 0.8, computed exactly) and joined to components.
Candidates that agree in at least ``LIKE`` registers put their components into one group.
In a group of several components every node outside the largest component is then compared
exactly with every node of the other components: some first, whose links make the largest
component grow, then ever more of those that are still outside.  So is, in a bucket with nodes of
several groups, every node outside its largest group with the nodes of the others.  So every pair
that shares a bucket is compared or already in one class, at any size of bucket and group.

These comparisons run in blocks of leaders against chunks of members, through an index of the
leaders' shingles; only links are emitted, so no rows are made for the pairs of a group.  Their
work is the number of nodes that stay outside the largest component times the size of the group.

Defined cases: null texts and texts without words have equal (no) words and are copies of
each other; texts of one to four words are copies of equal ones only; repeated rows are
copies; rows with one id but several texts are one document, in the class of all its texts;
null ids get the class of their copies, or null; an empty table gives no rows; ties go to the
smallest id.  Ids may be of any type that can be ordered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators.components import connected_components

from . import common
from .decontaminate import words

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 25, 5
#: Leaders in a block, and members in a chunk that they are compared with.
LEADERS, CHUNK = 2048, 2000
#: Leaders of a group in the first round, and how many times more there are in each later one.
FIRST, GROW = 4096, 8
#: Registers that must agree before the first pairs are verified: 3.7 deviations below what 0.8 gives on
#: average.  What this leaves out is compared exactly with the rest of its group.
AGREE = 84
#: Registers that must agree for two texts to belong to one group of like texts.
LIKE = 55

_U = np.uint64
GOLDEN, MIX1, MIX2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
FACTORS = [_U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB), _U(0x8EBC6AF09C88C6E3), _U(0x589965CC75374CC3)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * MIX1
    x = (x ^ (x >> _U(27))) * MIX2
    return x ^ (x >> _U(31))


def shingles(word_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text and their counts."""
    w = word_hashes.view(np.uint64)
    n = len(w) - SHINGLE + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i, f in enumerate(FACTORS):
        h = (h ^ (h >> _U(29))) + w[i : i + n] * f
    return np.unique(mix(h), return_counts=True)


def signature(elements: np.ndarray, weights: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash: for each of ``m`` registers the element whose Poisson process arrives there first."""
    times, winners = np.full(m, np.inf), np.zeros(m, np.uint64)
    at, live, rate, step = np.zeros(len(elements)), elements, weights.astype(float), 0
    while len(live):
        ahead = max(1, (3 * m) // len(live)) if step == 0 else max(1, min(64, m // (2 * len(live))))
        no = np.arange(step + 1, step + 1 + ahead, dtype=np.uint64)
        x = mix(live[:, None] + no[None, :] * GOLDEN)
        t = -np.log(((x >> _U(12)) + _U(1)).astype(float) * 2.0**-52)
        if ahead > 1:
            t = np.cumsum(t, axis=1)
        t = at[:, None] + t / rate[:, None]
        register = (((x & _U(0xFFF)) * _U(m)) >> _U(12)).astype(np.int64).ravel()
        flat = t.ravel()
        near = np.flatnonzero(flat < times.max())
        near = near[np.argsort(-flat[near], kind="stable")]  # the earliest is written last
        new = np.full(m, -1, np.int64)
        new[register[near]] = near
        hit = np.flatnonzero(new >= 0)
        first = flat[new[hit]]
        hit, first = hit[first < times[hit]], first[first < times[hit]]
        times[hit], winners[hit] = first, live[new[hit] // ahead]
        step += ahead
        on = t[:, -1] < times.max()  # a process that is past the latest register has nothing to add
        at, live, rate = t[on, -1], live[on], rate[on]
    return winners


def band_keys(winners: np.ndarray) -> np.ndarray:
    """A 64-bit bucket name for each band of registers."""
    x = winners.reshape(BANDS, ROWS)
    h = np.arange(BANDS, dtype=np.uint64) * GOLDEN
    for k in range(ROWS):
        h = mix(h ^ x[:, k]) + FACTORS[k]
    return h.view(np.int64)


def packed(winners: np.ndarray) -> np.ndarray:
    """A byte of each register, eight to a number."""
    low = np.zeros(-(-len(winners) // 8) * 8, np.uint8)
    low[: len(winners)] = winners & _U(0xFF)
    return low.view(np.int64)


def agreeing(a: str, b: str) -> Column:
    """In how many registers two packed signatures agree: bytes of the xor that are 0."""
    apart = F.lit(0)
    for k in range(-(-BANDS * ROWS // 8)):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(mask)))
        apart = apart + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return F.lit(BANDS * ROWS) - apart


def expanded(word_hashes: np.ndarray) -> np.ndarray:
    """The bag of shingles as a sorted set: the k-th occurrence of a shingle is an element of its own."""
    h, n = shingles(word_hashes)
    if not len(h) or n.max() == 1:
        return h
    again = np.repeat(h, n)
    k = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
    return np.sort(np.where(k == 0, again, mix(again + k.astype(np.uint64) * GOLDEN)))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two expanded bags."""
    if not len(a) or not len(b):
        return 0.0
    c = np.sort(np.concatenate([a, b]))
    shared = int((c[1:] == c[:-1]).sum())
    return shared / (len(c) - shared)


def word_hashes(df: DataFrame) -> DataFrame:
    """(doc_id, key, w): a digest of each text's words, and the hashes of the words."""
    split = df.select("doc_id", words(F.col("text")).alias("ws"))
    return split.select("doc_id", F.unhex(F.md5(F.array_join("ws", " "))).alias("key"), F.transform("ws", lambda x: F.xxhash64(x)).alias("w"))


def id_type(docs: DataFrame) -> str:
    """The type of the ids, as text."""
    return docs.schema["doc_id"].dataType.simpleString()


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, key, bands, sig): each text's digest, its buckets (none under five words), its registers; ids pass through untouched."""
    longs = pa.list_(pa.int64())

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands, sig = [], []
            for w in common.lists(batch["w"]):
                h, n = shingles(w)
                registers = signature(h, n) if len(h) else None
                bands.append([] if registers is None else band_keys(registers))
                sig.append([] if registers is None else packed(registers))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], pa.array(bands, longs), pa.array(sig, longs)], names=["doc_id", "key", "bands", "sig"])

    return word_hashes(docs).mapInArrow(sketch, f"doc_id {id_type(docs)}, key binary, bands array<long>, sig array<long>")


def bags(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, bag): the expanded bag of shingles of each text of the named documents, as bytes."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bag = pa.array([expanded(w).tobytes() for w in common.lists(batch["w"])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], bag], names=["doc_id", "key", "bag"])

    some = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    out = word_hashes(some).mapInArrow(expand, f"doc_id {id_type(docs)}, key binary, bag binary")
    return out.dropDuplicates(["doc_id", "key"]).drop("key")


def verified(pairs: DataFrame, bag: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose bags have at least the similarity."""

    @F.pandas_udf("double")
    def jaccard(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similarity(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(x, y, strict=True)], dtype=float)

    left = bag.select(F.col("doc_id").alias("b"), F.col("bag").alias("bag_b"))
    right = bag.select(F.col("doc_id").alias("a"), F.col("bag").alias("bag_a"))
    both = pairs.join(left, "b").join(right, "a")
    return both.withColumn("similarity", jaccard.asNondeterministic()("bag_a", "bag_b")).where(F.col("similarity") >= similar).select("a", "b").distinct()


def near_classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, class_id), one row per row of ``docs``: the smallest id of the near-duplicates of each document."""
    docs = docs.select("doc_id", "text")
    seen = common.cut(sketches(docs))
    copies = seen.groupBy("key").agg(F.min("doc_id").alias("node"))
    placed = common.cut(seen.select("doc_id", "key").join(copies, "key").select("doc_id", "node"))
    several = placed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last")
    several = common.cut(several)
    one_id = None if several.isEmpty() else placed.join(several.drop("last"), "doc_id").select("a", F.col("node").alias("b")).where("a <> b").distinct()
    first = copies.select("key", F.col("node").alias("doc_id"))
    nodes = seen.where(F.size("bands") > 0).join(first, ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"]).select(F.col("doc_id").alias("node"), "bands", "sig")
    member = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1")
    inside = common.cut(member.join(shared, "bucket"))  # rows of buckets with company only
    sig = common.cut(nodes.join(inside.select("node").distinct(), "node", "left_semi").select("node", "sig"))

    # the smallest node of each bucket with every other one
    pairs = inside.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    pairs = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
    pairs = common.cut(pairs.select("a", "b", agreeing("sa", "sb").alias("agree")).where(F.col("agree") >= LIKE))
    ends = common.cut(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    bag = common.cut(bags(docs, ends.withColumnRenamed("node", "doc_id")))
    links = verified(pairs.where(F.col("agree") >= AGREE).select("a", "b"), bag, similar)
    links = common.cut(links if one_id is None else links.unionByName(one_id))
    found = common.cut(connected_components(links, src="a", dst="b"))

    # groups of several components that like texts link
    component_of = lambda end: found.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
    like = pairs.join(component_of("a"), "a", "left").join(component_of("b"), "b", "left").select(F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    groups = connected_components(common.cut(like.where("ca <> cb").distinct()), src="ca", dst="cb").select(F.col("id").alias("c"), F.col("component").alias("g"))
    groups = common.cut(groups)
    classed = ends.join(found.withColumnRenamed("id", "node"), "node", "left").select("node", F.coalesce("component", "node").alias("part")).join(groups.withColumnRenamed("c", "part"), "part")
    more = found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(contracted(classed.select("g", "node", "part"), bag, similar))

    # buckets with nodes of several groups; of buckets with the same nodes one is enough
    spots = inside.where("n > 2").select(F.col("bucket").alias("g"), "node")
    labels = spots.select("node").distinct().join(found.withColumnRenamed("id", "node"), "node", "left").select("node", F.coalesce("component", "node").alias("c"))
    labels = labels.join(groups.withColumnRenamed("g", "own"), "c", "left").select("node", F.coalesce("own", "c").alias("part"))
    spots = spots.join(common.cut(labels), "node")
    same = spots.groupBy("g").agg(F.count("*").alias("n"), F.min("part").alias("x"), F.max("part").alias("y"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("print")).where("x <> y")
    once = same.groupBy("n", "print", "x", "y").agg(F.min("g").alias("g")).select("g")
    spots = common.cut(spots.join(once, "g", "left_semi").select("g", "node", "part"))
    bag = common.cut(bags(docs, spots.select(F.col("node").alias("doc_id")).distinct()))
    found = connected_components(more.unionByName(worked_off(spots, outside(spots), bag, similar)), src="a", dst="b")
    return placed.join(found.withColumnRenamed("id", "node"), "node", "left").select("doc_id", F.coalesce("component", "node").alias("class_id"))


def outside(rows: DataFrame) -> DataFrame:
    """The rows (g, node, part) of groups of several parts that are not in their group's largest part."""
    parts = rows.groupBy("g", "part").agg(F.count("*").alias("n"))
    main = parts.groupBy("g").agg(F.count("*").alias("parts"), F.max(F.struct("n", "part")).alias("x")).where("parts > 1").select("g", F.col("x.part").alias("main"))
    return rows.join(main, "g").where("part <> main").drop("main")


def contracted(rows: DataFrame, bag: DataFrame, similar: float) -> DataFrame:
    """The links (a, b) that join all components that like nodes of a group (g, node, part) belong to; ``part`` is the component.

    Rounds of leaders, more in each: links join components, so fewer nodes stay outside the
    largest one.  A node that led once was compared with its whole group.
    """
    rows = common.cut(rows.distinct())
    out, most = rows.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0), FIRST
    done = rows.select("g", "node").limit(0)
    while True:
        open_ = common.cut(outside(rows).join(done, ["g", "node"], "left_anti"))
        if open_.isEmpty():
            return out
        count = open_.groupBy("g").agg(F.ceil(F.count("*") / most).alias("lots"))
        led = common.cut(open_.join(count, "g").where(F.pmod(F.xxhash64("node", F.lit(most)), F.col("lots")) == 0).select("g", "node", "part"))
        links = worked_off(rows.join(led.select("g").distinct(), "g", "left_semi"), led, bag, similar, "part")
        out = out.unionByName(links)
        done = done.unionByName(led.select("g", "node"))
        if not links.isEmpty():
            of = rows.select("node", "part").distinct()
            ends = links.join(of.toDF("a", "pa"), "a").join(of.toDF("b", "pb"), "b").select("pa", "pb").distinct()
            joined = connected_components(ends, src="pa", dst="pb").toDF("part", "whole")
            rows = common.cut(rows.join(joined, "part", "left").select("g", "node", F.coalesce("whole", "part").alias("part")))
        most *= GROW


def worked_off(rows: DataFrame, leaders: DataFrame, bag: DataFrame, similar: float, by: str = "node") -> DataFrame:
    """The links (a, b) of leaders with the nodes of other parts of their group, both (g, node, part).

    Large groups are dealt over blocks of leaders and chunks of members, each pair of which is a
    task's unit; small groups share units.  A link is emitted only if it joins what no link of the
    unit has joined yet (nodes, or ``by="part"`` parts that are components), so a unit emits fewer
    links than it has nodes.
    """
    groups = rows.groupBy("g").agg(F.count("*").alias("size")).join(leaders.groupBy("g").agg(F.count("*").alias("led")), "g")
    groups = groups.select("g", "size", F.ceil(F.col("led") / LEADERS).cast("int").alias("blocks"), F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks"))
    groups = common.cut(groups)
    dealt = lambda df: df.join(groups, "g").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    units = max(8, (groups.agg(F.sum(F.col("size") * F.col("blocks"))).collect()[0][0] or 0) // CHUNK)
    unit = F.pmod(F.xxhash64("g", "block", "chunk"), F.lit(units))
    bags_of = bag.withColumnRenamed("doc_id", "node")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = dealt(rows).withColumn("block", every("blocks")).withColumn("unit", unit).select("unit", "g", "block", "chunk", "node", "part").join(bags_of, "node")
    heads = dealt(leaders).withColumn("chunk", every("chunks")).withColumn("head_unit", unit).select("head_unit", "g", "block", "chunk", "node", "part").join(bags_of, "node")
    key = ["g", "block", "chunk"]

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b, led = [], [], dict(list(right.groupby(key)))
        for k, own in left.groupby(key):
            head = led.get(k)
            if head is None:
                continue
            bags_h = [np.frombuffer(x, np.uint64) for x in head["bag"]]
            size_h, part_h, node_h = np.array([len(x) for x in bags_h]), head["part"].to_numpy(), head["node"].to_numpy()
            flat = np.concatenate(bags_h)
            who = np.repeat(np.arange(len(bags_h)), size_h)
            order = np.argsort(flat, kind="stable")
            flat, who = flat[order], who[order]
            over: dict = {}

            def root(x, over=over):
                while (up := over.get(x, x)) != x:
                    over[x] = x = over.get(up, up)
                return x

            name_h = head[by].tolist()
            for node, part, x in zip(own["node"], own["part"], own["bag"], strict=True):
                x = np.frombuffer(x, np.uint64)
                lo, hi = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
                n = hi - lo
                hit = who[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                shared = np.bincount(hit, minlength=len(size_h))
                ok = np.flatnonzero((shared >= similar * (size_h + len(x) - shared)) & (part_h != part))
                own_name = part if by == "part" else node
                for i in ok:
                    r, q = root(own_name), root(name_h[i])
                    if r != q:
                        over[r] = q
                        a.append(min(node, node_h[i]))
                        b.append(max(node, node_h[i]))
        return pd.DataFrame({"a": a, "b": b})

    ids = rows.schema["node"].dataType.simpleString()
    names = [*key, "node", "part", "bag"]
    heads = heads.select("head_unit", *names).toDF("head_unit", *names)  # columns of its own beside those of the members
    found = members.select("unit", *names).groupBy("unit").cogroup(heads.groupBy("head_unit")).applyInPandas(compare, f"a {ids}, b {ids}")
    return common.cut(found.distinct())


def one_of_each(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The first document (by id) of each class, columns unchanged; of rows with one id that of the smallest text stays, rows without id all do."""
    classes = near_classes(docs, similar)
    keep = classes.where("doc_id = class_id").groupBy(F.col("doc_id").alias("__tg_id")).agg(F.count("*").alias("__tg_n"))
    kept = docs.join(keep, docs["doc_id"] == F.col("__tg_id"))
    once = kept.where("__tg_n = 1").select(*docs.columns)
    row = F.struct(*docs.columns)
    again = kept.where("__tg_n > 1").groupBy("__tg_id").agg(F.min_by(row, F.coalesce("text", F.lit(""))).alias("__tg_row")).select("__tg_row.*")
    return once.unionByName(again).unionByName(docs.where(docs["doc_id"].isNull()))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document; the document with the class's own id is the one to keep."""
    found = near_classes(common.table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
