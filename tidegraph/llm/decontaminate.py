"""Benchmark decontamination with SimHash and multi-index Hamming blocks, in DataFrame operations only.

Documents and benchmark items are sequences of lower-cased words.  A window of a document
that is as long as an item (in words) gets a 128-bit SimHash over its five-word shingles,
weighted by their counts.  Fingerprints are cut into 16 blocks of 8 bits: if two differ in at
most ``RADIUS`` = 39 bits, one of the first 8 blocks differs in at most two bits or one of the
others in at most one (three in each of the former and two in each of the latter make 40), so
joining every block on its value and its neighbours finds all fingerprints within the radius.
What is found is verified by the exact weighted Jaccard similarity of the shingles.  At the
similarity of 0.8 fingerprints differ in 19 bits on average (deviation 4), so a true match falls
out of the radius about once in two million.

Windows start only where the similarity can be reached: a window of similarity 0.8 shares at
least 0.8 / 1.8 of the shingles of both sides together, so it starts between the first and the
last place that holds so many of the document's shingles that some item of that length has.

Defined cases: null and empty texts, and texts and items of fewer than five words, have
no shingle and match nothing; a document shorter than an item is one window; repeated
rows of a document are one, rows with one id and different texts are each looked at, and so
are rows without an id (``matches`` names none of them, ``clean`` drops what leaks); an item
with several texts counts as its first by text; an empty benchmark matches nothing; of equally
similar windows of a document and item the first is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
RADIUS = 39
BLOCKS = 16
#: Bits that may differ inside a block, for the blocks of either half of the fingerprint.
FLIPS = (2, 1)
SIMILAR = 0.8
#: A frame of the benchmark with up to this many rows is broadcast, a larger one joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Up to this many texts with a common shingle are broadcast as keys (some thirty bytes each).
BROADCAST_KEYS = 500_000
#: Bits of each fingerprint half, and the width of a counter: two counters share a long.
HALF, LANE = 64, 31


def words(text: Column) -> Column:
    """Lower-case words: runs of letters, digits and marks."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\p{M}]+"), lambda w: w != "")


def shingles(texts: DataFrame, *keys: str) -> DataFrame:
    """(*keys, n_words, p, h): every five-word shingle of (*keys, text) rows with its place."""
    w = texts.select(*keys, words(F.col("text")).alias("w")).where(F.size("w") >= SHINGLE)
    every = w.select(*keys, "w", F.explode(F.sequence(F.lit(0), F.size("w") - SHINGLE)).alias("p"))
    return every.select(*keys, F.size("w").alias("n_words"), "p", F.xxhash64(*[F.col("w")[F.col("p") + i] for i in range(SHINGLE)]).alias("h"))


def simhash(rows: DataFrame, by: list[str]) -> DataFrame:
    """SimHash (``lo``, ``hi``) of each group of shingle rows: bits set in most of its shingles.

    Two bits are spread over a long of two 31-bit counters, so 64 sums count all 128 bits of
    groups of up to half a billion shingles.
    """
    spread = F.array(*[F.lit((b & 1) | (b >> 1) << LANE) for b in range(4)])
    sums = []
    for half in ("lo", "hi"):
        mixed = F.xxhash64("h", F.lit(half))
        for k in range(HALF // 2):
            two = F.shiftrightunsigned(mixed, 2 * k).bitwiseAND(F.lit(3)).cast("int")
            sums.append(F.sum(F.element_at(spread, two + 1)).alias(f"{half}{k}"))
    counted = rows.groupBy(*by).agg(F.count("*").alias("total"), *sums)

    ones = 1 + (1 << LANE)

    def bits(half: str) -> Column:
        def two(sums: Column, k: Column) -> Column:
            # the top bit of each counter of ``over`` tells whether twice its count exceeds the total
            over = sums * 2 + ((1 << LANE - 1) - 1 - F.col("total")) * ones
            set_bits = F.shiftrightunsigned(over, LANE - 1).bitwiseAND(F.lit(ones))
            pair = set_bits.bitwiseOR(F.shiftrightunsigned(set_bits, LANE - 1)).bitwiseAND(F.lit(3))
            return F.call_function("shiftleft", pair, 2 * k)

        pairs = F.transform(F.array(*[F.col(f"{half}{k}") for k in range(HALF // 2)]), two)
        return F.aggregate(pairs, F.lit(0).cast("long"), lambda out, x: out.bitwiseOR(x))

    return counted.select(*by, "total", bits("lo").alias("lo"), bits("hi").alias("hi"))


def with_blocks(marked: DataFrame) -> DataFrame:
    """A row for each block of each fingerprint: its number ``b`` and value ``v``."""
    values = F.array(*[F.shiftrightunsigned(F.col("lo" if n < 8 else "hi"), 8 * (n % 8)).bitwiseAND(F.lit(255)).cast("int") for n in range(BLOCKS)])
    return marked.select("*", F.posexplode(values).alias("b", "v"))


def flips(most: int) -> list[int]:
    """The ways to change up to so many bits of a block."""
    return [m for m in range(256) if m.bit_count() <= most]


def with_near_blocks(marked: DataFrame) -> DataFrame:
    """``with_blocks`` and the values of each block a few bits away."""
    masks = [F.array(*map(F.lit, flips(most))) for most in FLIPS]
    rows = with_blocks(marked).withColumnRenamed("v", "exact").withColumn("flip", F.explode(F.when(F.col("b") < 8, masks[0]).otherwise(masks[1])))
    return rows.withColumn("v", F.col("exact").bitwiseXOR(F.col("flip"))).drop("exact", "flip")


def window_starts(similar: float) -> Column:
    """Starts of windows that can be similar to an item, for the sorted places ``ps`` of shared shingles.

    With ``need`` shared shingles to be reached, a window holds the places i to i + need - 1 for
    some i; windows that hold the one before too belong to that i.
    """
    ours, theirs = F.col("long") - (SHINGLE - 1), F.col("size") - (SHINGLE - 1)
    need = F.greatest(F.lit(1), F.ceil((ours + theirs) * F.lit(similar / (1 + similar)) - 1e-9)).cast("int")
    first = F.sequence(F.lit(0), F.size("ps") - need)

    def spans(i: Column) -> Column:
        low = F.greatest(F.get("ps", i + need - 1) - ours + 1, F.coalesce(F.get("ps", i - 1) + 1, F.lit(0)), F.lit(0))
        high = F.least(F.get("ps", i), F.col("n_words") - F.col("long"))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.when(F.size("ps") >= need, F.flatten(F.transform(first, spans))).otherwise(F.array().cast("array<int>"))


def small(frame: DataFrame, rows: int) -> DataFrame:
    """``frame`` broadcast where its rows are few."""
    return F.broadcast(frame) if rows <= BROADCAST_ROWS else frame


def best_windows(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, similar: float) -> DataFrame:
    """(key, t, item, x): for each text (id and hash) and item that it holds its best window."""
    texts = docs.select(F.col(doc_id).alias("key"), "text").where("text IS NOT NULL").select("key", F.xxhash64("text").alias("t"), "text")
    known = items.select(F.col(item_id).alias("item"), F.col("text")).where(F.col("item").isNotNull()).groupBy("item").agg(F.min("text").alias("text"))
    bench = common.cut(shingles(known, "item").select("item", F.col("n_words").alias("size"), "h"))
    n_rows, n_items = bench.count(), bench.select("item").distinct().count()

    # places of shingles that some item of a length has, and windows where there are enough of them
    hits = shingles(texts, "key", "t").join(small(bench.select("h", "size").distinct(), n_rows), "h")
    hits = hits.groupBy("key", "t", "size", "n_words").agg(F.sort_array(F.collect_set("p")).alias("ps")).withColumn("long", F.least("size", "n_words"))
    windows = common.cut(hits.select("key", "t", "size", "long", F.explode(window_starts(similar)).alias("s")))

    # the shingles of those texts in order
    keys = windows.select("key", "t").distinct()
    few = F.broadcast if keys.count() <= BROADCAST_KEYS else (lambda x: x)
    same = lambda a, b: a["key"].eqNullSafe(b["key"]) & (a["t"] == b["t"])
    held = texts.join(few(keys), same(texts, keys), "left_semi").dropDuplicates(["key", "t"]).select("key", "t", words(F.col("text")).alias("w"))
    each = lambda p: F.xxhash64(*[F.get(F.col("w"), p + i) for i in range(SHINGLE)])
    near = common.cut(held.where(F.size("w") >= SHINGLE).select("key", "t", F.transform(F.sequence(F.lit(0), F.size("w") - SHINGLE), each).alias("hs")))

    def filled(w: DataFrame, by: list[str]) -> DataFrame:
        """A row for each shingle of each window; a text's windows meet its shingles in one row, so the rest needs no shuffle."""
        listed = w.groupBy("key", "t").agg(F.collect_set(F.struct(*by)).alias("x"))
        both = near.join(listed.toDF("key_x", "t_x", "x"), near["key"].eqNullSafe(F.col("key_x")) & (near["t"] == F.col("t_x"))).select("key", "t", "hs", F.explode("x").alias("x"))
        return both.select("key", "t", "x.*", F.explode(F.slice("hs", F.col("x.s") + 1, F.col("x.long") - (SHINGLE - 1))).alias("h"))

    marked = simhash(filled(windows, ["size", "long", "s"]), ["key", "t", "size", "long", "s"])
    targets = simhash(bench, ["item", "size"])
    near_blocks = sum(8 * len(flips(most)) for most in FLIPS)
    targets = with_near_blocks(targets).select("item", "size", F.col("lo").alias("item_lo"), F.col("hi").alias("item_hi"), "b", "v")
    probes = with_blocks(marked).select("key", "t", "size", "long", "s", "lo", "hi", "b", "v")
    apart = F.bit_count(F.col("lo").bitwiseXOR(F.col("item_lo"))) + F.bit_count(F.col("hi").bitwiseXOR(F.col("item_hi")))
    found = probes.join(small(targets, n_items * near_blocks), ["size", "b", "v"]).where(apart <= RADIUS).select("key", "t", "long", "s", "item").distinct()

    # exact weighted Jaccard of what was found
    ours = filled(found, ["long", "s", "item"]).groupBy("key", "t", "long", "s", "item", "h").agg(F.count("*").alias("n"))
    theirs = bench.groupBy("item", "h").agg(F.count("*").alias("m"))
    sizes = bench.groupBy("item").agg(F.count("*").alias("item_total"))
    both = ours.join(small(theirs, n_rows), ["item", "h"], "left").groupBy("key", "t", "long", "s", "item")
    both = both.agg(F.sum("n").alias("total"), F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("common"))
    scored = both.join(small(sizes, n_items), "item").withColumn("similarity", F.col("common") / (F.col("total") + F.col("item_total") - F.col("common")))
    return scored.where(F.col("similarity") >= similar).groupBy("key", "t", "item").agg(F.max(F.struct("similarity", (-F.col("s")).alias("back"), "long")).alias("x"))


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", similar: float = SIMILAR) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the best window of each document for each item it holds."""
    best = best_windows(docs.where(F.col(doc_id).isNotNull()), items, doc_id, item_id, similar).groupBy("key", "item").agg(F.max("x").alias("x"))
    return best.select(
        F.col("key").alias("doc_id"), F.col("item").alias("item_id"), F.col("x.similarity").alias("similarity"),
        (-F.col("x.back")).cast("long").alias("first_word"), F.col("x.long").cast("long").alias("n_words"),
    )


def clean(docs: DataFrame, items: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows whose text holds no benchmark item, columns unchanged."""
    leaked = best_windows(docs, items, "doc_id", "item_id", similar).select("key", "t").distinct().toDF("__tg_key", "__tg_t")
    return docs.join(leaked, docs["doc_id"].eqNullSafe(F.col("__tg_key")) & (F.xxhash64(docs["text"]) == F.col("__tg_t")), "left_anti")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items in all documents."""
    return matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, [x FOR x IN string_split_regex(lower(text), '[^\p{L}\p{N}\p{M}]+') IF x <> ''] AS w FROM documents WHERE text IS NOT NULL
), ds AS (
  SELECT doc_id, len(w) AS n, p, array_to_string(w[p + 1 : p + 5], ' ') AS h FROM (SELECT doc_id, w, unnest(range(len(w) - 4)) AS p FROM d WHERE len(w) >= 5)
), b AS (
  SELECT item_id, [x FOR x IN string_split_regex(lower(text), '[^\p{L}\p{N}\p{M}]+') IF x <> ''] AS w FROM benchmark WHERE text IS NOT NULL
), bs AS (
  SELECT item_id, len(w) AS size, array_to_string(w[p + 1 : p + 5], ' ') AS h FROM (SELECT item_id, w, unnest(range(len(w) - 4)) AS p FROM b WHERE len(w) >= 5)
), bt AS (
  SELECT item_id, size, count(*) AS total FROM bs GROUP BY ALL
), bc AS (
  SELECT item_id, h, count(*) AS m FROM bs GROUP BY ALL
), hit AS (
  SELECT DISTINCT doc_id, n, p, item_id, least(size, n) AS long FROM ds JOIN bs USING (h)
), win AS (
  SELECT DISTINCT doc_id, item_id, long, unnest(range(greatest(0, p - long + 5), least(p, n - long) + 1)) AS s FROM hit
), wc AS (
  SELECT doc_id, item_id, long, s, h, count(*) AS c FROM win JOIN ds USING (doc_id) WHERE p BETWEEN s AND s + long - 5 GROUP BY ALL
), j AS (
  SELECT doc_id, item_id, long, s, sum(c) AS total, sum(least(c, coalesce(m, 0))) AS shared FROM wc LEFT JOIN bc USING (item_id, h) GROUP BY ALL
), sim AS (
  SELECT doc_id, item_id, long, s, cast(shared AS double) / cast(j.total + bt.total - shared AS double) AS similarity FROM j JOIN bt USING (item_id)
)
SELECT doc_id, item_id, similarity, cast(s AS bigint) AS first_word, cast(long AS bigint) AS n_words FROM sim WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s, long) = 1
"""
