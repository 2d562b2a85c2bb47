"""Aggregates over scores, posts and accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions import scores as S

from .iterate import cut


def rows_of(spark, values: list, schema: str) -> DataFrame:
    """A small fixed frame, such as all bins of a histogram."""
    return spark.createDataFrame(values, schema)


def counts(posts: DataFrame, follows: DataFrame) -> DataFrame:
    """A1: posts that are not deleted, and follows."""
    return posts.where("deleted_at IS NULL").agg(F.count("*").alias("posts")).crossJoin(follows.agg(F.count("*").alias("follows")))


def accounts_by_bot(accounts: DataFrame) -> DataFrame:
    """A2: accounts by bot flag, both flags always present, and their share."""
    both = rows_of(accounts.sparkSession, [(False,), (True,)], "bot boolean")
    n = both.join(accounts.groupBy("bot").agg(F.count("*").alias("n")), "bot", "left").select("bot", F.coalesce("n", F.lit(0)).alias("n"))
    return n.crossJoin(accounts.agg(F.count("*").alias("total"))).select("bot", "n", F.when(F.col("total") > 0, 100.0 * F.col("n") / F.col("total")).otherwise(0.0).alias("pct"))


def languages(posts: DataFrame) -> DataFrame:
    """A3: the languages of posts that are not deleted."""
    return posts.where("deleted_at IS NULL AND language IS NOT NULL").select("language").distinct().orderBy("language")


def progress(eligible: DataFrame, worthy: DataFrame | None, done: DataFrame, languages: tuple[str, ...] | None = None) -> DataFrame:
    """A4: eligible posts, check-worthy ones among them (all, without a cache), done ones, completion."""
    if languages is not None:
        eligible = eligible.where(F.col("language").isin(*languages))
    target = eligible if worthy is None else eligible.join(worthy.select("id"), "id", "left_semi")
    n = eligible.agg(F.count("*").alias("eligible")).crossJoin(target.agg(F.count("*").alias("worthy"))).crossJoin(done.agg(F.count("*").alias("done")))
    n = n.withColumn("denominator", F.greatest("done", "worthy"))
    return n.withColumn("pct", F.when(F.col("denominator") > 0, 100.0 * F.col("done") / F.col("denominator")).otherwise(0.0))


def histogram(scores: DataFrame, bins: int = 5, column: str = "probability") -> DataFrame:
    """A5: probabilities by bin, all bins present; NaN and null scores are absent."""
    p = S.present(F.col(column))
    n = scores.select(p.alias("p")).where("p IS NOT NULL").groupBy(S.bin_of(F.col("p"), bins).alias("bin")).agg(F.count("*").alias("n"))
    every = scores.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def _ranges(rows: DataFrame, *cols: str) -> DataFrame:
    """``rows`` sorted into ranges of sampled width, the range's number in ``__b``; written, so that every use sees the same ranges."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(n, *cols).withColumn("__b", F.spark_partition_id()))


def elements(rows: DataFrame, column: str, places: dict[str, Column]) -> DataFrame:
    """The elements of the sorted values at some places (from 0; expressions of their number ``n``), one row.

    Equal values are counted first, then running counts are taken within ranges of values and
    offset by the ranges before, so neither a hot value nor all values meet in one task.
    """
    by = _ranges(rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("m")), "v")
    sizes = by.groupBy("__b").agg(F.sum("m").alias("s"))
    before = F.sum("s").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))  # one row for each range
    offsets = sizes.select("__b", F.coalesce(before, F.lit(0)).alias("o"))
    upto = F.sum("m").over(Window.partitionBy("__b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    run = by.withColumn("upto", upto).join(offsets, "__b").withColumn("upto", F.col("upto") + F.col("o"))
    run = run.crossJoin(sizes.agg(F.sum("s").alias("n")))
    at = lambda k: (F.col("upto") > k) & (F.col("upto") - F.col("m") <= k)
    return run.agg(*[F.max(F.when(at(k), F.col("v"))).alias(name) for name, k in places.items()])


def upper_median(rows: DataFrame, column: str, name: str) -> DataFrame:
    """The element at place n div 2 of the sorted values."""
    return elements(rows, column, {name: F.floor(F.col("n") / 2)})


def quantiles(rows: DataFrame, column: str, wanted: dict[str, float]) -> DataFrame:
    """Exact quantiles, one row, interpolated between neighbours."""
    places = {}
    for name, q in wanted.items():
        at = F.lit(q) * (F.col("n") - 1)
        places |= {f"{name}__lo": F.floor(at), f"{name}__hi": F.ceil(at), f"{name}__n": F.lit(0)}
    n = rows.where(F.col(column).isNotNull()).agg(F.count("*").alias("n"))
    got = elements(rows, column, places).crossJoin(n)
    part = lambda q: F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1))
    return got.select(*[(F.col(f"{name}__lo") * (1 - part(q)) + F.col(f"{name}__hi") * part(q)).alias(name) for name, q in wanted.items()])


def descriptive(scores: DataFrame) -> DataFrame:
    """Count; mean, median, population deviation, min and max of the probability in percent; criterion mean, min, max; mean tokens."""
    p = S.present(F.col("probability"))
    rows = scores.withColumn("p", p).where("p IS NOT NULL").withColumn("c", S.present(F.col("criterion")))
    one = rows.agg(
        F.count("*").alias("n"), (F.avg("p") * 100).alias("mean"), (F.stddev_pop("p") * 100).alias("std"), (F.min("p") * 100).alias("min"), (F.max("p") * 100).alias("max"),
        F.avg("c").alias("criterion_mean"), F.min("c").alias("criterion_min"), F.max("c").alias("criterion_max"), F.avg("ntokens").alias("avg_tokens"),
    )
    return one.crossJoin(quantiles(rows, "p", {"median": 0.5}).select((F.col("median") * 100).alias("median")))


def criterion_median(scores: DataFrame) -> DataFrame:
    """The upper median of the criterion among scored posts."""
    rows = scores.withColumn("p", S.present(F.col("probability"))).where("p IS NOT NULL").withColumn("c", S.present(F.col("criterion")))
    return upper_median(rows, "c", "criterion_median")


def curve(scores: DataFrame, bins: int = 10) -> DataFrame:
    """The distribution curve, with shares in percent."""
    n = histogram(scores, bins)
    return n.crossJoin(n.agg(F.sum("n").alias("total"))).select("bin", "n", F.when(F.col("total") > 0, 100.0 * F.col("n") / F.col("total")).otherwise(0.0).alias("pct"))


def systematic(rows: DataFrame, k: int, group: list[str], key: str = "id") -> DataFrame:
    """K rows of each group, evenly spaced in key order (places ``int(i * n / k)``), all where there are no more.

    The place of a row is its place in its key range plus the counts of the ranges before:
    see ``numbered``, so a large group is not sorted in one task.
    """
    placed = numbered(rows, group, key)
    i = F.ceil(F.col("rn") * k / F.col("n"))
    return placed.where((F.col("n") <= k) | (F.floor(i * F.col("n") / k) == F.col("rn")) & (i < k)).drop("rn", "n")


def numbered(rows: DataFrame, group: list[str], key: str = "id") -> DataFrame:
    """Rows with their place ``rn`` (from 0) in their group by key, and the group's size ``n``.

    Rows are dealt into ranges by sampled quantiles of group and key; places are counted inside a
    range and offset by the sizes of the group's ranges before it.
    """
    ranged = _ranges(rows, *group, key)
    sizes = ranged.groupBy(*group, "__b").agg(F.count("*").alias("__m"))
    of_group = Window.partitionBy(*group)  # one row for each range
    before = F.sum("__m").over(of_group.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*group, "__b", F.coalesce(before, F.lit(0)).alias("__o"), F.sum("__m").over(of_group).alias("n"))
    inside = F.row_number().over(Window.partitionBy(*group, "__b").orderBy(key)) - 1
    return ranged.withColumn("__r", inside).join(offsets, [*group, "__b"]).withColumn("rn", F.col("__r") + F.col("__o")).drop("__b", "__r", "__o")


def sample_estimates(scores: DataFrame, posts: DataFrame, k: int = 1000) -> DataFrame:
    """Bots and text length estimated from a systematic sample of k scored posts, scaled to all (``k`` = 0: from all)."""
    valid = scores.withColumn("p", S.present(F.col("probability"))).where("p IS NOT NULL").select("id", F.lit(1).alias("g"))
    some = systematic(valid, k, ["g"]) if k else valid
    seen = posts.join(some.select("id"), "id")
    stats = seen.agg(F.count("*").alias("sampled"), F.count_if("bot").alias("bots"), F.avg(F.when(F.length("content") > 0, F.length("content"))).alias("avg_chars"))
    out = stats.crossJoin(valid.agg(F.count("*").alias("n")))
    share = F.col("bots") / F.greatest("sampled", F.lit(1))
    return out.select("n", "sampled", "avg_chars", (share * 100).alias("bot_pct"), (share * F.col("n")).alias("bots_estimate"))


def text_lengths(scores: DataFrame, posts: DataFrame, k: int = 1000) -> DataFrame:
    """Mean and upper median of characters in a systematic sample of k scored posts (``k`` = 0: in all), and mean tokens.

    Where tokens were not counted (a mean of five or fewer) they are estimated from the characters.  Posts without
    content don't count; without any, lengths are 0.
    """
    valid = scores.withColumn("p", S.present(F.col("probability"))).where("p IS NOT NULL").select("id", "ntokens", F.lit(1).alias("g"))
    some = systematic(valid.select("id", "g"), k, ["g"]) if k else valid
    chars = cut(posts.join(some.select("id"), "id").where(F.length("content") > 0).select(F.length("content").alias("chars")))
    out = chars.agg(F.coalesce(F.avg("chars"), F.lit(0.0)).alias("avg_chars")).crossJoin(upper_median(chars, "chars", "median_chars")).crossJoin(valid.agg(F.avg("ntokens").alias("tokens")))
    tokens = F.when(F.col("tokens") > 5, F.col("tokens")).otherwise(F.bround(F.col("avg_chars") / CHARS_A_TOKEN))
    return out.select("avg_chars", F.coalesce("median_chars", F.lit(0)).alias("median_chars"), tokens.alias("avg_tokens"))


#: Fixed value: characters that stand for a token.
CHARS_A_TOKEN = 4.2


def top_domains(posts: DataFrame, k: int = 8) -> DataFrame:
    """The domains with most of these posts."""
    return posts.groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(k)


def verdict_counts(checks: DataFrame) -> DataFrame:
    """Checks by verdict, with the group that it belongs to."""
    group = F.when(F.col("verdict").isin("vero", "perlopiù vero"), "true").when(F.col("verdict").isin("falso", "perlopiù falso"), "false").otherwise("unverifiable")
    return checks.groupBy("verdict").agg(F.count("*").alias("n")).withColumn("verdict_group", group)


def ai_accounts(scores: DataFrame, posts: DataFrame, accounts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Accounts whose posts (deleted ones aside) have a mean probability at or above the threshold, with the bot flag."""
    p = scores.select("id", S.present(F.col("probability")).alias("p")).where("p IS NOT NULL")
    mean = posts.where("deleted_at IS NULL").select("id", "account_id").join(p, "id").groupBy("account_id").agg(F.avg("p").alias("mean_p"), F.count("*").alias("n_posts"))
    return mean.where(F.col("mean_p") >= threshold).join(accounts.select(F.col("id").alias("account_id"), "bot"), "account_id")


def ai_by_bot(found: DataFrame) -> DataFrame:
    """How many accounts with AI content are bots."""
    return found.agg(F.count("*").alias("ai_accounts"), F.count_if("bot").alias("ai_bots"), F.count_if(~F.col("bot")).alias("ai_humans"))


def detector_report(texts: DataFrame, threshold: float = 0.9, steepness: float = 25.0) -> DataFrame:
    """A10: totals and score statistics of scored texts (id, text, lang, score)."""
    ok = texts.withColumn("label", S.detector_label(F.col("score"), F.col("text"), threshold)).withColumn("words", S.word_count(F.coalesce("text", F.lit(""))))
    ok = ok.withColumn("s", F.when(F.col("label") != S.EMPTY_LABEL, S.present(F.col("score")))).withColumn("pct", S.ai_percentage(F.col("s"), threshold, steepness))
    one = ok.agg(
        F.count("*").alias("total"), F.count("s").alias("scored"), F.count_if(F.col("label") == S.EMPTY_LABEL).alias("empty"),
        F.count_if(F.col("s").isNotNull() & (F.col("words") < 50)).alias("short"), F.count_if(F.col("s") < threshold).alias("ai"), F.count_if(F.col("s") >= threshold).alias("human"),
        F.avg("s").alias("score_mean"), F.min("s").alias("score_min"), F.max("s").alias("score_max"), F.stddev_pop("s").alias("score_std"),
    )
    return one.crossJoin(quantiles(ok, "s", {"score_median": 0.5}))


def detector_bins(texts: DataFrame, threshold: float = 0.9, steepness: float = 25.0) -> DataFrame:
    """A10: texts by ten points of the AI percentage; 100 is a bin of its own."""
    pct = S.ai_percentage(S.present(F.col("score")), threshold, steepness)
    return texts.select(F.floor(pct / 10).cast("int").alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))


def by_language(texts: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Scored texts and AI texts by language, '??' for none."""
    lang = F.coalesce(F.nullif(F.trim("lang"), F.lit("")), F.lit("??"))
    s = S.present(F.col("score"))
    return texts.select(lang.alias("lang"), s.alias("s")).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("s") < threshold).alias("ai"))


def running_report(rows: DataFrame, scored_language: str = "en") -> DataFrame:
    """Texts by language and bin; only one language is scored, the others count under bin -1."""
    lang = F.coalesce(F.nullif(F.trim("lang"), F.lit("")), F.lit("??"))
    p = F.when(F.col("lang") == scored_language, S.present(F.col("ai_probability")))
    return rows.select(lang.alias("lang"), F.coalesce(S.bin_of(p, 5), F.lit(-1)).alias("bin")).groupBy("lang", "bin").agg(F.count("*").alias("n"))


def extremes(texts: DataFrame, k: int = 10) -> DataFrame:
    """A10, L3: the k lowest and k highest scores."""
    rows = texts.where(S.present(F.col("score")).isNotNull()).select("id", "score")
    low = rows.orderBy("score", "id").limit(k).withColumn("side", F.lit("low"))
    return low.unionByName(rows.orderBy(F.desc("score"), "id").limit(k).withColumn("side", F.lit("high")))


def language_distribution(posts: DataFrame, corpus: tuple[str, ...], top: int = 15) -> DataFrame:
    """Languages by frequency with the tail folded, share in percent, and posts by source."""
    lang = F.coalesce("language", F.lit("(none)"))
    n = posts.select(lang.alias("language"), "source").groupBy("language").agg(F.count("*").alias("n"), F.count_if(F.col("source") == "hashtag").alias("from_hashtag"), F.count_if(F.col("source") == "user_timeline").alias("from_timeline"))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "language"))  # one row per language
    folded = n.withColumn("language", F.when(rank <= top, F.col("language")).otherwise("other")).groupBy("language").agg(*[F.sum(c).alias(c) for c in ("n", "from_hashtag", "from_timeline")])
    return folded.crossJoin(posts.agg(F.count("*").alias("total"))).select("language", "n", (100.0 * F.col("n") / F.col("total")).alias("pct"), "from_hashtag", "from_timeline", F.col("language").isin(*corpus).alias("in_corpus"))


def hashtag_uses(history_column: str = "history"):
    """The sum of 'uses' over a hashtag's history."""
    return F.aggregate(history_column, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x["uses"].try_cast("bigint"), F.lit(0)))


def union_hashtags(found: DataFrame) -> DataFrame:
    """Hashtags of several queries by case-folded name, the most used one stays (ties: the first query)."""
    best = found.groupBy(F.lower("name").alias("name")).agg(F.max_by(F.struct("uses", "query_no"), F.struct("uses", -F.col("query_no"))).alias("x"))
    return best.select("name", F.col("x.uses").alias("uses"), F.col("x.query_no").alias("query_no"))


def quartile_estimates(scores: DataFrame) -> DataFrame:
    """Quartiles estimated from median and deviation, beside the exact ones."""
    p = scores.select(S.present(F.col("probability")).alias("p"))
    s = p.agg(F.stddev_pop("p").alias("std")).crossJoin(quantiles(p, "p", {"median": 0.5, "q1_exact": 0.25, "q3_exact": 0.75}))
    return s.withColumn("q1", F.col("median") - 0.674 * F.col("std")).withColumn("q3", F.col("median") + 0.674 * F.col("std")).withColumn("iqr", F.col("q3") - F.col("q1"))


def work_by_domain(items: DataFrame) -> DataFrame:
    """Pending items by domain."""
    return items.groupBy("domain").agg(F.count("*").alias("pending"))
