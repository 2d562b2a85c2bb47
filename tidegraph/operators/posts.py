"""Selecting, joining and paging posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions import text as T
from tidegraph.functions.scores import present, quartile


def analysable(posts: DataFrame, include_timeline: bool = False, exact: bool = False) -> DataFrame:
    """posts that are neither deleted nor reblogs and have text once cleaned."""
    keep = F.col("deleted_at").isNull() & F.col("reblog_of_id").isNull() & (F.length("content") > 0)
    if not include_timeline:
        keep &= F.col("source") == "hashtag"
    cleaned = posts.where(keep).withColumn("text", (T.clean_html if exact else T.clean_html_basic)(F.col("content")))
    return cleaned.where(F.length("text") > 0)


def eligible(posts: DataFrame) -> DataFrame:
    """Posts that are neither deleted nor reblogs and have content."""
    return posts.where("deleted_at IS NULL AND reblog_of_id IS NULL AND length(content) > 0")


def to_fact_check(posts: DataFrame, limit: int | None = None) -> DataFrame:
    """eligible posts without a veracity, in id order."""
    out = eligible(posts).where("veracity IS NULL").orderBy("id")
    return out if limit is None else out.limit(limit)


def to_enrich(posts: DataFrame, now: Column, days: int) -> DataFrame:
    """posts with interactions that were never enriched or not for some days."""
    stale = F.col("enriched_at").isNull() | (F.col("enriched_at") < now - F.make_interval(days=F.lit(days)))
    busy = (T.json_count(F.col("raw"), "reblogs_count") > 0) | (T.json_count(F.col("raw"), "replies_count") > 0)
    return posts.where(F.col("deleted_at").isNull() & stale & busy)


def keep_timeline(statuses: DataFrame, known: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """reblogs, and posts in an allowed language with a known hashtag (large sets by a semi join)."""
    known = known.select(F.lower("hashtag").alias("__tag")).distinct()
    tagged = statuses.select("id", F.explode(F.transform("tags", F.lower)).alias("__tag")).join(known, "__tag", "left_semi").select("id").distinct()
    ok = tagged.withColumn("__ok", F.lit(True))
    out = statuses.join(ok, "id", "left").where(F.col("reblog_of_id").isNotNull() | (F.col("language").isin(*languages) & F.col("__ok")))
    return out.drop("__ok")


def allowed_languages(posts: DataFrame, languages: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """posts in allowed languages, and the newest id of all posts (before that filter)."""
    return posts.where(F.col("language").isin(*languages)), posts.agg(F.max_by("id", F.struct("created_at", "id")).alias("newest_id"))


def not_done(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """F8: rows whose id has no output yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def checkworthy(scores: DataFrame, threshold: float = 0.6) -> DataFrame:
    """scores above (not at) the threshold."""
    return scores.where(F.col("score") > threshold)


def at_least(scores: DataFrame, threshold: float = 0.5, column: str = "probability") -> DataFrame:
    """ids at or above a probability; NaN is absent."""
    return scores.where(present(F.col(column)) >= threshold).select("id")


def in_quartiles(scores: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """scores in the chosen quarters."""
    rows = scores.withColumn("probability", present(F.col("probability"))).where("probability IS NOT NULL")
    return rows.withColumn("quartile", quartile(F.col("probability"))).where(F.col("quartile").isin(*labels))


def search_checks(checks: DataFrame, verdicts: tuple[str, ...], term: str, columns: tuple[str, ...] = ("text", "reasoning")) -> DataFrame:
    """checks by verdict whose text or reasoning holds a term; the search goes before any paging."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(term.lower())
    return checks.where(F.col("verdict").isin(*verdicts) & hit)


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """L1: one page in a total order, with clamped number and size, the total, and whether more follow."""
    number, size = max(1, number), min(100, max(5, size))
    total = rows.agg(F.count("*").alias("total"))
    out = rows.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(total)
    return out.withColumn("has_next", F.col("total") > number * size)


def next_page(rows: DataFrame, key: str, after, size: int = 20) -> DataFrame:
    """L1: keyset paging for deep pages: the filter reaches the scan."""
    return (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(size)


def order_by(name: str, probability: str = "probability", key: str = "id") -> list[Column]:
    """L2: id, id_desc, top or bottom probability, with the id as last key."""
    return {
        "id": [F.col(key).asc()], "id_desc": [F.col(key).desc()],
        "top": [F.col(probability).desc_nulls_last(), F.col(key).asc()], "bottom": [F.col(probability).asc_nulls_last(), F.col(key).asc()],
    }[name]


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """L3: the first k rows of each group in a total order."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def live(posts: DataFrame) -> DataFrame:
    """Posts that are not deleted: every listing, lookup and detail leaves deleted ones out."""
    return posts.where("deleted_at IS NULL")


def with_authors(posts: DataFrame, accounts: DataFrame, instances: DataFrame, exact: bool = False) -> DataFrame:
    """Posts that are not deleted with their author and the server they were seen on, content cleaned."""
    a = accounts.select(F.col("id").alias("account_id"), "acct", "bot")
    i = instances.select(F.col("id").alias("instance_id"), "domain")
    clean = (T.clean_html if exact else T.clean_html_basic)(F.col("content"))
    return live(posts).join(a, "account_id").join(i, "instance_id").withColumn("content", clean)


def by_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows of a list of ids."""
    return rows.join(ids.select(key), key, "left_semi")


def with_detectors(posts: DataFrame, detectors: dict[str, DataFrame]) -> DataFrame:
    """Posts with the probability of each detector, null where it has none."""
    for name, scores in detectors.items():
        posts = posts.join(scores.select("id", F.col("probability").alias(name)), "id", "left")
    return posts


def latest_cursor(runs: DataFrame) -> DataFrame:
    """L4: the newest cursor of each (instance, hashtag) that is not null."""
    return runs.where("max_id_cursor IS NOT NULL").groupBy("instance_id", "hashtag").agg(F.max_by("max_id_cursor", F.struct("started_at", "id")).alias("cursor"))


def carried_cursor(runs: DataFrame) -> DataFrame:
    """Each run's cursor, or the last one before it in its (instance, hashtag)."""
    w = Window.partitionBy("instance_id", "hashtag").orderBy("started_at", "id")
    return runs.withColumn("cursor", F.last("max_id_cursor", ignorenulls=True).over(w))


def first_of_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an ascending order (``merge.latest`` for the last one); an aggregate, so a hot key is combined before the shuffle."""
    others = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("__x"))
    return best.select(*key, *[F.col(f"__x.{c}").alias(c) for c in others])


def known_hashtags(tags: DataFrame) -> DataFrame:
    """Distinct hashtags in lower case."""
    return tags.select(F.lower("hashtag").alias("hashtag")).distinct()


def post_topics(tags: DataFrame, topic_tags: DataFrame) -> DataFrame:
    """(status, topic) through case-folded hashtags."""
    topics = topic_tags.select(F.lower("hashtag").alias("tag"), "topic").distinct()
    return tags.withColumn("tag", F.lower("hashtag")).join(topics, "tag").select("status_id", "topic").distinct()


def claims_with_evidence(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each claim with its evidence as lines '- title: snippet (url)', or the words for none."""
    line = F.concat(F.lit("- "), F.col("title"), F.lit(": "), F.col("snippet"), F.lit(" ("), F.col("url"), F.lit(")"))
    lists = evidence.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))).alias("lines"))
    block = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return claims.join(lists, "id", "left").withColumn("evidence", F.coalesce(block, F.lit(T.NO_SOURCE))).drop("lines")
