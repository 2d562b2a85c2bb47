"""Sources: score files, reports, corpora, bundles, topic and block lists, cascade documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from tidegraph.functions import text as T
from tidegraph.functions.scores import present
from tidegraph.operators.merge import latest
from tidegraph.operators.posts import first_of_key

SCORES = "id long, probability double, criterion double, ntokens int, model string"
BINOCULARS = "id long, lang string, text string, created_at string, binoculars_score double, binoculars_label string, ai_probability_pct double, ai_generated boolean, n_words int, reliable_length boolean"
DESKLIB = "id long, lang string, text string, ai_probability double"
CHECKWORTHY = "id long, score double, checkworthy boolean"
POST_TEXTS = "id long, lang string, text string, created_at string"
FACT_CHECKS = "id string, verdict string, veracity string, confidence string, reasoning string, evidence_urls string, model string"
STATUS = (
    "id string, account struct<id: string, acct: string, username: string, bot: boolean>, content string, language string, created_at string, in_reply_to_id string, "
    "tags array<struct<name: string>>, mentions array<struct<acct: string>>, "
    "reblog struct<id: string, account: struct<id: string, acct: string, username: string, bot: boolean>, content: string, language: string, created_at: string, in_reply_to_id: string, tags: array<struct<name: string>>, mentions: array<struct<acct: string>>>"
)
CASCADE = (
    "meta struct<nodes: long, edges: long, reached_nodes: long, reached_pct: double, num_steps: int, note: string>, seeds array<long>, "
    "nodes array<struct<id: long, acct: string, followers: long, is_ia: boolean, is_seed: boolean, activation_step: int>>, "
    "edges array<struct<source: long, target: long, p_ic: double, fired: boolean, step: int>>, frames array<struct<step: int, new_nodes: array<long>>>"
)


def json_lines(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """Rows of JSON lines; blank, malformed and key-less lines are left out; NaN is null; ``_seq`` is the file's time."""
    raw = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = raw.withColumn("_seq", F.col("_metadata.file_modification_time")).where(F.col("_corrupt").isNull() & F.col(key).isNotNull()).drop("_corrupt")
    return rows.select(*[present(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


def scores(spark: SparkSession, path: str, schema: str = SCORES, seq: str = "_seq") -> DataFrame:
    """The last score of each id."""
    rows = json_lines(spark, path, schema)
    others = [c for c in rows.columns if c not in ("id", seq)]
    return latest(rows, ["id"], [seq, *others]).drop("_seq")


def fact_checks(spark: SparkSession, path: str) -> DataFrame:
    """Fact checks of a CSV report; verdicts are normalised, an absent veracity is 5, rows that don't parse are left out."""
    raw = spark.read.schema(FACT_CHECKS).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    veracity = F.when(F.coalesce("veracity", F.lit("")) == "", F.lit(5)).otherwise(F.col("veracity").try_cast("int"))
    rows = raw.select(F.col("id").try_cast("bigint").alias("id"), T.normalize_verdict(F.col("verdict")).alias("verdict"), veracity.alias("veracity"), present(F.col("confidence").try_cast("double")).alias("confidence"), "reasoning", "evidence_urls", "model")
    return rows.where("id IS NOT NULL AND veracity IS NOT NULL")


def texts(spark: SparkSession, path: str, lang: str | None = None, limit: int | None = None) -> DataFrame:
    """S3: the corpus in one language or all, without blank texts."""
    rows = json_lines(spark, path, POST_TEXTS).where(F.length(F.trim("text")) > 0).drop("_seq")
    rows = rows if lang is None else rows.where(F.col("lang") == lang)
    return rows if limit is None else rows.orderBy("id").limit(limit)


def relational(spark: SparkSession, path: str | None = None, jdbc: dict | None = None) -> DataFrame:
    """A table from Parquet, or from a database with a partition column (options of Spark's JDBC source)."""
    return spark.read.format("jdbc").options(**jdbc).load() if jdbc else spark.read.parquet(path)


def database(spark: SparkSession, url: str, table: str, key: str, rows_a_task: int = 500_000, **options: str) -> DataFrame:
    """A table of a database in ranges of a numeric key, as many as its rows need; filters on it are the database's work.

    Ranges are of equal width between the least and the greatest key; null keys come with the first.
    """
    quote = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier
    one = {"url": url, **options}
    ends = spark.read.format("jdbc").options(query=f"SELECT min({quote(key)}) AS lo, max({quote(key)}) AS hi, count(*) AS n FROM {table}", **one).load().first()
    lo, hi, n = ends  # by place: databases differ in the case of names
    if lo is None or lo == hi or n <= rows_a_task:
        return relational(spark, jdbc={"dbtable": table, **one})
    parts = min(-(-n // rows_a_task), int(hi) - int(lo) + 1)
    return relational(spark, jdbc={"dbtable": table, "partitionColumn": key, "lowerBound": str(int(lo)), "upperBound": str(int(hi) + 1), "numPartitions": str(parts), **one})


def topics(lines: DataFrame) -> DataFrame:
    """(name, queries) of topic lines (line_no, value): 'Name: a, b', comments and blanks out, the first line of a name wins."""
    line = F.trim(F.regexp_replace("value", "^﻿", ""))
    rows = lines.select("line_no", line.alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    parts = F.split("line", ":", 2)
    listed = F.filter(F.transform(F.split(parts[1], ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.select("line_no", F.trim(parts[0]).alias("name"), F.when(F.size(parts) > 1, listed).alias("listed"))
    rows = rows.withColumn("queries", F.when(F.size("listed") > 0, F.col("listed")).otherwise(F.array("name"))).where("name <> ''")
    return first_of_key(rows, ["name"], [F.col("line_no")]).select("name", "queries")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a small text file, read as one record."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))


#: Columns of the tables of a bundle; references are natural keys.
_REF = "struct<instance_domain: string, mastodon_id: string>"
BUNDLE = {
    "topics": "name string", "instances": "domain string, discovered_via_topic string, active_users int",
    "accounts": "instance_domain string, mastodon_id string, acct string, username string, bot boolean",
    "statuses": f"instance_domain string, mastodon_id string, account_ref {_REF}, language string, created_at timestamp, reblog_of_ref {_REF}, in_reply_to_ref {_REF}, source string, deleted_at timestamp",
    "status_hashtags": f"status_ref {_REF}, hashtag string", "mentions": f"status_ref {_REF}, mentioned_acct string",
    "topic_hashtags": "topic_name string, instance_domain string, hashtag string, usage_count int",
    "reblogs": f"status_ref {_REF}, booster_account_ref {_REF}", "follows": f"follower_ref {_REF}, followed_ref {_REF}",
}


def bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The nine tables of a bundle; blank and malformed lines are left out."""
    out = {}
    for name, schema in BUNDLE.items():
        rows = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(f"{path}/{name}")
        out[name] = rows.where("_corrupt IS NULL").drop("_corrupt")
    return out


def blacklist(lines: DataFrame) -> DataFrame:
    """Domains of a block list (value): what goes before a '#'."""
    return lines.select(F.lower(F.trim(F.split("value", "#")[0])).alias("domain")).where("domain <> ''").distinct()


def report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object; no row where there is none."""
    found = spark.read.schema(schema).option("multiLine", True)
    try:
        return found.json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def cascade(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Meta, seeds, nodes, edges and frames of a cascade document."""
    doc = spark.read.schema(CASCADE).option("multiLine", True).json(path)
    return {
        "meta": doc.select("meta.*"), "seeds": doc.select(F.explode("seeds").alias("id")), "nodes": doc.select(F.explode("nodes").alias("x")).select("x.*"),
        "edges": doc.select(F.explode("edges").alias("x")).select("x.*"), "frames": doc.select(F.explode("frames").alias("x")).select("x.step", F.explode("x.new_nodes").alias("id")),
    }


def status_rows(raw: DataFrame, column: str = "raw") -> dict[str, DataFrame]:
    """Statuses, accounts, hashtags and mentions of status documents; a reblogged original is a status too (one level).

    Of several documents of a status its own goes before copies in reblogs, then the smallest by its fields (of accounts alike).
    """
    doc = raw.select(F.from_json(column, STATUS).alias("s")).where("s.id IS NOT NULL")
    fields = ("id", "account", "content", "language", "created_at", "in_reply_to_id", "tags", "mentions")
    own = doc.select(*[F.col(f"s.{f}").alias(f) for f in fields], F.col("s.reblog.id").alias("reblog_of"), F.lit(0).alias("copy"))
    inner = doc.where("s.reblog.id IS NOT NULL").select(*[F.col(f"s.reblog.{f}").alias(f) for f in fields], F.lit(None).cast("string").alias("reblog_of"), F.lit(1).alias("copy"))
    both = own.unionByName(inner)
    every = both.groupBy("id").agg(F.min(F.struct("copy", *[c for c in both.columns if c not in ("id", "copy")])).alias("x")).select("id", "x.*")
    return {
        "statuses": every.select("id", F.col("account.id").alias("account_id"), "content", "language", F.try_to_timestamp("created_at").alias("created_at"), "in_reply_to_id", "reblog_of"),
        "accounts": every.where("account.id IS NOT NULL").groupBy("account.id").agg(F.min(F.struct("copy", "account")).alias("x")).select("x.account.*"),
        "hashtags": every.select(F.col("id").alias("status_id"), F.explode("tags").alias("t")).select("status_id", F.lower("t.name").alias("hashtag")).distinct(),
        "mentions": every.select(F.col("id").alias("status_id"), F.explode("mentions").alias("m")).select("status_id", F.col("m.acct").alias("mentioned_acct")).distinct(),
    }
