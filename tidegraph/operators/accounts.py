"""Account queries: crawl lists, details, ego networks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions import text as T


def to_crawl(accounts: DataFrame, statuses: DataFrame, reblogs: DataFrame, mentions: DataFrame, include_isolated: bool = False) -> DataFrame:
    """accounts whose timeline wasn't read and that boosted, were boosted, replied, were replied to, or were mentioned.

    The five relations give ids that are united, so there is one semi join and no disjunction.
    """
    open_ = accounts.where("timeline_crawled IS NULL")
    if include_isolated:
        return open_
    owner = statuses.select(F.col("id").alias("status_id"), "account_id")
    parent = statuses.where("in_reply_to_id IS NOT NULL").select(F.col("in_reply_to_id").alias("status_id"))
    ids = (
        reblogs.select(F.col("booster_account_id").alias("id"))
        .unionByName(owner.join(reblogs, "status_id", "left_semi").select(F.col("account_id").alias("id")))
        .unionByName(statuses.where("in_reply_to_id IS NOT NULL").select(F.col("account_id").alias("id")))
        .unionByName(owner.join(parent, "status_id", "left_semi").select(F.col("account_id").alias("id")))
        .unionByName(open_.join(mentions, F.col("acct") == F.col("mentioned_acct"), "left_semi").select("id"))
    )
    return open_.join(ids.distinct(), "id", "left_semi")


def to_follow_crawl(accounts: DataFrame, instances: DataFrame, limit: int | None = None, before=None) -> DataFrame:
    """accounts without one of the follow directions, which are missing, by domain and id."""
    need = accounts.select("*", F.col("followers_crawled").isNull().alias("need_followers"), F.col("following_crawled").isNull().alias("need_following"))
    if before is not None:
        need = need.where(F.col("fetched_at") < before)
    out = need.where("need_followers OR need_following").join(instances.select(F.col("id").alias("instance_id"), "domain"), "instance_id").orderBy("domain", "id")
    return out if limit is None else out.limit(limit)


def search(accounts: DataFrame, term: str, limit: int = 20) -> DataFrame:
    """accounts whose name holds a term in any case, bots first."""
    like = f"%{term}%"
    return accounts.where(F.col("acct").ilike(like) | F.col("username").ilike(like)).orderBy(F.desc("bot"), "id").limit(limit)


def detail(accounts: DataFrame, follows: DataFrame, statuses: DataFrame, instances: DataFrame) -> DataFrame:
    """Each account with its server, profile, and followers, following and posts.

    A number in the JSON document goes before the count of rows; empty texts in it count as absent.
    """
    count = lambda df, c, n: df.groupBy(F.col(c).alias("id")).agg(F.count("*").alias(n))
    out = accounts.join(instances.select(F.col("id").alias("instance_id"), F.col("domain").alias("__home")), "instance_id")
    out = out.join(count(follows, "followed_account_id", "__in"), "id", "left").join(count(follows, "follower_account_id", "__out"), "id", "left").join(count(statuses, "account_id", "__posts"), "id", "left")
    json = lambda name: F.get_json_object("raw", f"$.{name}")
    said = lambda *names: F.coalesce(*[F.nullif(json(n), F.lit("")) for n in names])
    number = lambda name, counted: F.coalesce(json(name).try_cast("bigint"), counted, F.lit(0).cast("bigint"))
    return out.select(
        "id", T.account_label(F.col("acct")).alias("label"), "username", F.coalesce(said("display_name"), F.nullif("username", F.lit("")), "acct").alias("display_name"), "bot",
        F.coalesce(F.nullif("__home", F.lit("")), T.account_domain(F.col("acct"))).alias("domain"), F.coalesce(json("note"), F.lit("")).alias("note"),
        said("avatar", "avatar_static").alias("avatar"), said("header", "header_static").alias("header"),
        F.coalesce(said("url", "uri"), F.concat(F.lit("https://"), F.col("__home"), F.lit("/@"), F.col("username"))).alias("url"),
        number("followers_count", F.col("__in")).alias("followers"), number("following_count", F.col("__out")).alias("following"), number("statuses_count", F.col("__posts")).alias("statuses"),
        json("created_at").alias("created_at"), json("last_status_at").alias("last_status_at"), F.coalesce(json("fields"), F.lit("[]")).alias("fields"),
    )


def topology(follows: DataFrame, accounts: DataFrame, mode: str = "all", limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Follow links with both accounts (all, or with a bot at either or both ends) and their nodes with degree and group."""
    a = accounts.select(F.col("id").alias("src"), F.col("bot").alias("src_bot"), F.col("acct").alias("src_acct"))
    b = accounts.select(F.col("id").alias("dst"), F.col("bot").alias("dst_bot"), F.col("acct").alias("dst_acct"))
    links = follows.select(F.col("follower_account_id").alias("src"), F.col("followed_account_id").alias("dst")).join(a, "src").join(b, "dst")
    keep = {"all": F.lit(True), "any_bot": F.col("src_bot") | F.col("dst_bot"), "bots": F.col("src_bot") & F.col("dst_bot")}[mode]
    links = links.where(keep)
    links = links if limit is None else links.orderBy("src", "dst").limit(limit)
    ends = links.select(F.explode(F.array(*[F.struct(F.col(f"{e}").alias("id"), F.col(f"{e}_bot").alias("bot"), F.col(f"{e}_acct").alias("acct")) for e in ("src", "dst")])).alias("x")).select("x.*")
    nodes = ends.groupBy("id", "bot", "acct").agg(F.count("*").alias("degree"))
    nodes = nodes.select("id", T.account_label(F.col("acct")).alias("label"), T.account_domain(F.col("acct")).alias("domain"), "degree", T.node_group(F.col("bot"), F.col("degree")).alias("node_group"))
    return links.select("src", "dst"), nodes


def ego_links(follows: DataFrame, centres: DataFrame) -> DataFrame:
    """Links with a centre at either end: a union of two equi joins, for any number of centres."""
    links = follows.select(F.col("follower_account_id").alias("src"), F.col("followed_account_id").alias("dst"))
    c = centres.select(F.col("id").alias("centre")).distinct()
    out = links.join(c, links["src"] == c["centre"]).unionByName(links.join(c, links["dst"] == c["centre"]))
    return out.select("centre", "src", "dst").distinct()


def not_blacklisted(instances: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Instances whose domain is not on the list."""
    return instances.join(blacklist.select("domain"), "domain", "left_anti")
