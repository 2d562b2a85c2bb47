"""Upserts and merges by natural key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .iterate import cut, forget, left_by


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; an aggregate, so a hot key is combined before the shuffle."""
    others = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__x"))
    return best.select(*key, *[F.col(f"__x.{c}").alias(c) for c in others])


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """M1: union of both, the latest row of each key."""
    return latest(old.unionByName(new), key, order)


def live_upsert(rows: DataFrame, key: list[str], first: list[str], last: list[str], order: list[str]) -> DataFrame:
    """M2: columns in ``first`` keep the value of the first sighting, those in ``last`` take the newest."""
    by = F.struct(*order)
    return rows.groupBy(*key).agg(*[F.min_by(c, by).alias(c) for c in first], *[F.max_by(c, by).alias(c) for c in last])


def new_rows(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """One incoming row for each key that is not there."""
    return incoming.dropDuplicates(key).join(existing.select(*key).distinct(), key, "left_anti")


def insert_only(existing: DataFrame, incoming: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """M3: existing rows stay as they are, new keys come in; and each incoming key flagged as new or existing."""
    new = new_rows(existing, incoming, key)
    flagged = incoming.select(*key).distinct().join(existing.select(*key).distinct().withColumn("__there", F.lit(True)), key, "left")
    return existing.unionByName(new.select(*existing.columns)), flagged.select(*key, F.coalesce("__there", F.lit(False)).alias("existed"))


def import_summary(flags: dict[str, DataFrame]) -> DataFrame:
    """New and existing rows by table."""
    out = None
    for name, f in flags.items():
        row = f.agg(F.count_if(~F.col("existed")).alias("new_rows"), F.count_if("existed").alias("existing_rows")).withColumn("table_name", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def surrogate(*key: str) -> Column:
    """A stable id of a natural key."""
    return F.xxhash64(*key)


def resolve(rows: DataFrame, known: DataFrame, reference: dict[str, str], into: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the local id of what they refer to (columns of ``rows`` to columns of ``known``), and the rows whose reference is unknown."""
    ids = known.select(*[F.col(k).alias(f"__k_{r}") for r, k in reference.items()], F.col("id").alias(into))
    cond = [F.col(r) == F.col(f"__k_{r}") for r in reference]
    both = rows.join(ids, cond, "left").drop(*[f"__k_{r}" for r in reference])
    return both.where(F.col(into).isNotNull()), both.where(F.col(into).isNull()).drop(into)


def resolve_parents(statuses: DataFrame) -> DataFrame:
    """The local id of the parent, by server and the server's id of it."""
    p = statuses.select("instance_id", F.col("mastodon_id").alias("in_reply_to_mastodon_id"), F.col("id").alias("parent_id"))
    return left_by(statuses, p, ["instance_id", "in_reply_to_mastodon_id"], "id")


def _ref(name: str, domain: str = "instance_domain", key: str = "mastodon_id") -> Column:
    return F.struct(F.col(domain).alias("instance_domain"), F.col(key).alias("mastodon_id")).alias(name)


def merge_bundle(existing: dict[str, DataFrame], incoming: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """M4: the nine tables of a bundle in the order of their references (topics, instances, accounts, statuses, then what hangs on them).

    Existing rows have local ids, incoming ones natural keys; each table is merged by natural key
    (M3) once its references are resolved (J12).  New rows get the hash of their key as id.
    Incoming accounts, statuses and links whose reference is unknown are left out (``unresolved``
    has the statuses); a status keeps a null parent where that one is unknown.  The summary has
    new and existing rows by table.
    """
    out, _, summary = merge_bundle_parts(existing, incoming)
    return out, summary


def merge_bundle_parts(existing: dict[str, DataFrame], incoming: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame], DataFrame]:
    """M4 as (merged tables, their new rows, summary); of existing rows only those that the bundle names are needed."""
    out, fresh, flags = {}, {}, {}

    def add(name: str, rows: DataFrame, key: list[str]) -> None:
        old = existing[name]
        rows = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns])
        out[name], flags[name] = insert_only(old, rows, key)
        fresh[name] = new_rows(old, rows, key)

    add("topics", incoming["topics"].withColumn("id", surrogate("name")), ["name"])
    topic = out["topics"].select(F.col("id").alias("topic_id"), F.col("name").alias("__topic"))
    inst = incoming["instances"].join(topic, F.col("discovered_via_topic") == F.col("__topic"), "left").withColumn("id", surrogate("domain"))
    add("instances", inst, ["domain"])
    home = out["instances"].select(F.col("id").alias("instance_id"), F.col("domain").alias("instance_domain"))
    acc = incoming["accounts"].join(home, "instance_domain").withColumn("id", surrogate("instance_domain", "mastodon_id"))
    add("accounts", acc, ["instance_id", "mastodon_id"])

    def known(table: str, into: str) -> DataFrame:
        rows = out[table].select(F.col("id").alias(into), "instance_id", "mastodon_id").join(home, "instance_id")
        return rows.select(into, _ref("__ref"))

    refs: dict[str, DataFrame] = {}

    def found(rows: DataFrame, ref: str, table: str, into: str, how: str = "inner") -> DataFrame:
        keys = refs[table].withColumnRenamed("id", into) if table in refs else known(table, into)
        return rows.join(keys.withColumnRenamed("__ref", ref), ref, how)

    st = incoming["statuses"].join(home, "instance_domain").withColumn("id", surrogate("instance_domain", "mastodon_id"))
    out["unresolved"] = st.join(known("accounts", "account_id").withColumnRenamed("__ref", "account_ref"), "account_ref", "left_anti")
    st = whole = cut(found(st, "account_ref", "accounts", "account_id"))  # read several times below
    # parents are looked up among old and new statuses alike, so their order in the file doesn't matter
    every = existing["statuses"].select("id", "instance_id", "mastodon_id").join(home, "instance_id").select("id", _ref("__ref"), F.lit(0).alias("new"))
    every = every.unionByName(st.select("id", _ref("__ref"), F.lit(1).alias("new"))).groupBy("__ref").agg(F.min_by("id", "new").alias("id"))
    for ref, into in (("reblog_of_ref", "reblog_of_id"), ("in_reply_to_ref", "in_reply_to_id")):
        st = left_by(st, every.select(F.col("__ref").alias(ref), F.col("id").alias(into)), ref, "id")
    st = cut(st)
    forget(whole)
    add("statuses", st, ["instance_id", "mastodon_id"])
    refs.update({n: cut(known(n, "id")) for n in ("accounts", "statuses")})  # ids by natural key, for the tables that hang on them
    for name, extra in (("status_hashtags", "hashtag"), ("mentions", "mentioned_acct")):
        add(name, found(incoming[name], "status_ref", "statuses", "status_id"), ["status_id", extra])
    tags = incoming["topic_hashtags"].join(topic, F.col("topic_name") == F.col("__topic")).join(home, "instance_domain")
    add("topic_hashtags", tags, ["topic_id", "instance_id", "hashtag"])
    add("reblogs", found(found(incoming["reblogs"], "status_ref", "statuses", "status_id"), "booster_account_ref", "accounts", "booster_account_id"), ["status_id", "booster_account_id"])
    links = found(found(incoming["follows"], "follower_ref", "accounts", "follower_account_id"), "followed_ref", "accounts", "followed_account_id")
    add("follows", links, ["follower_account_id", "followed_account_id"])
    return out, fresh, import_summary(flags)


def replace_slice(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """M5: the slices that the new rows name are replaced whole."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def with_markers(rows: DataFrame, events: DataFrame) -> DataFrame:
    """M6: rows with the last time of each marker (enriched, deleted, crawled) from an event log (id, marker, at)."""
    last = events.groupBy("id").pivot("marker", ["enriched", "deleted", "crawled"]).agg(F.max("at"))
    return rows.join(last, "id", "left")


def append_run(runs: DataFrame, run: DataFrame) -> DataFrame:
    """M7: the log of runs with one more."""
    return runs.unionByName(run)


def export_statuses(statuses: DataFrame, accounts: DataFrame, instances: DataFrame) -> DataFrame:
    """Statuses with natural keys of author and parents (null where there is none)."""
    home = instances.select(F.col("id").alias("instance_id"), "domain")
    author = accounts.select(F.col("id").alias("account_id"), F.col("mastodon_id").alias("author"), "instance_id").join(home, "instance_id").select("account_id", "author", F.col("domain").alias("author_domain"))
    own = statuses.join(home, "instance_id").join(author, "account_id")
    named = statuses.join(home, "instance_id").select("id", F.col("domain").alias("d"))
    for ref, name in (("in_reply_to_id", "parent"), ("reblog_of_id", "reblog")):
        own = left_by(own, named.select(F.col("id").alias(ref), F.col("d").alias(f"{name}_domain")), ref, "id")
    key = lambda domain, i: F.when(F.col(domain).isNotNull(), F.concat_ws("/", domain, F.col(i).cast("string")))
    return own.select(
        key("domain", "id").alias("status"), F.concat_ws("/", "author_domain", "author").alias("account"), "language", "created_at", "source",
        key("parent_domain", "in_reply_to_id").alias("in_reply_to"), key("reblog_domain", "reblog_of_id").alias("reblog_of"),
    )


def export_bundle(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The nine tables with ids replaced by natural keys (server's domain, the server's id).

    Rows whose server, account or status is missing are left out; a missing parent post or topic is null.
    """
    home = t["instances"].select(F.col("id").alias("instance_id"), F.col("domain").alias("instance_domain"))
    topic = t["topics"].select(F.col("id").alias("topic_id"), F.col("name").alias("topic_name"))
    acc = t["accounts"].join(home, "instance_id")
    who = lambda id_col, name: acc.select(F.col("id").alias(id_col), _ref(name))
    post = t["statuses"].join(home, "instance_id")
    which = lambda id_col, name: post.select(F.col("id").alias(id_col), _ref(name))
    st = post.join(who("account_id", "account_ref"), "account_id")
    for parent in ("reblog_of", "in_reply_to"):
        st = left_by(st, which(f"{parent}_id", f"{parent}_ref"), f"{parent}_id", "id")
    return {
        "topics": t["topics"].select("name"),
        "instances": t["instances"].join(topic, "topic_id", "left").select("domain", F.col("topic_name").alias("discovered_via_topic"), "active_users"),
        "accounts": acc.select("instance_domain", "mastodon_id", "acct", "username", "bot"),
        "statuses": st.select("instance_domain", "mastodon_id", "account_ref", "language", "created_at", "reblog_of_ref", "in_reply_to_ref", "source", "deleted_at"),
        "status_hashtags": t["status_hashtags"].join(which("status_id", "status_ref"), "status_id").select("status_ref", "hashtag"),
        "mentions": t["mentions"].join(which("status_id", "status_ref"), "status_id").select("status_ref", "mentioned_acct"),
        "topic_hashtags": t["topic_hashtags"].select("topic_id", "instance_id", "hashtag", "usage_count").join(topic, "topic_id").join(home, "instance_id").select("topic_name", "instance_domain", "hashtag", "usage_count"),
        "reblogs": t["reblogs"].join(which("status_id", "status_ref"), "status_id").join(who("booster_account_id", "booster_account_ref"), "booster_account_id").select("status_ref", "booster_account_ref"),
        "follows": t["follows"].join(who("follower_account_id", "follower_ref"), "follower_account_id").join(who("followed_account_id", "followed_ref"), "followed_account_id").select("follower_ref", "followed_ref"),
    }
