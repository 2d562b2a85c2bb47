"""Queries that write and read files, merge tables, run streams and user functions."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from tidegraph.functions import scores as S
from tidegraph.functions.text import NO_SOURCE
from tidegraph.operators import compare, merge, posts, scoring, statistics
from tidegraph.operators.iterate import cut, ensure_shared_dir, left_by
from tidegraph.operators.stored import Stored, merge_bundle_into
from tidegraph.sources import readers, writers
from tidegraph.streaming import jobs

from .post_queries import BINO, BT, DET, P, V, _bino_texts, detectors
from .registry import query


def scratch(spark, name: str) -> str:
    """A new folder that driver and executors share."""
    ensure_shared_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def json_text(df):
    """Rows as JSON lines with a blank, a broken and a key-less line for every tenth row."""
    lines = df.select(F.to_json(F.struct(*df.columns)).alias("value"), "id")
    odd = lines.where("id % 10 = 0").select(F.explode(F.array(F.lit(""), F.lit('{"id": 1, "prob'), F.lit('{"probability": 0.5}'))).alias("value"))
    return lines.select("value").unionByName(odd)


@query(f"SELECT id, {P} AS probability, criterion, ntokens FROM v_scores_fast")
def s1_score_files(t):
    path = scratch(t.spark, "scores")
    json_text(t.scores_fast).write.text(path)
    return cut(readers.scores(t.spark, path).select("id", "probability", "criterion", "ntokens"))


@query(f"SELECT id, {V} AS verdict, CASE WHEN veracity = 'x' THEN NULL ELSE cast(veracity AS int) END AS veracity FROM v_fact_checks WHERE veracity <> 'x'")
def s2_fact_check_files(t):
    path = scratch(t.spark, "checks")
    rows = t.fact_checks.select("id", "verdict", "veracity", F.lit("0.5").alias("confidence"), F.lit('a "quoted"\nreason').alias("reasoning"), F.lit("").alias("evidence_urls"), F.lit("m").alias("model"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return cut(readers.fact_checks(t.spark, path).select("id", "verdict", "veracity"))


@query("SELECT id, lang, md5(text) AS digest FROM v_post_texts WHERE lang = 'en' AND length(trim(text)) > 0")
def s3_corpus_files(t):
    path = scratch(t.spark, "corpus")
    t.post_texts.write.json(path)
    return cut(readers.texts(t.spark, path, "en").select("id", "lang", F.md5("text").alias("digest")))


@query("SELECT id, acct, username, bot FROM v_accounts")
def s4_bundle_files(t):
    path = scratch(t.spark, "bundle")
    writers.bundle({"accounts": t.accounts.select("id", "acct", "username", "bot")}, path)
    return cut(readers.json_lines(t.spark, f"{path}/accounts", "id long, acct string, username string, bot boolean").drop("_seq"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'")
def s5_relational_scan(t):
    return readers.relational(t.spark, f"{t.sf_dir}/orders.parquet").where("o_orderdate < timestamp'1997-01-01'").select("o_orderkey", "o_totalprice")


@query("SELECT user_id AS id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def s6_last_row_wins(t):
    return merge.latest(t.events.select(F.col("user_id").alias("id"), "value", "ts", "event_id"), ["id"], ["ts", "event_id"]).select("id", "value")


@query("SELECT n_name AS name, lower(n_name) || '|' || cast(n_regionkey AS string) AS queries FROM nation")
def s7_topic_lists(t):
    listed = F.concat("n_name", F.lit(": "), F.lower("n_name"), F.lit(" , "), F.col("n_regionkey").cast("string"), F.lit(", "))
    lines = t.nation.select((F.col("n_nationkey") * 2).alias("line_no"), listed.alias("value"))
    lines = lines.unionByName(lines.select((F.col("line_no") + 1000).alias("line_no"), F.concat(F.split("value", ":")[0], F.lit(": other")).alias("value"))).unionByName(lines.select("line_no", F.lit("# note").alias("value")))
    return readers.topics(lines).select("name", F.array_join("queries", "|").alias("queries"))


@query("SELECT DISTINCT lower('nation-' || cast(n_nationkey AS string) || '.example') AS domain FROM nation")
def s8_block_lists(t):
    lines = t.instances.select(F.concat(F.lit("  "), "domain", F.lit(" # why")).alias("value")).unionByName(t.instances.select(F.lit("# only a note").alias("value")))
    return readers.blacklist(lines)


@query("SELECT id, language AS lang FROM v_posts WHERE deleted_at IS NULL AND reblog_of_id IS NULL AND length(content) > 0 AND source = 'hashtag'")
def s9_corpus_sink(t):
    path = scratch(t.spark, "export")
    writers.corpus(posts.analysable(t.posts), path)
    return cut(readers.texts(t.spark, path).select("id", "lang"))


KEYS = """acc AS (SELECT a.id, i.domain || '/' || a.mastodon_id AS ref, acct, bot FROM v_accounts a JOIN v_instances i ON i.id = a.instance_id),
post AS (SELECT s.*, i.domain || '/' || s.mastodon_id AS ref FROM v_statuses s JOIN v_instances i ON i.id = s.instance_id),
st AS (SELECT s.*, a.ref AS author, r.ref AS reblog, p.ref AS parent FROM post s JOIN acc a ON a.id = s.account_id LEFT JOIN post r ON r.id = s.reblog_of_id LEFT JOIN post p ON p.id = s.in_reply_to_id)"""


def bundle_lines(b):
    """Every row of a bundle as (table_name, line)."""
    ref = lambda c: F.concat_ws("/", f"{c}.instance_domain", f"{c}.mastodon_id")
    some = lambda c: F.when(F.col(c).isNotNull(), ref(c)).otherwise(F.lit("-"))
    own = F.concat_ws("/", "instance_domain", "mastodon_id")
    lines = {
        "topics": F.col("name"), "instances": F.concat_ws("|", "domain", "discovered_via_topic", F.col("active_users").cast("string")), "accounts": F.concat_ws("|", own, "acct", F.col("bot").cast("string")),
        "statuses": F.concat_ws("|", own, ref("account_ref"), some("reblog_of_ref"), some("in_reply_to_ref"), "source", F.date_format("created_at", "yyyy-MM-dd"), F.coalesce(F.date_format("deleted_at", "yyyy-MM-dd"), F.lit("-"))),
        "status_hashtags": F.concat_ws("|", ref("status_ref"), "hashtag"), "mentions": F.concat_ws("|", ref("status_ref"), "mentioned_acct"),
        "topic_hashtags": F.concat_ws("|", "topic_name", "instance_domain", "hashtag", F.col("usage_count").cast("string")),
        "reblogs": F.concat_ws("|", ref("status_ref"), ref("booster_account_ref")), "follows": F.concat_ws("|", ref("follower_ref"), ref("followed_ref")),
    }
    out = None
    for name, line in lines.items():
        rows = b[name].select(F.lit(name).alias("table_name"), line.alias("line"))
        out = rows if out is None else out.unionByName(rows)
    return out


def tables_of(t):
    """The nine tables of a bundle, with local ids."""
    return {n: getattr(t, n) for n in readers.BUNDLE}


@query(f"""WITH {KEYS} SELECT 'topics' AS table_name, name AS line FROM v_topics
UNION ALL SELECT 'instances', domain || '|' || name || '|' || active_users FROM v_instances i JOIN v_topics t ON t.id = i.topic_id
UNION ALL SELECT 'accounts', ref || '|' || acct || '|' || bot FROM acc
UNION ALL SELECT 'statuses', ref || '|' || author || '|' || coalesce(reblog, '-') || '|' || coalesce(parent, '-') || '|' || source || '|' || strftime(created_at, '%Y-%m-%d') || '|' || coalesce(strftime(deleted_at, '%Y-%m-%d'), '-') FROM st
UNION ALL SELECT 'status_hashtags', ref || '|' || hashtag FROM v_status_hashtags h JOIN post ON post.id = h.status_id
UNION ALL SELECT 'mentions', ref || '|' || mentioned_acct FROM v_mentions m JOIN post ON post.id = m.status_id
UNION ALL SELECT 'topic_hashtags', topic || '|' || domain || '|' || hashtag || '|' || usage_count FROM v_topic_hashtags h JOIN v_instances i ON i.id = h.instance_id
UNION ALL SELECT 'reblogs', post.ref || '|' || acc.ref FROM v_reblogs r JOIN post ON post.id = r.status_id JOIN acc ON acc.id = r.booster_account_id
UNION ALL SELECT 'follows', a.ref || '|' || b.ref FROM v_follows f JOIN acc a ON a.id = f.follower_account_id JOIN acc b ON b.id = f.followed_account_id""")
def s10_bundle_round_trip(t):
    """All nine tables written with natural keys and read back."""
    path = scratch(t.spark, "bundle")
    writers.bundle(merge.export_bundle(tables_of(t)), path)
    return bundle_lines(readers.bundle(t.spark, path))


@query("SELECT id, fast AS probability_fast, bino AS probability_bino, desk AS probability_desk FROM (WITH " + DET.strip() + " SELECT * FROM (SELECT id, fast, bino, desk FROM f FULL JOIN b USING (id) FULL JOIN k USING (id)))")
def s14_merged_scores(t):
    path = scratch(t.spark, "merged")
    writers.merged_scores(detectors(t, four=False), path)
    return cut(t.spark.read.schema("id long, probability_fast double, probability_bino double, probability_desk double").json(path))


@query(f"SELECT id, {BINO} AS ai_probability_pct, {BINO} / 100 AS probability FROM v_scores_bino")
def s14_corrected_scores(t):
    return writers.corrected_scores(t.scores_bino.select("id", S.ai_percentage(F.col("binoculars_score")).alias("ai_probability_pct")))


@query(f"""WITH {BT} SELECT count(*) AS total, count(s) AS scored, count_if(s < 0.9) AS ai, avg(s) AS score_mean, (SELECT count(DISTINCT floor({BINO} / 10)) FROM v_scores_bino) AS n_bins,
(SELECT count(DISTINCT coalesce(nullif(trim(lang), ''), '??')) FROM bt) AS n_languages, (SELECT arg_min(id, (binoculars_score, id)) FROM v_scores_bino) AS lowest FROM ok""")
def s16_report_round_trip(t):
    """The detector report written as one JSON object (and Markdown) and loaded again."""
    texts, path = _bino_texts(t), scratch(t.spark, "report")
    sections = {"bins": statistics.detector_bins(texts), "languages": statistics.by_language(texts), "extremes": statistics.extremes(texts).select("side", "score", "id")}
    writers.write_report(statistics.detector_report(texts), sections, path, "AI detection")
    schema = "total long, scored long, ai long, score_mean double, bins array<struct<bin: int, n: long>>, languages array<struct<lang: string, n: long, ai: long>>, extremes array<struct<side: string, score: double, id: long>>"
    got = readers.report(t.spark, f"{path}/json", schema)
    low = F.array_sort(F.filter("extremes", lambda x: x["side"] == "low"))[0]["id"]
    return cut(got.select("total", "scored", "ai", "score_mean", F.size("bins").cast("long").alias("n_bins"), F.size("languages").cast("long").alias("n_languages"), low.alias("lowest")))


@query("""SELECT id, CASE id % 5 WHEN 0 THEN v / 10.0e0 / 100 WHEN 1 THEN CASE WHEN v / 10.0e0 > 1 THEN v / 10.0e0 / 100 ELSE v / 10.0e0 END WHEN 3 THEN v / 1000.0e0 END AS probability FROM (SELECT id, id * 13 % 1000 AS v FROM v_post_texts)""")
def t8_first_probabilities(t):
    """Percentages, probabilities of several names, a null field (which counts as there), none."""
    v = F.col("id") * 13 % 1000
    tenth, unit = (v / 10.0).cast("string"), (v / 1000.0).cast("string")
    m = F.col("id") % 5
    raw = F.when(m == 1, F.concat(F.lit('{"ai_probability": '), tenth, F.lit("}"))).when(m == 2, F.lit('{"prob": null, "score": 0.3}')).when(m == 3, F.concat(F.lit('{"score": "'), unit, F.lit('", "ai_probability_pct": 99}'))).when(m == 4, F.lit("{}"))
    return t.post_texts.select("id", F.when(m == 0, S.percent_probability(tenth)).otherwise(S.first_probability(raw)).alias("probability"))


EXPORT = """SELECT i.domain || '/' || cast(s.id AS string) AS status, ai.domain || '/' || a.mastodon_id AS account, s.language, s.created_at, s.source, pi.domain || '/' || cast(p.id AS string) AS in_reply_to, ri.domain || '/' || cast(r.id AS string) AS reblog_of
FROM v_statuses s JOIN v_instances i ON i.id = s.instance_id JOIN v_accounts a ON a.id = s.account_id JOIN v_instances ai ON ai.id = a.instance_id LEFT JOIN v_statuses p ON p.id = s.in_reply_to_id LEFT JOIN v_instances pi ON pi.id = p.instance_id
LEFT JOIN v_statuses r ON r.id = s.reblog_of_id LEFT JOIN v_instances ri ON ri.id = r.instance_id"""


@query(EXPORT)
def s10_natural_key_export(t):
    return merge.export_statuses(t.statuses, t.accounts, t.instances)


@query("SELECT source AS src, target AS dst, p_ic, fired, step FROM v_cascade_edges")
def s11_graph_files(t):
    path = scratch(t.spark, "graph")
    writers.graph(t.cascade_nodes, t.cascade_edges.withColumnsRenamed({"source": "src", "target": "dst"}), path)
    return cut(t.spark.read.parquet(f"{path}/edges"))


@query("SELECT id, acct, followers FROM v_cascade_nodes")
def s11_graph_nodes(t):
    path = scratch(t.spark, "graph")
    writers.graph(t.cascade_nodes, t.cascade_edges.withColumnsRenamed({"source": "src", "target": "dst"}), path, "json")
    return cut(t.spark.read.schema("id long, acct string, followers long").json(f"{path}/nodes"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE cast(id % 7 AS double) / 8 END AS ai_probability FROM v_post_texts WHERE id % 11 <> 0")
def s13_typed_rows(t):
    rows = t.post_texts.select(F.when(F.col("id") % 11 == 0, "n/a").otherwise(F.col("id").cast("string")).alias("id"), "lang", "text", F.when(F.col("id") % 3 == 0, "bad").otherwise(((F.col("id") % 7) / 8).cast("string")).alias("ai_probability"))
    return writers.typed_rows(rows).where("id IS NOT NULL").select("id", "ai_probability")


@query("SELECT id, string_agg(url, '; ' ORDER BY k) AS evidence_urls FROM v_claims_evidence WHERE k <> 1 GROUP BY id")
def s15_check_report(t):
    listed = t.claims_evidence.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", F.when(F.col("k") != 1, F.col("url")).alias("url")))).alias("evidence"))
    return writers.check_report(listed).select("id", "evidence_urls")


#: Nodes or edges that a cascade's document has about.
ROWS_A_DOCUMENT = 50_000


def _slices(rows: int) -> int:
    """Documents for so many nodes or edges: a document is read and written as one row."""
    return max(8, -(-rows // ROWS_A_DOCUMENT))


@query("SELECT c_custkey AS id, c_custkey % 4 = 0 AS is_ia FROM customer")
def s18_cascade_document(t):
    """The cascade as one document for each slice of nodes, read back as frames."""
    slices = _slices(t.cascade_nodes.count())
    nodes = t.cascade_nodes.groupBy((F.col("id") % slices).alias("slice")).agg(F.collect_list(F.struct("id", "acct", "followers", "is_ia", "is_seed", "activation_step")).alias("nodes"))
    path = scratch(t.spark, "cascade")
    nodes.select("nodes").write.option("maxRecordsPerFile", 1).json(path)
    return cut(readers.cascade(t.spark, path)["nodes"].select("id", "is_ia"))


@query("""SELECT 'edges' AS part, source AS a, target AS b, fired FROM v_cascade_edges UNION ALL SELECT 'seeds', id, NULL, NULL FROM v_cascade_nodes WHERE is_seed
UNION ALL SELECT 'frames', id, activation_step, NULL FROM v_cascade_nodes WHERE activation_step IS NOT NULL UNION ALL SELECT 'meta', count(*), (SELECT count(*) FROM v_cascade_edges), NULL FROM v_cascade_nodes""")
def s18_cascade_parts(t):
    """The other frames of the document: meta, seeds, edges and frames, each slice's part in a document of its own."""
    nodes, edges = t.cascade_nodes, cut(t.cascade_edges)
    slices = _slices(max(nodes.count(), edges.count()))
    slice_of = lambda *k: F.pmod(F.xxhash64(*k), F.lit(slices)).alias("slice")  # noqa: E731 (of edges by both ends, as a source may have very many)
    of = lambda df, k, item, name: df.groupBy(slice_of(*k)).agg(F.collect_list(item).alias(name))
    frames = nodes.where("activation_step IS NOT NULL").groupBy(slice_of("id"), F.col("activation_step").alias("step")).agg(F.collect_list("id").alias("new_nodes"))
    frames = frames.groupBy("slice").agg(F.collect_list(F.struct("step", "new_nodes")).alias("frames"))
    doc = of(edges, ("source", "target"), F.struct("source", "target", "p_ic", "fired", "step"), "edges").join(of(nodes.where("is_seed"), ("id",), F.col("id"), "seeds"), "slice", "full").join(frames, "slice", "full")
    meta = nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges"))).select(F.lit(0).cast("bigint").alias("slice"), F.struct("nodes", "edges").alias("meta"))
    path = scratch(t.spark, "cascade")
    doc.join(meta, "slice", "full").drop("slice").write.option("maxRecordsPerFile", 1).json(path)
    got = readers.cascade(t.spark, path)
    none = F.lit(None)
    out = got["edges"].select(F.lit("edges").alias("part"), F.col("source").alias("a"), F.col("target").alias("b"), "fired")
    out = out.unionByName(got["seeds"].select(F.lit("seeds").alias("part"), F.col("id").alias("a"), none.cast("long").alias("b"), none.cast("boolean").alias("fired")))
    out = out.unionByName(got["frames"].select(F.lit("frames").alias("part"), F.col("id").alias("a"), F.col("step").cast("long").alias("b"), none.cast("boolean").alias("fired")))
    return cut(out.unionByName(got["meta"].where("nodes IS NOT NULL").select(F.lit("meta").alias("part"), F.col("nodes").alias("a"), F.col("edges").alias("b"), none.cast("boolean").alias("fired"))))


@query("SELECT o_orderkey AS id, lower(substr(o_orderpriority, 3)) AS hashtag FROM orders UNION SELECT cast(floor(o_orderkey / 3.0) AS bigint), 'reblogged' FROM orders WHERE o_orderkey > 0 AND o_orderkey % 7 = 0 AND cast(floor(o_orderkey / 3.0) AS bigint) NOT IN (SELECT o_orderkey FROM orders)")
def t15_status_documents(t):
    account = F.struct(F.col("o_custkey").cast("string").alias("id"), F.lit("a").alias("acct"))
    inner = F.when((F.col("o_orderkey") > 0) & (F.col("o_orderkey") % 7 == 0), F.struct((F.floor(F.col("o_orderkey") / 3)).cast("string").alias("id"), account.alias("account"), F.array(F.struct(F.lit("REBLOGGED").alias("name"))).alias("tags")))
    doc = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("id"), account.alias("account"), F.array(F.struct(F.substr("o_orderpriority", F.lit(3)).alias("name"))).alias("tags"), inner.alias("reblog")))
    rows = readers.status_rows(t.orders.select(doc.alias("raw")))["hashtags"]
    own = rows.where("hashtag <> 'reblogged'")
    return rows.join(own.select("status_id").distinct(), "status_id", "left_anti").unionByName(own).select(F.col("status_id").cast("bigint").alias("id"), "hashtag")


@query("SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS label FROM events GROUP BY 1")
def m1_latest_labels(t):
    rows = t.events.select(F.col("user_id").alias("id"), F.col("event_type").alias("label"), "ts", "event_id")
    return merge.upsert(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), ["id"], ["ts", "event_id"]).select("id", "label")


@query("SELECT user_id, arg_min(event_type, (ts, event_id)) AS source, arg_max(props, (ts, event_id)) AS raw FROM events GROUP BY 1")
def m2_live_upsert(t):
    rows = t.events.select("user_id", F.col("event_type").alias("source"), F.col("props").alias("raw"), "ts", "event_id")
    return merge.live_upsert(rows, ["user_id"], ["source"], ["raw"], ["ts", "event_id"])


@query("SELECT id, acct, id % 3 <> 0 AS was_there FROM v_accounts WHERE id % 2 = 0 OR id % 3 <> 0")
def m3_insert_only(t):
    acc = t.accounts.select("id", "acct")
    merged, _ = merge.insert_only(acc.where("id % 3 <> 0"), acc.where("id % 2 = 0"), ["id"])
    return merged.withColumn("was_there", F.col("id") % 3 != 0)


@query("SELECT 'accounts' AS table_name, count_if(id % 3 = 0) AS new_rows, count_if(id % 3 <> 0) AS existing_rows FROM v_accounts WHERE id % 2 = 0 UNION ALL SELECT 'follows', (SELECT count(*) FROM v_follows WHERE follower_account_id % 2 = 1), (SELECT count(*) FROM v_follows WHERE follower_account_id % 2 = 0)")
def a19_import_summary(t):
    acc = t.accounts.select("id", "acct")
    key = ["follower_account_id", "followed_account_id"]
    flags = {"accounts": merge.insert_only(acc.where("id % 3 <> 0"), acc.where("id % 2 = 0"), ["id"])[1], "follows": merge.insert_only(t.follows.where("follower_account_id % 2 = 0"), t.follows, key)[1]}
    return merge.import_summary(flags)


OLD = """oi AS (SELECT * FROM v_instances WHERE id % 5 <> 0), oa AS (SELECT a.* FROM v_accounts a JOIN oi ON oi.id = a.instance_id WHERE a.id % 2 = 0),
os AS (SELECT s.* FROM v_statuses s JOIN oi ON oi.id = s.instance_id JOIN oa ON oa.id = s.account_id), al AS (SELECT a.* FROM v_accounts a JOIN v_instances i ON i.id = a.instance_id),
sl AS (SELECT s.* FROM v_statuses s JOIN v_instances i ON i.id = s.instance_id JOIN al ON al.id = s.account_id)"""


def _new(name: str, every: str, old: str) -> str:
    return f"SELECT '{name}' AS table_name, ({every}) - ({old}) AS new_rows, ({old}) AS existing_rows"


def _linked(table: str, *ends: tuple[str, str, str]) -> tuple[str, str]:
    """Rows of a table whose ends are among all, and among the existing rows."""
    join = lambda k: " ".join(f"JOIN {e[k]} x{i} ON x{i}.id = t.{e[2]}" for i, e in enumerate(ends))
    return tuple(f"SELECT count(*) FROM {table} t {join(k)}" for k in (0, 1))


@query(f"""WITH {OLD} {_new('topics', 'SELECT count(*) FROM v_topics', 'SELECT count(*) FROM v_topics WHERE id < 3')}
UNION ALL {_new('instances', 'SELECT count(*) FROM v_instances', 'SELECT count(*) FROM oi')} UNION ALL {_new('accounts', 'SELECT count(*) FROM al', 'SELECT count(*) FROM oa')} UNION ALL {_new('statuses', 'SELECT count(*) FROM sl', 'SELECT count(*) FROM os')}
UNION ALL {_new('status_hashtags', *_linked('v_status_hashtags', ('sl', 'os', 'status_id')))} UNION ALL {_new('mentions', *_linked('v_mentions', ('sl', 'os', 'status_id')))}
UNION ALL {_new('topic_hashtags', *_linked('v_topic_hashtags', ('v_topics', '(SELECT * FROM v_topics WHERE id < 3)', 'topic_id'), ('v_instances', 'oi', 'instance_id')))}
UNION ALL {_new('reblogs', *_linked('v_reblogs', ('sl', 'os', 'status_id'), ('al', 'oa', 'booster_account_id')))} UNION ALL {_new('follows', *_linked('v_follows', ('al', 'oa', 'follower_account_id'), ('al', 'oa', 'followed_account_id')))}""")
def m4_bundle_merge(t):
    """A whole bundle merged into tables that hold a part of it."""
    return merge.merge_bundle(_old_tables(t), merge.export_bundle(tables_of(t)))[1]


def _old_tables(t) -> dict:
    new = tables_of(t)
    among = lambda df, ids, c: df.join(ids.select(F.col("id").alias(c)), c, "left_semi")
    old = {"topics": new["topics"].where("id < 3"), "instances": new["instances"].where("id % 5 <> 0")}
    old["accounts"] = among(new["accounts"], old["instances"], "instance_id").where("id % 2 = 0")
    old["statuses"] = among(among(new["statuses"], old["instances"], "instance_id"), old["accounts"], "account_id")
    for c in ("reblog_of_id", "in_reply_to_id"):  # what isn't there can't be referred to
        known = old["statuses"].select(F.col("id").alias(c), F.lit(True).alias("there"))
        old["statuses"] = left_by(old["statuses"], known, c, "id").withColumn(c, F.when(F.col("there"), F.col(c))).drop("there")
    old["statuses"] = cut(old["statuses"].select(*new["statuses"].columns))
    old["status_hashtags"], old["mentions"] = (among(new[n], old["statuses"], "status_id") for n in ("status_hashtags", "mentions"))
    old["topic_hashtags"] = among(among(new["topic_hashtags"], old["topics"], "topic_id"), old["instances"], "instance_id")
    old["reblogs"] = among(among(new["reblogs"], old["statuses"], "status_id"), old["accounts"], "booster_account_id")
    old["follows"] = among(among(new["follows"], old["accounts"], "follower_account_id"), old["accounts"], "followed_account_id")
    return old


#: Keys of the stored tables of a bundle, and the columns that choose a row's folder.
STORED_KEYS = {
    "topics": (["name"], None), "instances": (["domain"], None), "accounts": (["instance_id", "mastodon_id"], None), "statuses": (["instance_id", "mastodon_id"], None),
    "status_hashtags": (["status_id", "hashtag"], ["status_id"]), "mentions": (["status_id", "mentioned_acct"], ["status_id"]), "topic_hashtags": (["topic_id", "instance_id", "hashtag"], None),
    "reblogs": (["status_id", "booster_account_id"], ["status_id"]), "follows": (["follower_account_id", "followed_account_id"], ["follower_account_id"]),
}

MERGED_STATUSES = f"""WITH {OLD} SELECT s.mastodon_id, i.domain, a.mastodon_id AS author, CASE WHEN p.id IN (SELECT id FROM os) OR s.id NOT IN (SELECT id FROM os) THEN p.mastodon_id END AS parent
FROM v_statuses s JOIN v_instances i ON i.id = s.instance_id JOIN v_accounts a ON a.id = s.account_id LEFT JOIN sl p ON p.id = s.in_reply_to_id"""


@query(MERGED_STATUSES)
def m4_merged_statuses(t):
    """The statuses after the merge, with author and parent by their local ids; old rows stay as they are."""
    out = merge.merge_bundle(_old_tables(t), merge.export_bundle(tables_of(t)))[0]
    return _statuses_by_name(cut(out["statuses"]), out["instances"], out["accounts"])


def _statuses_by_name(st, instances, accounts):
    home = instances.select(F.col("id").alias("instance_id"), "domain")
    rows = st.join(home, "instance_id").join(accounts.select(F.col("id").alias("account_id"), F.col("mastodon_id").alias("author")), "account_id")
    return left_by(rows, st.select(F.col("id").alias("in_reply_to_id"), F.col("mastodon_id").alias("parent")), "in_reply_to_id", "id").select("mastodon_id", "domain", "author", "parent")


#: Folders of a stored table in the queries.
FOLDERS = 8


@query("SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS label FROM events GROUP BY 1")
def m1_stored_labels(t):
    """Labels in a stored table, and a batch that changes the folders of its keys."""
    rows = t.events.select(F.col("user_id").alias("id"), F.col("event_type").alias("label"), "ts", "event_id")
    first = merge.latest(rows.where("event_id % 2 = 0"), ["id"], ["ts", "event_id"])
    table = Stored.of(scratch(t.spark, "labels"), first, ["id"], buckets=FOLDERS)
    table.upsert(rows.where("event_id % 2 = 1"), ["ts", "event_id"])
    return table.read(t.spark).select("id", "label")


@query("SELECT user_id, coalesce(arg_min(event_type, (ts, event_id)) FILTER (event_id % 2 = 0), arg_min(event_type, (ts, event_id))) AS source, arg_max(props, (ts, event_id)) AS raw FROM events GROUP BY 1")
def m2_stored_upsert(t):
    """First- and last-seen columns in a stored table; what was stored first stays, though a later batch may have an earlier row."""
    rows = t.events.select("user_id", F.col("event_type").alias("source"), F.col("props").alias("raw"), "ts", "event_id")
    first = merge.live_upsert(rows.where("event_id % 2 = 0"), ["user_id"], ["source"], ["raw", "ts", "event_id"], ["ts", "event_id"])
    table = Stored.of(scratch(t.spark, "live"), first, ["user_id"], buckets=FOLDERS)
    table.live_upsert(rows.where("event_id % 2 = 1"), ["source"], ["ts", "event_id"])
    return table.read(t.spark).select("user_id", "source", "raw")


@query("SELECT id, acct, id % 3 <> 0 AS was_there FROM v_accounts WHERE id % 2 = 0 OR id % 3 <> 0")
def m3_stored_inserts(t):
    acc = t.accounts.select("id", "acct", (F.col("id") % 3 != 0).alias("was_there"))
    table = Stored.of(scratch(t.spark, "accounts"), acc.where("was_there"), ["id"], buckets=FOLDERS)
    table.insert(acc.where("id % 2 = 0").withColumn("was_there", F.lit(False)))
    return table.read(t.spark)


@query(MERGED_STATUSES)
def m4_stored_bundle(t):
    """A whole bundle merged into nine stored tables that hold a part of it."""
    bundle = merge.export_bundle(tables_of(t))
    wide = lambda df: df.withColumns({c: F.col(c).cast("bigint") for c in df.columns if c == "id" or c.endswith("_id") and c != "mastodon_id"})
    tables = {n: Stored.of(scratch(t.spark, n), wide(rows), *STORED_KEYS[n], buckets=FOLDERS) for n, rows in _old_tables(t).items()}
    merge_bundle_into(tables, bundle)
    st, home, acc = (tables[n].read(t.spark) for n in ("statuses", "instances", "accounts"))
    return _statuses_by_name(st, home, acc)


@query("SELECT topic_id, instance_id, hashtag, CASE WHEN topic_id < 2 THEN usage_count + 1 ELSE usage_count END AS usage_count FROM v_topic_hashtags WHERE topic_id >= 2 OR hashtag LIKE '%I%'")
def m5_replace_slice(t):
    rows = t.topic_hashtags.select("topic_id", "instance_id", "hashtag", "usage_count")
    new = rows.where("topic_id < 2").withColumn("usage_count", F.col("usage_count") + 1)
    return merge.replace_slice(rows, new, ["topic_id", "instance_id"]).where("topic_id >= 2 OR hashtag LIKE '%I%'")


@query("SELECT a.id, max(CASE WHEN event_id % 3 = 0 THEN ts END) AS enriched, max(CASE WHEN event_id % 3 = 1 THEN ts END) AS deleted, max(CASE WHEN event_id % 3 = 2 THEN ts END) AS crawled FROM v_accounts a LEFT JOIN events e ON e.user_id = a.id GROUP BY 1")
def m6_progress_markers(t):
    marker = F.element_at(F.array(F.lit("enriched"), F.lit("deleted"), F.lit("crawled")), (F.col("event_id") % 3 + 1).cast("int"))
    return merge.with_markers(t.accounts.select("id"), t.events.select(F.col("user_id").alias("id"), marker.alias("marker"), F.col("ts").alias("at")))


@query("SELECT instance_id, hashtag, max(id) AS last_run FROM v_collection_runs GROUP BY 1, 2")
def m7_append_runs(t):
    runs = t.collection_runs
    return merge.append_run(runs.where("id % 2 = 0"), runs.where("id % 2 = 1")).groupBy("instance_id", "hashtag").agg(F.max("id").alias("last_run"))


@query("SELECT s.id, s.account_id IS NOT NULL AND s.account_id % 4 <> 0 AS resolved FROM v_statuses s JOIN v_accounts a ON a.id = s.account_id")
def j12_resolve_keys(t):
    known = t.accounts.where("id % 4 <> 0").select("id", "mastodon_id")
    rows = t.statuses.join(t.accounts.select(F.col("id").alias("account_id")), "account_id", "left_semi").select("id", F.col("account_id").cast("string").alias("author"))
    found, lost = merge.resolve(rows, known, {"author": "mastodon_id"}, "local_id")
    return found.select("id", F.lit(True).alias("resolved")).unionByName(lost.select("id", F.lit(False).alias("resolved")))


@query("SELECT s.id, p.id AS parent_id FROM v_statuses s LEFT JOIN v_statuses p ON p.id = s.in_reply_to_id AND p.instance_id = s.instance_id")
def j13_parents(t):
    rows = t.statuses.select("id", "instance_id", F.col("id").cast("string").alias("mastodon_id"), F.col("in_reply_to_id").cast("string").alias("in_reply_to_mastodon_id"))
    return merge.resolve_parents(rows).select("id", "parent_id")


MOCK = "greatest(0.4e0, least(1.2e0, 1.1e0 - len([x FOR x IN string_split_regex(text, '\\s+') IF x <> '']) / 400.0e0))"


@query(f"SELECT id, CASE WHEN lang = 'en' THEN {MOCK} END AS score FROM v_post_texts")
def p1_scored_texts(t):
    return scoring.score_texts(t.post_texts, scoring.mock_scorer, lang="en")


@query(f"SELECT id, {MOCK} AS score, {MOCK} > 0.6 AS checkworthy FROM v_post_texts WHERE id NOT IN (SELECT id FROM v_checkworthy)")
def p3_checkworthiness_run(t):
    return scoring.checkworthiness(t.post_texts, t.checkworthy, scoring.mock_scorer)


def sample_judge(claims: pd.DataFrame) -> pd.DataFrame:
    """A stand-in for a user's model: more evidence, more truth."""
    n = claims["evidence"].str.count("\n") + (claims["evidence"] != NO_SOURCE)
    return pd.DataFrame({"verdict": n.map(lambda k: {0: "non verificabile", 1: "Falsi", 2: "misto"}.get(k, "VERA")), "confidence": n / 4.0, "reasoning": "by count"})


@query("""WITH c AS (SELECT p.id, coalesce(e.n, 0) AS n FROM v_post_texts p JOIN v_checkworthy w ON w.id = p.id AND w.score > 0.6 LEFT JOIN (SELECT id, count(*) AS n FROM v_claims_evidence GROUP BY 1) e ON e.id = p.id WHERE lang = 'en' AND p.id NOT IN (SELECT id FROM v_fact_checks))
SELECT id, CASE n WHEN 0 THEN 'non verificabile' WHEN 1 THEN 'falso' WHEN 2 THEN 'misto' ELSE 'vero' END AS verdict, cast(CASE n WHEN 0 THEN 5 WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 4 END AS int) AS veracity, n / 4.0e0 AS confidence FROM c""")
def p4_claim_pipeline(t):
    return scoring.claim_pipeline(t.post_texts, "en", t.checkworthy, t.fact_checks, t.claims_evidence, sample_judge)[0].select("id", "verdict", "veracity", "confidence")


#: Rows that a file of a stream's folder has about.
ROWS_A_DROP = 25_000


def _drops(t, df, name: str) -> tuple[str, int]:
    """A folder of at least four files, as many as the rows need, and how many of them make half of it."""
    path, files = scratch(t.spark, name), max(4, -(-df.count() // ROWS_A_DROP))
    df.repartition(files, df[df.columns[0]]).write.json(path)
    return path, -(-files // 2)


@query("SELECT user_id, arg_min(event_type, event_id) AS source, arg_max(props, event_id) AS raw FROM events GROUP BY 1")
def x1_streamed_collection(t):
    path, half = _drops(t, t.events.select("event_id", "user_id", F.col("event_type").alias("source"), F.col("props").alias("raw")), "drops")
    target, mark = scratch(t.spark, "collected"), scratch(t.spark, "mark")
    jobs.collect(jobs.drops(t.spark, path, "event_id long, user_id long, source string, raw string", half), target, mark, ["user_id"], ["source"], ["raw"], ["event_id"]).awaitTermination()
    return jobs.collected(t.spark, target, ["user_id"], ["source"], ["raw"])


@query(f"SELECT id, {MOCK} AS score FROM v_post_texts")
def x2_streamed_scores(t):
    path, half = _drops(t, t.post_texts, "texts")
    target, mark = scratch(t.spark, "scored"), scratch(t.spark, "mark")
    jobs.score(jobs.drops(t.spark, path, "id long, lang string, text string", half), scoring.mock_scorer, target, mark).awaitTermination()
    return t.spark.read.parquet(target).select("id", "score")


@query("SELECT coalesce(nullif(trim(lang), ''), '??') AS lang, cast(CASE WHEN NOT isnan(probability) THEN least(floor(probability * 5), 4) ELSE -1 END AS int) AS bin, count(*) AS n FROM v_post_texts JOIN v_scores_fast USING (id) GROUP BY 1, 2")
def x3_streamed_counts(t):
    path, half = _drops(t, t.post_texts.select("id", "lang").join(t.scores_fast, "id").select("id", "lang", "probability"), "rows")
    target = scratch(t.spark, "counts")
    jobs.live_counts(jobs.drops(t.spark, path, "id long, lang string, probability double", half), target, scratch(t.spark, "mark")).awaitTermination()
    return jobs.counted(t.spark, target).select("lang", "bin", "n")


@query("SELECT user_id, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1")
def x1_since_cursor(t):
    """Two runs of which the second delivers again what the first did: nothing is collected twice."""
    rows = t.events.select("event_id", "user_id", F.col("event_type").alias("tag"))
    path, target, mark = scratch(t.spark, "since"), scratch(t.spark, "beyond"), scratch(t.spark, "mark")
    for part in (rows.where(F.col("event_id") <= F.lit(rows.agg(F.expr("(min(event_id) + max(event_id)) div 2")).first()[0])), rows):
        part.write.mode("append").json(path)
        fresh = jobs.since_cursor(jobs.drops(t.spark, path, "event_id long, user_id long, tag string"), ["user_id", "tag"], "event_id")
        jobs.append_log(fresh, target, mark).awaitTermination()
    return t.spark.read.parquet(target).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


@query("SELECT event_id AS id, date_trunc('milliseconds', ts) AS created_at, props AS raw FROM events WHERE date_trunc('milliseconds', ts) <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 DAY FROM events)")
def x4_due_posts(t):
    """Posts (times in milliseconds, as JSON has them) that the stream has left ten days behind, each once, with their newest counters, whatever order and repeats they came in."""
    rows = t.events.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("props").alias("raw"))
    seen = rows.withColumn("seen_at", F.col("created_at") + F.expr("interval 2 hours"))
    both = seen.unionByName(rows.withColumn("raw", F.lit("{}")).withColumn("seen_at", F.col("created_at"))).unionByName(seen.where("id % 3 = 0"))
    (path, _), target = _drops(t, both, "interactions"), scratch(t.spark, "due")
    stream = jobs.drops(t.spark, path, "id long, created_at timestamp, raw string, seen_at timestamp")
    jobs.due(stream, 10, target, scratch(t.spark, "mark")).awaitTermination()
    return t.spark.read.parquet(target).select("id", "created_at", "raw")


@query("""SELECT id, language, CASE WHEN id % 2 = 0 THEN '{"reblogs_count": ' || cast(id % 9 AS string) || '}' ELSE raw END AS raw FROM v_posts""")
def x4_enriched_posts(t):
    fresh = t.posts.where("id % 2 = 0").select("id", F.concat(F.lit('{"reblogs_count": '), (F.col("id") % 9).cast("string"), F.lit("}")).alias("raw"), F.lit("2030-01-01").cast("timestamp").alias("seen_at"))
    (path, half), target, mark = _drops(t, fresh, "counters"), scratch(t.spark, "counted"), scratch(t.spark, "mark")
    stream = jobs.drops(t.spark, path, "id long, raw string, seen_at timestamp", half)
    return jobs.re_enrich(t.posts, stream, target, mark).select("id", "language", "raw")
