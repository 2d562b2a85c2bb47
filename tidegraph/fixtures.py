"""The social-network tables, derived from the given tables by SQL that Spark and DuckDB share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "v_instances": """
SELECT n_nationkey AS id, 'nation-' || cast(n_nationkey AS string) || '.example' AS domain,
       cast((n_nationkey * 37) % 500 AS int) AS active_users, n_regionkey AS topic_id
FROM nation
""",
    "v_topics": """
SELECT r_regionkey AS id, r_name AS name FROM region
""",
    "v_accounts": """
SELECT c_custkey AS id, c_nationkey AS instance_id, cast(c_custkey AS string) AS mastodon_id,
       CASE WHEN c_custkey % 3 = 0
            THEN 'user' || cast(c_custkey % 211 AS string) || '@nation-' || cast(c_custkey % 5 AS string) || '.example'
            ELSE 'user' || cast(c_custkey % 211 AS string) END AS acct,
       'user' || cast(c_custkey % 211 AS string) AS username,
       c_mktsegment = 'MACHINERY' AS bot,
       cast(floor(abs(c_acctbal)) AS bigint) AS followers,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 1 END AS timeline_crawled
FROM customer
""",
    "v_statuses": """
SELECT o_orderkey AS id, cast(o_custkey % 25 AS int) AS instance_id, o_custkey AS account_id, cast(o_orderkey AS string) AS mastodon_id,
       CASE o_orderkey % 6 WHEN 0 THEN 'en' WHEN 1 THEN 'en' WHEN 2 THEN 'it'
                           WHEN 3 THEN 'es' WHEN 4 THEN 'fr' ELSE NULL END AS language,
       o_orderdate AS created_at,
       CASE WHEN o_orderkey > 0 AND o_orderkey % 7 = 0
            THEN cast(floor(o_orderkey / 3.0) AS bigint) END AS reblog_of_id,
       CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0
            THEN cast(floor(o_orderkey / 4.0) AS bigint) END AS in_reply_to_id,
       CASE WHEN o_orderkey % 4 = 0 THEN 'user_timeline' ELSE 'hashtag' END AS source,
       CASE WHEN o_orderkey % 41 = 40 THEN o_orderdate END AS deleted_at
FROM orders
""",
    "v_reblogs": """
SELECT DISTINCT l_orderkey AS status_id, cast(floor(l_partkey * 0.75) AS bigint) AS booster_account_id
FROM lineitem WHERE l_linenumber <= 2
""",
    "v_mentions": """
SELECT DISTINCT l_orderkey AS status_id,
       CASE WHEN l_partkey % 3 = 0
            THEN 'user' || cast(l_partkey % 211 AS string) || '@nation-' || cast(l_partkey % 5 AS string) || '.example'
            ELSE 'user' || cast(l_partkey % 211 AS string) END AS mentioned_acct
FROM lineitem WHERE l_linenumber = 3
""",
    "v_follows": """
SELECT DISTINCT cast(floor(l_partkey * 0.75) AS bigint) AS follower_account_id, cast(floor(l_orderkey / 10.0) AS bigint) AS followed_account_id
FROM lineitem WHERE cast(floor(l_partkey * 0.75) AS bigint) <> cast(floor(l_orderkey / 10.0) AS bigint)
""",
    "v_status_hashtags": """
SELECT o_orderkey AS status_id, lower(substr(o_orderpriority, 3)) AS hashtag FROM orders
""",
    "v_topic_hashtags": """
SELECT r.r_regionkey AS topic_id, r.r_name AS topic, n.n_nationkey AS instance_id, h.hashtag,
       cast((n.n_nationkey * 13 + r.r_regionkey) % 50 AS int) AS usage_count
FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey
JOIN (SELECT DISTINCT upper(substr(o_orderpriority, 3)) AS hashtag, cast(substr(o_orderpriority, 1, 1) AS int) - 1 AS k
      FROM orders) h ON h.k = r.r_regionkey
""",
    "v_post_texts": """
SELECT doc_id AS id, CASE WHEN doc_id % 29 = 0 THEN NULL ELSE lang END AS lang, text FROM documents
""",
    "v_scores_fast": """
SELECT doc_id AS id,
       CASE WHEN doc_id % 97 = 5 THEN cast('NaN' AS double) ELSE (doc_id * 7919 % 1001) / 1000.0e0 END AS probability,
       (doc_id * 31 % 700) / 100.0e0 AS criterion, cast(8 + doc_id % 400 AS int) AS ntokens
FROM documents WHERE doc_id % 13 <> 0
""",
    "v_scores_ada": """
SELECT doc_id AS id, (doc_id * 5003 % 1001) / 1000.0e0 AS probability FROM documents WHERE doc_id % 17 <> 0
""",
    "v_scores_bino": """
SELECT doc_id AS id, 0.4e0 + (doc_id * 6151 % 801) / 1000.0e0 AS binoculars_score FROM documents
""",
    "v_scores_desk": """
SELECT doc_id AS id, CASE WHEN lang = 'en' THEN (doc_id * 1237 % 1001) / 1000.0e0 END AS ai_probability FROM documents
""",
    "v_checkworthy": """
SELECT doc_id AS id, (doc_id * 31 % 101) / 100.0e0 AS score FROM documents WHERE doc_id % 19 <> 0
""",
    "v_fact_checks": """
SELECT doc_id AS id,
       CASE doc_id % 8 WHEN 0 THEN 'Vera' WHEN 1 THEN 'falsi' WHEN 2 THEN 'misto' WHEN 3 THEN 'perlopiù vero'
            WHEN 4 THEN 'perlopiù falso' WHEN 5 THEN 'non verificabile' WHEN 6 THEN ' FALSO ' ELSE '' END AS verdict,
       CASE WHEN doc_id % 8 = 7 THEN 'x' ELSE cast(doc_id % 6 AS string) END AS veracity
FROM documents WHERE doc_id % 3 = 0
""",
    "v_collection_runs": """
SELECT event_id AS id, cast(user_id % 25 AS int) AS instance_id, event_type AS hashtag,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE cast(event_id AS string) END AS max_id_cursor,
       ts AS started_at, props AS raw
FROM events
""",
    "v_cascade_nodes": """
SELECT c_custkey AS id, 'user' || cast(c_custkey AS string) AS acct, cast(floor(abs(c_acctbal)) AS bigint) AS followers,
       c_custkey % 4 = 0 AS is_ia, c_custkey % 20 = 0 AS is_seed,
       CASE WHEN c_custkey % 20 = 0 THEN 0 WHEN c_custkey % 3 = 0 THEN cast(1 + c_custkey % 11 AS int) END AS activation_step
FROM customer
""",
    "v_cascade_edges": """
SELECT followed_account_id AS source, follower_account_id AS target, 0.01e0 + (followed_account_id % 10) / 100.0e0 AS p_ic,
       (followed_account_id + follower_account_id) % 3 = 0 AS fired, cast(1 + (followed_account_id + follower_account_id) % 11 AS int) AS step
FROM (SELECT DISTINCT cast(floor(l_partkey * 0.75) AS bigint) AS follower_account_id, cast(floor(l_orderkey / 10.0) AS bigint) AS followed_account_id FROM lineitem) f
WHERE followed_account_id <> follower_account_id
""",
    "v_posts": """
SELECT d.doc_id AS id, s.instance_id, s.account_id, s.language, s.created_at, s.reblog_of_id, s.in_reply_to_id, s.source, s.deleted_at,
       CASE WHEN d.doc_id % 31 = 7 THEN '' ELSE '<p>' || d.text || '</p>' END AS content,
       '{"reblogs_count": ' || cast(d.doc_id % 4 AS string) || ', "replies_count": "' || cast(d.doc_id % 3 AS string) || '"}' AS raw,
       CASE WHEN d.doc_id % 2 = 0 THEN s.created_at END AS enriched_at,
       CASE WHEN d.doc_id % 5 = 0 THEN cast(d.doc_id % 6 AS int) END AS veracity
FROM documents d JOIN (
SELECT o_orderkey AS id, cast(o_custkey % 25 AS int) AS instance_id, o_custkey AS account_id,
       CASE o_orderkey % 6 WHEN 0 THEN 'en' WHEN 1 THEN 'en' WHEN 2 THEN 'it' WHEN 3 THEN 'es' WHEN 4 THEN 'fr' ELSE NULL END AS language,
       o_orderdate AS created_at,
       CASE WHEN o_orderkey > 0 AND o_orderkey % 7 = 0 THEN cast(floor(o_orderkey / 3.0) AS bigint) END AS reblog_of_id,
       CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 THEN cast(floor(o_orderkey / 4.0) AS bigint) END AS in_reply_to_id,
       CASE WHEN o_orderkey % 4 = 0 THEN 'user_timeline' ELSE 'hashtag' END AS source,
       CASE WHEN o_orderkey % 41 = 40 THEN o_orderdate END AS deleted_at
FROM orders) s ON s.id = d.doc_id
""",
    "v_claims_evidence": """
SELECT doc_id AS id, k, 'title ' || cast(k AS string) AS title, 'http://e.example/' || cast(doc_id AS string) || '/' || cast(k AS string) AS url,
       'snippet ' || cast((doc_id * 7 + k) % 13 AS string) AS snippet
FROM documents CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) n WHERE doc_id % 4 > k
""",
}


class Tables:
    """The given tables and the views over them, as DataFrames by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._view(VIEWS[f"v_{name}"])

    def repeated(self, name: str) -> DataFrame:
        """A view that starts with DISTINCT without it, for uses where repeated rows make no difference; they need no shuffle."""
        return self._view(re.sub(r"^\s*SELECT DISTINCT\b", "SELECT", VIEWS[f"v_{name}"]))

    def _view(self, sql: str) -> DataFrame:
        named = {t: getattr(self, t) for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)}
        sql = re.sub(r"[{}]", lambda m: m[0] * 2, sql)
        for t in named:  # frames go in by name, so no view of the caller's session is replaced
            sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
        return self.spark.sql(sql, **named)


def with_views(sql: str) -> str:
    """A query with the definitions of the views that it names."""
    named = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in named)
    body = sql.strip()
    if not named:
        return body
    if re.match(r"(?i)with\s+recursive\b", body):
        return f"WITH RECURSIVE {ctes},\n" + re.sub(r"(?i)^with\s+recursive\b", "", body)
    if re.match(r"(?i)with\b", body):
        return f"WITH {ctes},\n" + re.sub(r"(?i)^with\b", "", body)
    return f"WITH {ctes}\n{body}"
