"""Queries over posts, scores and accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegraph.functions import scores as S
from tidegraph.functions import text as T
from tidegraph.operators import accounts, compare, posts, statistics

from .registry import query

P = "CASE WHEN NOT isnan(probability) THEN probability END"
CLEAN = "trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(content, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))"
BINO = "round_even(100 / (1 + exp(25 * (binoculars_score - 0.9))), 2)"
DET = f"""
f AS (SELECT id, {P} AS fast FROM v_scores_fast), a AS (SELECT id, probability AS ada FROM v_scores_ada),
b AS (SELECT id, {BINO} / 100 AS bino FROM v_scores_bino), k AS (SELECT id, ai_probability AS desk FROM v_scores_desk),
j AS (SELECT id, fast, bino, desk, ada FROM f FULL JOIN b USING (id) FULL JOIN k USING (id) FULL JOIN a USING (id))"""


def detectors(t, four: bool = True):
    out = {
        "fast": t.scores_fast.select("id", "probability"),
        "bino": t.scores_bino.select("id", (S.ai_percentage(F.col("binoculars_score")) / 100).alias("probability")),
        "desk": t.scores_desk.select("id", F.col("ai_probability").alias("probability")),
    }
    if four:
        out["ada"] = t.scores_ada
    return out


@query(f"SELECT b AS bin, coalesce(n, 0) AS n FROM (SELECT cast(range AS int) AS b FROM range(5)) LEFT JOIN (SELECT cast(least(floor(p * 5), 4) AS int) AS b, count(*) AS n FROM (SELECT {P} AS p FROM v_scores_fast) WHERE p IS NOT NULL GROUP BY 1) USING (b)")
def a5_probability_histogram(t):
    return statistics.histogram(t.scores_fast)


@query(f"SELECT id, length(text) AS n_chars, md5(text) AS digest FROM (SELECT id, {CLEAN} AS text FROM v_posts WHERE deleted_at IS NULL AND reblog_of_id IS NULL AND length(content) > 0 AND source = 'hashtag') WHERE length(text) > 0")
def f1_analysable_posts(t):
    return posts.analysable(t.posts).select("id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


@query("SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&lt;', '<'), '&amp;', '&'), '&amp', '&'), '\\s+', ' ', 'g')) AS text FROM pages")
def t1_clean_pages(t):
    return t.pages.select("page_id", T.clean_html(F.col("html")).alias("text"))


@query("SELECT id, account_id FROM v_posts WHERE veracity IS NULL AND deleted_at IS NULL AND reblog_of_id IS NULL AND length(content) > 0")
def f2_to_fact_check(t):
    return posts.to_fact_check(t.posts).select("id", "account_id")


@query("SELECT id FROM v_posts WHERE deleted_at IS NULL AND (enriched_at IS NULL OR enriched_at < TIMESTAMP '1998-08-02' - INTERVAL 400 DAY) AND (coalesce(try_cast(raw->>'$.reblogs_count' AS bigint), 0) > 0 OR coalesce(try_cast(raw->>'$.replies_count' AS bigint), 0) > 0)")
def f3_to_enrich(t):
    return posts.to_enrich(t.posts, F.lit("1998-08-02").cast("timestamp"), 400).select("id")


@query("""SELECT a.id FROM v_accounts a WHERE timeline_crawled IS NULL AND (
  EXISTS (SELECT 1 FROM v_reblogs r WHERE r.booster_account_id = a.id)
  OR EXISTS (SELECT 1 FROM v_statuses s JOIN v_reblogs r ON r.status_id = s.id WHERE s.account_id = a.id)
  OR EXISTS (SELECT 1 FROM v_statuses s WHERE s.account_id = a.id AND s.in_reply_to_id IS NOT NULL)
  OR EXISTS (SELECT 1 FROM v_statuses p JOIN v_statuses s ON s.in_reply_to_id = p.id WHERE p.account_id = a.id)
  OR EXISTS (SELECT 1 FROM v_mentions m WHERE m.mentioned_acct = a.acct))""")
def f4_accounts_to_crawl(t):
    return accounts.to_crawl(t.accounts, t.statuses, t.reblogs, t.mentions).select("id")


def _crawl_state(t):
    return t.accounts.withColumns({
        "followers_crawled": F.when(F.col("id") % 3 != 0, 1), "following_crawled": F.when(F.col("id") % 4 != 0, 1),
        "fetched_at": F.timestamp_seconds(F.lit(900_000_000) + F.col("id") * 86400),
    })


@query("""SELECT a.id, i.domain, a.id % 3 = 0 AS need_followers, a.id % 4 = 0 AS need_following FROM v_accounts a JOIN v_instances i ON i.id = a.instance_id
WHERE (a.id % 3 = 0 OR a.id % 4 = 0) AND make_timestamp((900000000 + a.id * 86400) * 1000000) < TIMESTAMP '1999-01-01'""")
def f5_follow_crawl(t):
    return accounts.to_follow_crawl(_crawl_state(t), t.instances, before=F.lit("1999-01-01").cast("timestamp")).select("id", "domain", "need_followers", "need_following")


@query("""SELECT s.id FROM v_statuses s WHERE reblog_of_id IS NOT NULL OR (language IN ('en', 'it', 'es', 'ro')
AND EXISTS (SELECT 1 FROM v_status_hashtags h JOIN (SELECT DISTINCT lower(hashtag) AS hashtag FROM v_topic_hashtags WHERE topic_id < 3) k ON k.hashtag = lower(h.hashtag) WHERE h.status_id = s.id))""")
def f6_keep_timeline(t):
    tags = t.status_hashtags.groupBy(F.col("status_id").alias("id")).agg(F.collect_set("hashtag").alias("tags"))
    return posts.keep_timeline(t.statuses.join(tags, "id", "left"), t.topic_hashtags.where("topic_id < 3"), ("en", "it", "es", "ro")).select("id")


@query("SELECT s.id, n.newest_id FROM v_statuses s CROSS JOIN (SELECT arg_max(id, (created_at, id)) AS newest_id FROM v_statuses) n WHERE language IN ('en', 'it', 'es', 'ro')")
def f7_allowed_languages(t):
    some, newest = posts.allowed_languages(t.statuses, ("en", "it", "es", "ro"))
    return some.select("id").crossJoin(newest)


@query("SELECT id, lang FROM v_post_texts p WHERE NOT EXISTS (SELECT 1 FROM v_checkworthy c WHERE c.id = p.id)")
def f8_not_done(t):
    return posts.not_done(t.post_texts, t.checkworthy).select("id", "lang")


@query("SELECT p.id, c.score FROM v_post_texts p JOIN v_checkworthy c USING (id) WHERE c.score > 0.6")
def f9_checkworthy(t):
    return t.post_texts.join(posts.checkworthy(t.checkworthy), "id").select("id", "score")


@query(f"SELECT id FROM v_scores_fast WHERE {P} >= 0.5")
def f10_at_least(t):
    return posts.at_least(t.scores_fast)


@query(f"SELECT id, p AS probability, CASE least(floor(p * 4), 3) WHEN 0 THEN '0-25' ELSE '75-100' END AS quartile FROM (SELECT id, {P} AS p FROM v_scores_fast) WHERE p IS NOT NULL AND least(floor(p * 4), 3) IN (0, 3)")
def f11_quartiles(t):
    return posts.in_quartiles(t.scores_fast, ("0-25", "75-100")).select("id", "probability", "quartile")


V = "CASE WHEN lower(trim(verdict)) IN ('vero', 'vera', 'veri', 'vere') THEN 'vero' WHEN lower(trim(verdict)) IN ('falso', 'falsa', 'falsi', 'false') THEN 'falso' ELSE lower(trim(verdict)) END"


@query(f"SELECT c.id, {V} AS verdict FROM v_fact_checks c JOIN documents d ON d.doc_id = c.id WHERE {V} IN ('vero', 'misto') AND contains(lower(d.text), 'tion')")
def f12_search_checks(t):
    checks = t.fact_checks.withColumn("verdict", T.normalize_verdict(F.col("verdict"))).join(t.post_texts.select("id", "text"), "id").withColumn("reasoning", F.lit(None).cast("string"))
    return posts.search_checks(checks, ("vero", "misto"), "TION").select("id", "verdict")


@query("SELECT id, acct, bot FROM v_accounts WHERE acct ILIKE '%user12%' OR username ILIKE '%user12%' ORDER BY bot DESC, id LIMIT 20")
def f19_account_search(t):
    return accounts.search(t.accounts, "USER12").select("id", "acct", "bot")


def _voted(kind_sql: str) -> str:
    return f"WITH {DET}, l AS (SELECT id, coalesce(fast >= 0.5, false) AS f, coalesce(bino >= 0.5, false) AS b, coalesce(desk >= 0.5, false) AS k, coalesce(ada >= 0.5, false) AS a FROM j), v AS (SELECT *, cast(f AS int) + cast(b AS int) + cast(k AS int) + cast(a AS int) AS votes FROM l) SELECT id, votes FROM v WHERE {kind_sql}"


def _vote(t, kind: str):
    names = ["fast", "bino", "desk", "ada"]
    rows = compare.labels(compare.joined(detectors(t)), names, 0.5, True).withColumn("votes", compare.votes(names))
    return compare.vote_filter(rows, names, kind).select("id", "votes")


@query(_voted("votes = 4"))
def f20_unanimous_ai(t):
    return _vote(t, "unanimous_ai")


@query(_voted("votes = 0"))
def f20_unanimous_human(t):
    return _vote(t, "unanimous_human")


@query(_voted("votes = 3"))
def f20_exactly_3(t):
    return _vote(t, "exactly_3")


@query(_voted("k AND votes = 1"))
def f20_desk_only(t):
    return _vote(t, "desk_only")


@query(f"WITH {DET} SELECT id FROM j WHERE id IN (SELECT p.id FROM v_posts p JOIN v_accounts a ON a.id = p.account_id WHERE a.bot)")
def f20_bots_only(t):
    bots = t.posts.join(t.accounts.where("bot").select(F.col("id").alias("account_id")), "account_id", "left_semi")
    return compare.vote_filter(compare.joined(detectors(t)), [], "bots_only", bots).select("id")


@query(f"SELECT p.id, a.acct, a.bot, i.domain, md5({CLEAN}) AS digest FROM v_posts p JOIN v_accounts a ON a.id = p.account_id JOIN v_instances i ON i.id = p.instance_id WHERE deleted_at IS NULL")
def j1_posts_with_authors(t):
    return posts.with_authors(t.posts, t.accounts, t.instances).select("id", "acct", "bot", "domain", F.md5("content").alias("digest"))


@query(f"SELECT id, account_id FROM v_posts WHERE deleted_at IS NULL AND id IN (SELECT id FROM v_scores_fast WHERE {P} >= 0.9)")
def j2_by_ids(t):
    return posts.by_ids(posts.live(t.posts), posts.at_least(t.scores_fast, 0.9)).select("id", "account_id")


@query(f"WITH {DET} SELECT p.id, fast, bino, desk, ada FROM v_posts p LEFT JOIN j USING (id) WHERE deleted_at IS NULL")
def j3_posts_with_detectors(t):
    scored = {n: d.withColumn("probability", S.present(F.col("probability"))) for n, d in detectors(t).items()}
    return posts.with_detectors(posts.live(t.posts).select("id"), scored)


@query(f"WITH {DET} SELECT p.id, i.domain, fast, desk, {V} AS verdict FROM v_posts p JOIN v_accounts a ON a.id = p.account_id JOIN v_instances i ON i.id = p.instance_id LEFT JOIN j ON j.id = p.id LEFT JOIN v_fact_checks c ON c.id = p.id WHERE deleted_at IS NULL")
def j4_post_details(t):
    scored = {n: d.withColumn("probability", S.present(F.col("probability"))) for n, d in detectors(t).items() if n in ("fast", "desk")}
    rows = posts.with_detectors(posts.with_authors(t.posts, t.accounts, t.instances).select("id", "domain"), scored)
    return rows.join(t.fact_checks.select("id", T.normalize_verdict(F.col("verdict")).alias("verdict")), "id", "left")


@query(f"WITH {DET} SELECT * FROM j")
def j5_all_scores(t):
    return compare.joined(detectors(t))


@query("SELECT p.id FROM v_posts p WHERE deleted_at IS NULL AND reblog_of_id IS NULL AND length(content) > 0 AND id IN (SELECT id FROM v_checkworthy WHERE score > 0.6)")
def j6_eligible_checkworthy(t):
    return posts.by_ids(posts.eligible(t.posts), posts.checkworthy(t.checkworthy)).select("id")


@query("SELECT DISTINCT s.status_id, k.topic FROM v_status_hashtags s JOIN v_topic_hashtags k ON lower(k.hashtag) = lower(s.hashtag)")
def j7_post_topics(t):
    return posts.post_topics(t.status_hashtags, t.topic_hashtags)


@query("""SELECT p.id, coalesce(e.lines, '(nessuna fonte trovata)') AS evidence FROM v_post_texts p
LEFT JOIN (SELECT id, string_agg('- ' || title || ': ' || snippet || ' (' || url || ')', chr(10) ORDER BY k) AS lines FROM v_claims_evidence GROUP BY id) e USING (id)""")
def j18_claims_with_evidence(t):
    return posts.claims_with_evidence(t.post_texts.select("id"), t.claims_evidence)


@query("SELECT f.follower_account_id AS src, f.followed_account_id AS dst FROM v_follows f JOIN v_accounts a ON a.id = f.follower_account_id JOIN v_accounts b ON b.id = f.followed_account_id WHERE a.bot OR b.bot")
def j10_follow_links(t):
    return accounts.topology(t.follows, t.accounts, "any_bot")[0]


@query("""WITH l AS (SELECT f.follower_account_id AS src, f.followed_account_id AS dst FROM v_follows f JOIN v_accounts a ON a.id = f.follower_account_id JOIN v_accounts b ON b.id = f.followed_account_id WHERE a.bot OR b.bot),
d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM l UNION ALL SELECT dst FROM l) GROUP BY id)
SELECT d.id, '@' || acct AS label, CASE WHEN contains(acct, '@') THEN split_part(acct, '@', -1) ELSE 'fediverse' END AS domain, degree, CASE WHEN bot THEN 'bot' WHEN degree >= 4 THEN 'instance' ELSE 'human' END AS node_group FROM d JOIN v_accounts a USING (id)""")
def j10_follow_nodes(t):
    return accounts.topology(t.follows, t.accounts, "any_bot")[1]


@query("""SELECT a.id, '@' || acct AS label, username, CASE WHEN a.id % 4 = 1 THEN 'Name ' || username ELSE username END AS display_name, bot, s.domain, CASE WHEN a.id % 2 = 0 THEN 'note ' || a.id ELSE '' END AS note,
CASE WHEN a.id % 5 = 0 THEN 'http://a.example/' || a.id END AS avatar, cast(NULL AS varchar) AS header, CASE WHEN a.id % 6 = 0 THEN 'http://u.example/' || a.id ELSE 'https://' || s.domain || '/@' || username END AS url,
CASE WHEN a.id % 2 = 0 THEN followers ELSE coalesce(i.n, 0) END AS followers, CASE WHEN a.id % 3 = 0 THEN a.id % 90 ELSE coalesce(o.n, 0) END AS following, CASE WHEN a.id % 7 = 0 THEN 0 ELSE coalesce(p.n, 0) END AS statuses,
CASE WHEN a.id % 2 = 0 THEN '2020-01-01' END AS created_at, cast(NULL AS varchar) AS last_status_at, CASE WHEN a.id % 4 = 3 THEN '[{"name":"k"}]' ELSE '[]' END AS fields FROM v_accounts a JOIN v_instances s ON s.id = a.instance_id
LEFT JOIN (SELECT followed_account_id AS id, count(*) AS n FROM v_follows GROUP BY 1) i ON i.id = a.id LEFT JOIN (SELECT follower_account_id AS id, count(*) AS n FROM v_follows GROUP BY 1) o ON o.id = a.id
LEFT JOIN (SELECT account_id AS id, count(*) AS n FROM v_statuses GROUP BY 1) p ON p.id = a.id""")
def j14_account_details(t):
    i = F.col("id")
    text = lambda m, r, value: F.when(i % m == r, value)
    fields = {
        "followers_count": text(2, 0, F.col("followers")), "following_count": text(3, 0, i % 90), "statuses_count": text(7, 0, F.lit(0)), "note": text(2, 0, F.concat(F.lit("note "), i)), "created_at": text(2, 0, F.lit("2020-01-01")),
        "display_name": F.when(i % 4 == 1, F.concat(F.lit("Name "), "username")).when(i % 4 == 2, F.lit("")), "avatar_static": text(5, 0, F.concat(F.lit("http://a.example/"), i)), "uri": text(6, 0, F.concat(F.lit("http://u.example/"), i)),
        "fields": text(4, 3, F.array(F.struct(F.lit("k").alias("name")))),
    }
    raw = F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    return accounts.detail(t.accounts.withColumn("raw", raw), t.follows, t.statuses, t.instances)


@query("SELECT DISTINCT c.id AS centre, follower_account_id AS src, followed_account_id AS dst FROM v_follows f JOIN (SELECT id FROM v_accounts WHERE bot) c ON c.id = f.follower_account_id OR c.id = f.followed_account_id")
def j15_ego_networks(t):
    return accounts.ego_links(t.follows, t.accounts.where("bot"))


@query("SELECT id, domain, active_users FROM v_instances WHERE domain NOT IN (SELECT 'nation-' || cast(r_regionkey AS string) || '.example' FROM region)")
def j16_not_blacklisted(t):
    listed = t.region.select(F.concat(F.lit("nation-"), F.col("r_regionkey").cast("string"), F.lit(".example  # region")).alias("value"))
    from tidegraph.sources.readers import blacklist

    return accounts.not_blacklisted(t.instances, blacklist(listed)).select("id", "domain", "active_users")


@query("SELECT (SELECT count(*) FROM v_statuses WHERE deleted_at IS NULL) AS posts, (SELECT count(*) FROM v_follows) AS follows")
def a1_counts(t):
    return statistics.counts(t.statuses, t.follows)


@query("SELECT b AS bot, count(a.id) AS n, 100.0e0 * count(a.id) / (SELECT count(*) FROM v_accounts) AS pct FROM (SELECT true AS b UNION ALL SELECT false) x LEFT JOIN v_accounts a ON a.bot = x.b GROUP BY b")
def a2_accounts_by_bot(t):
    return statistics.accounts_by_bot(t.accounts)


@query("SELECT DISTINCT language FROM v_statuses WHERE language IS NOT NULL AND deleted_at IS NULL")
def a3_languages(t):
    return statistics.languages(t.statuses)


@query("""WITH e AS (SELECT id FROM v_posts WHERE deleted_at IS NULL AND reblog_of_id IS NULL AND length(content) > 0 AND language IN ('en', 'it', 'es')),
n AS (SELECT (SELECT count(*) FROM e) AS eligible, (SELECT count(*) FROM e WHERE id IN (SELECT id FROM v_checkworthy WHERE score > 0.6)) AS worthy, (SELECT count(*) FROM v_fact_checks) AS done)
SELECT eligible, worthy, done, greatest(done, worthy) AS denominator, CASE WHEN greatest(done, worthy) > 0 THEN 100.0e0 * done / greatest(done, worthy) ELSE 0 END AS pct FROM n""")
def a4_progress(t):
    return statistics.progress(posts.eligible(t.posts), posts.checkworthy(t.checkworthy), t.fact_checks, ("en", "it", "es"))


@query("""WITH r AS (SELECT CASE WHEN NOT isnan(probability) THEN probability END AS p, criterion AS c, ntokens FROM v_scores_fast), v AS (SELECT * FROM r WHERE p IS NOT NULL)
SELECT count(*) AS n, avg(p) * 100 AS mean, quantile_cont(p, 0.5) * 100 AS median, stddev_pop(p) * 100 AS std, min(p) * 100 AS "min", max(p) * 100 AS "max", avg(c) AS criterion_mean, min(c) AS criterion_min, max(c) AS criterion_max, avg(ntokens) AS avg_tokens FROM v""")
def a6_descriptive(t):
    return statistics.descriptive(t.scores_fast)


@query("SELECT c AS criterion_median FROM (SELECT criterion AS c, row_number() OVER (ORDER BY criterion) - 1 AS rn, count(*) OVER () AS n FROM v_scores_fast WHERE NOT isnan(probability)) WHERE rn = n // 2")
def a6_criterion_median(t):
    return statistics.criterion_median(t.scores_fast)


@query(f"SELECT b AS bin, coalesce(n, 0) AS n, 100.0e0 * coalesce(n, 0) / (SELECT count(*) FROM v_scores_fast WHERE NOT isnan(probability)) AS pct FROM (SELECT cast(range AS int) AS b FROM range(10)) LEFT JOIN (SELECT cast(least(floor(p * 10), 9) AS int) AS b, count(*) AS n FROM (SELECT {P} AS p FROM v_scores_fast) WHERE p IS NOT NULL GROUP BY 1) USING (b)")
def a6_curve(t):
    return statistics.curve(t.scores_fast)



@query(f"""WITH v AS (SELECT id FROM v_scores_fast WHERE NOT isnan(probability)), s AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS rn, count(*) OVER () AS n FROM v),
k AS (SELECT DISTINCT s.id FROM s JOIN range(1000) r(i) ON n > 1000 AND rn = i * n // 1000 UNION SELECT id FROM s WHERE n <= 1000),
x AS (SELECT p.*, a.bot FROM v_posts p JOIN k USING (id) JOIN v_accounts a ON a.id = p.account_id)
SELECT (SELECT count(*) FROM v) AS n, count(*) AS sampled, avg(CASE WHEN length(content) > 0 THEN length(content) END) AS avg_chars, count_if(bot) / greatest(count(*), 1) * 100 AS bot_pct, count_if(bot) / greatest(count(*), 1) * (SELECT count(*) FROM v) AS bots_estimate FROM x""")
def a6_sample_estimates(t):
    seen = t.posts.join(t.accounts.select(F.col("id").alias("account_id"), "bot"), "account_id")
    return statistics.sample_estimates(t.scores_fast, seen)


LENGTHS = """WITH v AS (SELECT id, ntokens FROM v_scores_fast WHERE NOT isnan(probability)), s AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS rn, count(*) OVER () AS n FROM v),
k AS (SELECT DISTINCT s.id FROM s JOIN range(1000) r(i) ON n > 1000 AND rn = i * n // 1000 UNION SELECT id FROM s WHERE n <= 1000),
c AS (SELECT length(content) AS chars FROM v_posts JOIN k USING (id) WHERE length(content) > 0), m AS (SELECT chars, row_number() OVER (ORDER BY chars) - 1 AS rn, count(*) OVER () AS n FROM c)
SELECT coalesce(avg(chars), 0) AS avg_chars, (SELECT chars FROM m WHERE rn = n // 2) AS median_chars, {} AS avg_tokens FROM c"""


@query(LENGTHS.format("(SELECT avg(ntokens) FROM v)"))
def a6_text_lengths(t):
    return statistics.text_lengths(t.scores_fast, t.posts)


@query(LENGTHS.format("round_even(avg(chars) / 4.2e0, 0)"))
def a6_estimated_tokens(t):
    """The same where tokens were not counted."""
    return statistics.text_lengths(t.scores_fast.withColumn("ntokens", F.lit(1)), t.posts)


@query("SELECT i.domain, count(*) AS n FROM v_posts p JOIN v_accounts a ON a.id = p.account_id JOIN v_instances i ON i.id = p.instance_id WHERE deleted_at IS NULL GROUP BY 1 ORDER BY n DESC, domain LIMIT 8")
def a6_top_domains(t):
    return statistics.top_domains(posts.with_authors(t.posts, t.accounts, t.instances))


@query(f"SELECT verdict, count(*) AS n, CASE WHEN verdict IN ('vero', 'perlopiù vero') THEN 'true' WHEN verdict IN ('falso', 'perlopiù falso') THEN 'false' ELSE 'unverifiable' END AS verdict_group FROM (SELECT {V} AS verdict FROM v_fact_checks) GROUP BY verdict")
def a7_verdict_counts(t):
    return statistics.verdict_counts(t.fact_checks.withColumn("verdict", T.normalize_verdict(F.col("verdict"))))


@query("""WITH b AS (SELECT id, cast(least(floor(probability * 5), 4) AS int) AS bin FROM v_scores_fast WHERE NOT isnan(probability)),
s AS (SELECT id, bin, row_number() OVER (PARTITION BY bin ORDER BY id) - 1 AS rn, count(*) OVER (PARTITION BY bin) AS n FROM b)
SELECT DISTINCT s.id, s.bin FROM s JOIN range(25) r(i) ON n > 25 AND rn = i * n // 25 UNION SELECT id, bin FROM s WHERE n <= 25""")
def a8_systematic_sample(t):
    p = S.present(F.col("probability"))
    rows = t.scores_fast.select("id", S.bin_of(p, 5).alias("bin")).where("bin IS NOT NULL")
    return statistics.systematic(rows, 25, ["bin"]).select("id", "bin")


AI_ACC = f"SELECT a.id AS account_id, a.bot, avg(s.p) AS mean_p, count(*) AS n_posts FROM v_posts p JOIN (SELECT id, {P} AS p FROM v_scores_fast) s ON s.id = p.id AND s.p IS NOT NULL JOIN v_accounts a ON a.id = p.account_id WHERE p.deleted_at IS NULL GROUP BY 1, 2 HAVING avg(s.p) >= 0.5"


@query(AI_ACC)
def a9_ai_accounts(t):
    return statistics.ai_accounts(t.scores_fast, t.posts, t.accounts)


@query(f"SELECT count(*) AS ai_accounts, count_if(bot) AS ai_bots, count_if(NOT bot) AS ai_humans FROM ({AI_ACC})")
def a9_ai_by_bot(t):
    return statistics.ai_by_bot(statistics.ai_accounts(t.scores_fast, t.posts, t.accounts))


def _bino_texts(t):
    return t.post_texts.join(t.scores_bino.withColumnRenamed("binoculars_score", "score"), "id")


BT = "bt AS (SELECT id, lang, text, binoculars_score AS score, len([x FOR x IN string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') IF x <> '']) AS words FROM v_post_texts JOIN v_scores_bino USING (id)), ok AS (SELECT *, CASE WHEN trim(text) <> '' THEN score END AS s FROM bt)"


@query(f"""WITH {BT} SELECT count(*) AS total, count(s) AS scored, count_if(trim(text) = '') AS empty, count_if(s IS NOT NULL AND words < 50) AS short, count_if(s < 0.9) AS ai, count_if(s >= 0.9) AS human,
avg(s) AS score_mean, quantile_cont(s, 0.5) AS score_median, min(s) AS score_min, max(s) AS score_max, stddev_pop(s) AS score_std FROM ok""")
def a10_detector_report(t):
    return statistics.detector_report(_bino_texts(t))


@query(f"SELECT cast(floor({BINO} / 10) AS int) AS bin, count(*) AS n FROM v_scores_bino WHERE binoculars_score IS NOT NULL GROUP BY 1")
def a10_detector_bins(t):
    return statistics.detector_bins(_bino_texts(t))


@query(f"WITH {BT} SELECT coalesce(nullif(trim(lang), ''), '??') AS lang, count(*) AS n, count_if(score < 0.9) AS ai FROM bt GROUP BY 1")
def a10_by_language(t):
    return statistics.by_language(_bino_texts(t))


@query("SELECT id, score, side FROM (SELECT id, binoculars_score AS score, row_number() OVER (ORDER BY binoculars_score, id) AS l, row_number() OVER (ORDER BY binoculars_score DESC, id) AS h FROM v_scores_bino), (VALUES ('low'), ('high')) x(side) WHERE (side = 'low' AND l <= 10) OR (side = 'high' AND h <= 10)")
def a10_extremes(t):
    return statistics.extremes(_bino_texts(t))


@query("SELECT coalesce(nullif(trim(lang), ''), '??') AS lang, coalesce(cast(CASE WHEN lang = 'en' AND ai_probability IS NOT NULL THEN least(floor(ai_probability * 5), 4) END AS int), -1) AS bin, count(*) AS n FROM v_post_texts LEFT JOIN v_scores_desk USING (id) GROUP BY 1, 2")
def a11_running_report(t):
    return statistics.running_report(t.post_texts.join(t.scores_desk, "id", "left"))


@query("""WITH n AS (SELECT coalesce(language, '(none)') AS language, count(*) AS n, count_if(source = 'hashtag') AS h, count_if(source = 'user_timeline') AS u FROM v_statuses GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, language) AS k FROM n)
SELECT CASE WHEN k <= 3 THEN language ELSE 'other' END AS language, cast(sum(n) AS bigint) AS n, 100.0e0 * sum(n) / (SELECT count(*) FROM v_statuses) AS pct, cast(sum(h) AS bigint) AS from_hashtag, cast(sum(u) AS bigint) AS from_timeline,
CASE WHEN k <= 3 THEN language ELSE 'other' END IN ('en', 'it') AS in_corpus FROM r GROUP BY CASE WHEN k <= 3 THEN language ELSE 'other' END""")
def a12_language_distribution(t):
    return statistics.language_distribution(t.statuses, ("en", "it"), top=3)


@query("SELECT user_id, cast(sum(CASE WHEN event_id % 5 = 0 THEN 0 ELSE cast(json_extract_string(props, '$.k') AS bigint) END) AS bigint) AS uses FROM events GROUP BY user_id")
def a20_hashtag_uses(t):
    day = F.struct(F.when(F.col("event_id") % 5 != 0, F.get_json_object("props", "$.k")).alias("uses"))
    history = t.events.groupBy("user_id").agg(F.collect_list(day).alias("history"))
    return history.select("user_id", statistics.hashtag_uses().alias("uses"))


@query("SELECT lower(hashtag) AS name, max(usage_count) AS uses, arg_max(topic_id, (usage_count, -topic_id)) AS query_no FROM v_topic_hashtags GROUP BY 1")
def a21_union_hashtags(t):
    return statistics.union_hashtags(t.topic_hashtags.select(F.col("hashtag").alias("name"), F.col("usage_count").alias("uses"), F.col("topic_id").alias("query_no")))


@query(f"""WITH p AS (SELECT {P} AS p FROM v_scores_fast), s AS (SELECT quantile_cont(p, 0.5) AS median, stddev_pop(p) AS std, quantile_cont(p, 0.25) AS q1_exact, quantile_cont(p, 0.75) AS q3_exact FROM p)
SELECT *, median - 0.674e0 * std AS q1, median + 0.674e0 * std AS q3, (median + 0.674e0 * std) - (median - 0.674e0 * std) AS iqr FROM s""")
def a22_quartile_estimates(t):
    return statistics.quartile_estimates(t.scores_fast)


@query("SELECT DISTINCT lower(hashtag) AS hashtag FROM v_topic_hashtags")
def a23_known_hashtags(t):
    return posts.known_hashtags(t.topic_hashtags)


@query("SELECT domain, count(*) AS pending FROM v_accounts a JOIN v_instances i ON i.id = a.instance_id WHERE timeline_crawled IS NULL GROUP BY 1")
def a24_work_by_domain(t):
    pending = t.accounts.where("timeline_crawled IS NULL").join(t.instances.select(F.col("id").alias("instance_id"), "domain"), "instance_id")
    return statistics.work_by_domain(pending)


@query(f"SELECT id, p AS probability, (SELECT count(*) FROM v_scores_fast WHERE NOT isnan(probability)) AS total, (SELECT count(*) FROM v_scores_fast WHERE NOT isnan(probability)) > 60 AS has_next FROM (SELECT id, {P} AS p FROM v_scores_fast) WHERE p IS NOT NULL ORDER BY p DESC, id LIMIT 20 OFFSET 40")
def l1_page(t):
    rows = t.scores_fast.select("id", S.present(F.col("probability")).alias("probability")).where("probability IS NOT NULL")
    return posts.page(rows, posts.order_by("top"), 3, 20)


@query("SELECT id, domain, active_users, cast(row_number() OVER (PARTITION BY topic_id ORDER BY active_users DESC, id) AS int) AS rank FROM v_instances QUALIFY rank <= 2")
def l3_top_instances(t):
    return posts.top_per_group(t.instances, ["topic_id"], [F.desc("active_users"), F.asc("id")], 2).select("id", "domain", "active_users", "rank")


@query("SELECT instance_id, hashtag, arg_max(max_id_cursor, (started_at, id)) AS cursor FROM v_collection_runs WHERE max_id_cursor IS NOT NULL GROUP BY 1, 2")
def l4_latest_cursor(t):
    return posts.latest_cursor(t.collection_runs)


@query("SELECT id, last_value(max_id_cursor IGNORE NULLS) OVER (PARTITION BY instance_id, hashtag ORDER BY started_at, id ROWS UNBOUNDED PRECEDING) AS cursor FROM v_collection_runs")
def l5_carried_cursor(t):
    return posts.carried_cursor(t.collection_runs).select("id", "cursor")


@query("SELECT hashtag, topic_id, instance_id, usage_count FROM v_topic_hashtags QUALIFY row_number() OVER (PARTITION BY hashtag ORDER BY topic_id, usage_count DESC, instance_id) = 1")
def l6_first_by_key(t):
    return posts.first_of_key(t.topic_hashtags, ["hashtag"], [F.col("topic_id"), -F.col("usage_count"), F.col("instance_id")]).select("hashtag", "topic_id", "instance_id", "usage_count")


@query(f"WITH {DET} SELECT DISTINCT id FROM (SELECT id FROM f UNION SELECT id FROM a UNION SELECT id FROM b)")
def u2_union_of_ids(t):
    return t.scores_fast.select("id").union(t.scores_ada.select("id")).union(t.scores_bino.select("id")).distinct()


@query("SELECT id FROM v_scores_bino EXCEPT SELECT id FROM v_scores_fast")
def u3_difference(t):
    return t.scores_bino.select("id").exceptAll(t.scores_fast.select("id"))


@query(f"SELECT id, {V} AS verdict, cast(CASE {V} WHEN 'falso' THEN 0 WHEN 'perlopiù falso' THEN 1 WHEN 'misto' THEN 2 WHEN 'perlopiù vero' THEN 3 WHEN 'vero' THEN 4 ELSE 5 END AS int) AS veracity FROM v_fact_checks")
def t5_veracity(t):
    v = T.normalize_verdict(F.col("verdict"))
    return t.fact_checks.select("id", v.alias("verdict"), T.veracity_of(v).alias("veracity"))


@query(f"SELECT id, {BINO} AS pct, CASE WHEN trim(text) = '' THEN 'skipped_empty' WHEN binoculars_score < 0.9 THEN 'Most likely AI-Generated' ELSE 'Most likely human-generated' END AS label FROM v_scores_bino JOIN v_post_texts USING (id)")
def t9_labels(t):
    return _bino_texts(t).select("id", S.ai_percentage(F.col("score")).alias("pct"), S.detector_label(F.col("score"), F.col("text")).alias("label"))


@query("SELECT id, array_to_string([x FOR x IN string_split_regex(trim(text), '\\s+')][1:30], ' ') AS search FROM v_post_texts")
def t11_search_query(t):
    return t.post_texts.select("id", T.search_query(F.col("text")).alias("search"))


@query("SELECT id, string_agg(url, '|' ORDER BY k) AS urls FROM v_claims_evidence GROUP BY id")
def t12_evidence_urls(t):
    joined = t.claims_evidence.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "url"))).alias("x"))
    joined = joined.select("id", F.concat(F.lit("none ; "), F.array_join(F.transform("x", lambda u: u["url"]), " ; ")).alias("evidence"))
    return joined.select("id", F.array_join(T.evidence_urls(F.col("evidence")), "|").alias("urls"))


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS bigint), 0) AS k FROM events")
def t14_json_counts(t):
    return t.events.select("event_id", T.json_count(F.col("props"), "k").alias("k"))


def _c(n: int, incl: bool, unscored: bool) -> str:
    names = ["fast", "bino", "desk", "ada"][:n]
    op = ">=" if incl else ">"
    lab = ", ".join(f"{x} {op} 0.5 AS l_{x}" for x in names)
    votes = " + ".join(f"cast(coalesce(l_{x}, false) AS int)" for x in names)
    every = " AND ".join(f"l_{x} IS NOT NULL" for x in names)
    some = "true" if unscored else "(" + " OR ".join(f"l_{x} IS NOT NULL" for x in names) + ")"
    cols = ["count(*) AS ids", f"count_if({every}) AS in_all"] + [f"count_if({some} AND votes = {k}) AS votes_{k}" for k in range(n + 1)]
    cols += [f"count_if(l_{a} = l_{b}) AS agree_{a}_{b}" for i, a in enumerate(names) for b in names[i + 1 :]]
    cols += [f"count_if({every} AND votes IN (0, {n})) AS all_agree"] + [f"count({x}) AS scored_{x}" for x in names]
    src = "j" if n == 4 else "(SELECT id, fast, bino, desk FROM f FULL JOIN b USING (id) FULL JOIN k USING (id))"
    return f"WITH {DET}, l AS (SELECT *, {lab} FROM {src}), v AS (SELECT *, {votes} AS votes FROM l) SELECT {', '.join(cols)} FROM v"


@query(_c(3, False, True))
def c1_three_detectors(t):
    return compare.comparison(detectors(t, four=False), 0.5, inclusive=False, count_unscored=True)


@query(_c(4, True, False))
def c2_four_detectors(t):
    return compare.comparison(detectors(t))


@query(f"WITH {DET} SELECT id, fast, bino, desk, ada, cast(coalesce(fast >= 0.5, false) AS int) + cast(coalesce(bino >= 0.5, false) AS int) + cast(coalesce(desk >= 0.5, false) AS int) + cast(coalesce(ada >= 0.5, false) AS int) AS votes, md5(coalesce(p.content, t.text)) AS digest FROM j LEFT JOIN v_posts p USING (id) LEFT JOIN v_post_texts t USING (id)")
def c3_compared_posts(t):
    rows = compare.compared_posts(detectors(t), [t.posts.select("id", F.col("content").alias("text")), t.post_texts])
    return rows.select("id", "fast", "bino", "desk", "ada", "votes", F.md5("text").alias("digest"))


@query(f"""WITH {DET}, s AS ({" UNION ALL ".join(f"SELECT '{a}-{b}' AS pair, {a} >= 0.5 AS x, {b} >= 0.5 AS y FROM j" for a, b in (("fast", "bino"), ("fast", "desk"), ("fast", "ada"), ("bino", "desk"), ("bino", "ada"), ("desk", "ada")))})
SELECT pair, count_if(x IS NOT NULL AND y IS NOT NULL) AS both_scored, count_if(x = y) AS agree, CASE WHEN count_if(x IS NOT NULL AND y IS NOT NULL) > 0 THEN 100.0e0 * count_if(x = y) / count_if(x IS NOT NULL AND y IS NOT NULL) ELSE 0 END AS pct FROM s GROUP BY pair""")
def c4_agreement(t):
    return compare.agreement(detectors(t))


LONG = " UNION ALL ".join(f"SELECT id, '{x}' AS detector, {x} AS p FROM j WHERE {x} IS NOT NULL" for x in ("fast", "bino", "desk", "ada"))


@query(f"WITH {DET}, l AS ({LONG}) SELECT detector, count(*) AS scored, count_if(p >= 0.5) AS ai, 100.0e0 * count_if(p >= 0.5) / count(*) AS pct FROM l GROUP BY 1")
def a18_detector_summary(t):
    return compare.detector_summary(detectors(t))


@query(f"WITH {DET}, l AS ({LONG}) SELECT detector, bot, count(*) AS scored, count_if(p >= 0.5) AS ai, 100.0e0 * count_if(p >= 0.5) / count(*) AS pct FROM l JOIN v_posts p USING (id) JOIN v_accounts a ON a.id = p.account_id GROUP BY 1, 2")
def a17_detector_by_bot(t):
    return compare.detector_by_bot(detectors(t), t.posts, t.accounts)
