"""Queries over the user graph, chains, communities and cascades."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegraph.operators import cascade, chains, communities, metrics, nullmodel, posts, project
from tidegraph.operators.components import connected_components, contracted
from tidegraph.operators.iterate import cut

from .registry import query

FUSED = """named AS (SELECT a.*, i.domain, CASE WHEN contains(acct, '@') THEN acct ELSE acct || '@' || i.domain END AS canon FROM v_accounts a JOIN v_instances i ON i.id = a.instance_id),
fused AS (SELECT *, min(id) OVER (PARTITION BY canon) AS node FROM named)"""
LIVE = "live AS (SELECT * FROM v_statuses WHERE deleted_at IS NULL)"
BOOST = """boost AS (SELECT src, dst, count(*) AS weight, min(ts) AS first_ts, max(ts) AS last_ts FROM (
SELECT s.account_id AS src, r.booster_account_id AS dst, cast(NULL AS timestamp) AS ts FROM v_reblogs r JOIN live s ON s.id = r.status_id
UNION ALL SELECT o.account_id, s.account_id, s.created_at FROM live s JOIN live o ON o.id = s.reblog_of_id) WHERE src <> dst GROUP BY 1, 2)"""
REPLY = "reply AS (SELECT p.account_id AS src, s.account_id AS dst, count(*) AS weight, min(s.created_at) AS first_ts, max(s.created_at) AS last_ts FROM live s JOIN live p ON p.id = s.in_reply_to_id WHERE p.account_id <> s.account_id GROUP BY 1, 2)"
MENTION = """mention AS (SELECT s.account_id AS src, f.id AS dst, count(*) AS weight, min(s.created_at) AS first_ts, max(s.created_at) AS last_ts FROM v_mentions m JOIN live s ON s.id = m.status_id JOIN v_instances i ON i.id = s.instance_id
JOIN fused f ON f.canon = CASE WHEN contains(mentioned_acct, '@') THEN mentioned_acct ELSE mentioned_acct || '@' || i.domain END WHERE f.id <> s.account_id GROUP BY 1, 2)"""
FOLLOW = "follow AS (SELECT follower_account_id AS src, followed_account_id AS dst, count(*) AS weight, cast(NULL AS timestamp) AS first_ts, cast(NULL AS timestamp) AS last_ts FROM v_follows WHERE followed_account_id <> follower_account_id GROUP BY 1, 2)"


def _graph_sql(kinds: tuple[str, ...]) -> str:
    rows = " UNION ALL ".join(f"SELECT *, '{k}' AS kind FROM {k}" for k in kinds)
    sums = ", ".join(f"cast(sum(CASE WHEN kind = '{k}' THEN weight ELSE 0 END) AS bigint) AS w_{k}" for k in kinds)
    parts = {"boost": BOOST, "reply": REPLY, "mention": MENTION, "follow": FOLLOW}
    return f"""WITH {FUSED}, {LIVE}, {", ".join(parts[k] for k in kinds)}, rows AS ({rows}),
g AS (SELECT a.node AS src, b.node AS dst, cast(sum(weight) AS bigint) AS weight, {sums}, min(first_ts) AS first_ts, max(last_ts) AS last_ts FROM rows JOIN fused a ON a.id = rows.src JOIN fused b ON b.id = rows.dst WHERE a.node <> b.node GROUP BY 1, 2)"""


G1 = _graph_sql(("boost", "reply", "mention"))
G2 = _graph_sql(("boost", "reply", "mention", "follow"))
NODES = "nodes AS (SELECT node AS id, any_value(canon) AS acct, bool_or(bot) AS bot, max(followers) AS followers FROM fused GROUP BY node)"
DIFF = "d AS (SELECT src, dst, w_boost + w_reply AS weight FROM g WHERE w_boost + w_reply > 0)"
PART = "p AS (SELECT id, id % 10 AS community FROM nodes)"


class Graph:
    """The user graph of the tables, each part computed when asked for."""

    def __init__(self, t):
        self.t = t
        self.fused = project.fused_accounts(t.accounts, t.instances)

    def few(self) -> bool:
        return self.t.accounts.count() <= project.BROADCAST_ACCOUNTS

    def edges(self, follows: bool = False):
        t = self.t
        return project.graph_of(self.fused, t.statuses, t.reblogs, t.mentions, t.instances, t.follows if follows else None, few=self.few())

    def diffusion(self):
        """Boosts and replies only, so mentions are not computed."""
        return project.diffusion(project.graph_of(self.fused, self.t.statuses, self.t.reblogs, few=self.few()))

    def links(self, every: bool = False):
        """Pairs of nodes with the components of the diffusion graph, or with ``every`` of the combined graph."""
        t, few = self.t, self.few()
        more = (t.repeated("mentions"), t.instances, t.repeated("follows")) if every else ()
        found = project.graph_of(self.fused, t.statuses, t.repeated("reblogs"), *more, few=few, pairs=True)
        return contracted(found, "src", "dst").withColumnsRenamed({"u": "src", "v": "dst"}) if few else found

    def nodes(self, topics: bool = False):
        found = project.account_topics(self.t.statuses, posts.post_topics(self.t.status_hashtags, self.t.topic_hashtags)) if topics else None
        return project.nodes_of(self.fused, found)


def tenths(nodes):
    """A fixed partition, to compare metrics on."""
    return nodes.select("id", (F.col("id") % 10).alias("community"))


@query(f"{G1} SELECT * FROM g")
def g1_user_graph(t):
    return Graph(t).edges()


@query(f"WITH {FUSED}, {NODES} SELECT * FROM nodes")
def a16_fused_accounts(t):
    return Graph(t).nodes().drop("topics")


@query(f"""WITH {FUSED}, tp AS (SELECT DISTINCT f.node, k.topic FROM v_statuses s JOIN v_status_hashtags h ON h.status_id = s.id JOIN (SELECT DISTINCT lower(hashtag) AS tag, topic FROM v_topic_hashtags) k ON k.tag = lower(h.hashtag) JOIN fused f ON f.id = s.account_id)
SELECT f.node AS id, coalesce(x.topics, '') AS topics FROM (SELECT DISTINCT node FROM fused) f LEFT JOIN (SELECT node, string_agg(topic, ',' ORDER BY topic) AS topics FROM tp GROUP BY 1) x USING (node)""")
def a15_account_topics(t):
    return Graph(t).nodes(topics=True).select("id", "topics")


@query(f"WITH {LIVE}, {BOOST} SELECT * FROM boost")
def a14_boost_edges(t):
    return project.boost_edges(t.statuses, t.reblogs).drop("kind")


@query(f"WITH {LIVE}, {REPLY} SELECT * FROM reply")
def f13_reply_edges(t):
    return project.reply_edges(t.statuses).drop("kind")


@query(f"WITH {FUSED}, {LIVE}, {MENTION} SELECT * FROM mention")
def j8_mention_edges(t):
    once = t.repeated("mentions").repartition("status_id").distinct()  # as v_mentions, but by the key that statuses are joined with
    return project.mention_edges(t.statuses, once, Graph(t).fused, t.instances).drop("kind")


@query(f"{G2} SELECT * FROM g")
def g2_combined_graph(t):
    return Graph(t).edges(follows=True)


@query(f"{G2} SELECT count(*) AS edges, count_if(cast(w_boost > 0 AS int) + cast(w_reply > 0 AS int) + cast(w_mention > 0 AS int) + cast(w_follow > 0 AS int) > 1) AS mixed FROM g")
def g2_mixed_edges(t):
    return project.mixed_edges(Graph(t).edges(follows=True))


@query(f"{G1} SELECT src, dst, weight, ln(1 + weight) / ln(1 + (SELECT max(weight) FROM g)) AS weight_norm FROM g")
def t13_log_weights(t):
    return project.normalized(Graph(t).edges()).select("src", "dst", "weight", "weight_norm")


@query(f"{G1}, {DIFF} SELECT * FROM d")
def f14_diffusion(t):
    return Graph(t).diffusion()


@query(f"{G1} SELECT id, cast(sum(o) AS bigint) AS out_degree, cast(sum(i) AS bigint) AS in_degree, count(*) AS degree, cast(sum(w) AS bigint) AS out_strength FROM (SELECT src AS id, 1 AS o, 0 AS i, weight AS w FROM g UNION ALL SELECT dst, 0, 1, 0 FROM g) GROUP BY id")
def g9_degrees(t):
    return project.degrees(Graph(t).edges())


@query(f"""{G1}, n0 AS (SELECT id FROM (SELECT node AS id, any_value(canon) AS canon FROM fused GROUP BY node) WHERE id % 10 = 3), i0 AS (SELECT * FROM g WHERE src IN (SELECT id FROM n0) AND dst IN (SELECT id FROM n0)),
top AS (SELECT n0.id FROM n0 LEFT JOIN (SELECT src AS id, sum(weight) AS s FROM i0 GROUP BY 1) x USING (id) ORDER BY coalesce(s, 0) DESC, id LIMIT 50)
SELECT src, dst, weight FROM g WHERE src IN (SELECT id FROM top) AND dst IN (SELECT id FROM top)""")
def f15_top_subgraph(t):
    g = Graph(t)
    nodes = g.nodes()
    return project.top_subgraph(nodes, g.edges(), top=50, communities=tenths(nodes), community=3)[1].select("src", "dst", "weight")


@query(f"{G1} SELECT src, dst, weight FROM g WHERE src % 3 = 0 AND dst % 3 = 0")
def j17_induced_edges(t):
    g = Graph(t)
    return project.induced(g.edges(), g.nodes().where("id % 3 = 0")).select("src", "dst", "weight")


#: Smallest labels spread for as many steps as no shortest path here is long.
COMP = """c0 AS (SELECT src AS a, dst AS b FROM {edges} UNION SELECT dst, src FROM {edges}),
lab AS (SELECT 0 AS k, id, id AS c FROM nodes UNION ALL SELECT k + 1, id, min(c) FROM (SELECT k, id, c FROM lab UNION ALL SELECT l.k, c0.b, l.c FROM lab l JOIN c0 ON c0.a = l.id) WHERE k < 30 GROUP BY k, id),
comp AS (SELECT id, c AS component FROM lab WHERE k = 30)"""
RG2 = G2.replace("WITH ", "WITH RECURSIVE ", 1)
RG1 = G1.replace("WITH ", "WITH RECURSIVE ", 1)


@query(f"{RG2}, {NODES}, {COMP.format(edges='g')} SELECT id, component FROM comp")
def g3_components(t):
    """Components of the combined graph, all of its edges."""
    g = Graph(t)
    return connected_components(g.links(every=True), g.nodes().select("id"))


@query(f"{RG1}, {NODES}, {DIFF}, {COMP.format(edges='d')} SELECT id, component FROM comp")
def g3_diffusion_components(t):
    return _components(t)


def _components(t):
    g = Graph(t)
    return connected_components(g.links(), g.nodes().select("id"))


@query(f"""{RG1}, {NODES}, {DIFF}, {COMP.format(edges='d')}, sz AS (SELECT component, count(*) AS size FROM comp GROUP BY 1)
SELECT n.id, comp.component, size, CASE WHEN n.id % 7 = 0 THEN -1 ELSE n.id % 10 END AS community FROM nodes n JOIN comp USING (id) JOIN sz USING (component) WHERE size > 3""")
def f16_large_components(t):
    nodes = Graph(t).nodes()
    part = tenths(nodes).where("id % 7 <> 0")
    return project.large_components(_components(t), nodes, part, 3).select("id", "component", "size", "community")


@query(f"""{RG1}, {NODES}, {COMP.format(edges='g')}, sz AS (SELECT component, count(*) AS size FROM comp GROUP BY 1), e AS (SELECT count(*) AS edges, count_if(w_boost > 0) AS edges_boost, count_if(w_reply > 0) AS edges_reply, count_if(w_mention > 0) AS edges_mention, count(DISTINCT src) AS sources FROM g),
n AS (SELECT count(*) AS nodes FROM nodes), t AS (SELECT count(*) AS touched FROM (SELECT src FROM g UNION SELECT dst FROM g)), s AS (SELECT count(*) AS components, max(size) AS giant FROM sz)
SELECT nodes, edges, edges_boost, edges_reply, edges_mention, 100.0e0 * (nodes - touched) / nodes AS isolated_pct, components, 100.0e0 * giant / nodes AS giant_pct, edges / sources AS mean_out_degree FROM n, e, t, s""")
def g4_report(t):
    g = Graph(t)
    edges, nodes = cut(g.edges()), g.nodes()
    return project.report(nodes, edges, connected_components(edges, nodes.select("id")))


@query(f"""{G1}, {NODES}, dg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM g WHERE w_boost + w_reply > 0 UNION ALL SELECT dst FROM g WHERE w_boost + w_reply > 0) GROUP BY 1)
SELECT n.id, acct, n.id % 10 AS community, followers, ['#1f77b4', '#ff7f0e', '#2ca02c', '#d62728', '#9467bd', '#8c564b', '#e377c2', '#bcbd22', '#17becf'][1 + (n.id % 10) % 9] AS colour, 2 + sqrt(degree) AS size FROM nodes n JOIN dg USING (id)""")
def s12_viewer_nodes(t):
    g = Graph(t)
    nodes = g.nodes()
    return project.viewer(nodes, g.edges(), tenths(nodes), drop_mention_only=True)[0]


@query(f"{G1} SELECT src, dst, weight FROM g WHERE w_boost + w_reply > 0")
def s12_viewer_links(t):
    g = Graph(t)
    nodes = g.nodes()
    return project.viewer(nodes, g.edges(), tenths(nodes), drop_mention_only=True)[1]


@query(f"""{G1}, tp AS (SELECT DISTINCT f.node AS id FROM v_statuses s JOIN v_status_hashtags h ON h.status_id = s.id JOIN (SELECT DISTINCT lower(hashtag) AS tag, topic FROM v_topic_hashtags) k ON k.tag = lower(h.hashtag) JOIN fused f ON f.id = s.account_id WHERE contains(lower(k.topic), 'asi'))
SELECT src, dst, weight FROM g WHERE src IN (SELECT id FROM tp) AND dst IN (SELECT id FROM tp)""")
def f15_topic_subgraph(t):
    g = Graph(t)
    return project.top_subgraph(g.nodes(topics=True), g.edges(), topic="ASI")[1].select("src", "dst", "weight")


@query("""WITH s AS (SELECT id FROM v_accounts WHERE bot ORDER BY followers DESC, id LIMIT 50), o AS (SELECT DISTINCT follower_account_id AS src, followed_account_id AS dst FROM v_follows WHERE follower_account_id IN (SELECT id FROM s)),
r AS (SELECT o.*, row_number() OVER (PARTITION BY src ORDER BY a.followers DESC, dst) AS k FROM o JOIN v_accounts a ON a.id = o.dst) SELECT src, dst FROM r WHERE k <= 8""")
def g18_ego_expansion(t):
    seeds = t.accounts.where("bot").orderBy(F.desc("followers"), "id").limit(50)  # top-k seeds by followers
    return project.ego_expansion(seeds, t.follows, t.accounts, 8)[0]


CHAIN = """WITH RECURSIVE parent AS (SELECT id, CASE WHEN in_reply_to_id IS NOT NULL THEN in_reply_to_id ELSE reblog_of_id END AS up FROM v_statuses WHERE deleted_at IS NULL),
climb AS (SELECT id, id AS post, up, 0 AS steps FROM parent UNION ALL SELECT climb.id, above.id, above.up, steps + 1 FROM climb JOIN parent above ON above.id = climb.up),
chain AS (SELECT id, post AS root, steps + 1 AS depth FROM climb WHERE up IS NULL)"""


@query(f"{CHAIN} SELECT id, root, depth FROM chain")
def g14_chains(t):
    return chains.depths(t.statuses)


@query(f"{CHAIN}, r AS (SELECT root, max(depth) AS depth, count(*) AS members FROM chain GROUP BY 1) SELECT depth, count(*) AS chains, cast(sum(members) AS bigint) AS posts FROM r GROUP BY 1")
def a13_chain_depths(t):
    return chains.per_depth(chains.depths(t.statuses))


@query(f"{CHAIN}, r AS (SELECT root, max(depth) AS depth, count(*) AS members FROM chain GROUP BY 1) SELECT count(*) AS chains, cast(sum(members) AS bigint) AS posts, avg(depth) AS mean_depth, max(depth) AS max_depth, 100.0e0 * count_if(depth >= 2) / count(*) AS multi_pct FROM r")
def a13_chain_summary(t):
    return chains.summary(chains.depths(t.statuses))


@query("""WITH RECURSIVE p AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent FROM conversations), c AS (SELECT conv_id, turn, turn AS root, 1 AS depth FROM p WHERE parent IS NULL
UNION ALL SELECT p.conv_id, p.turn, c.root, c.depth + 1 FROM p JOIN c ON c.conv_id = p.conv_id AND c.turn = p.parent) SELECT conv_id, max(depth) AS depth, count(*) AS members FROM c GROUP BY conv_id, root""")
def g14_conversation_chains(t):
    return chains.conversation_chains(t.conversations)


RANK = f"""{G1.replace('WITH ', 'WITH RECURSIVE ', 1)}, {NODES}, {DIFF}, o AS (SELECT src, sum(weight) AS out FROM d GROUP BY 1), pr AS (SELECT d.src, d.dst, d.weight / o.out AS p FROM d JOIN o USING (src)),
walk AS (SELECT 0 AS k, id, 1.0e0 / count(*) OVER () AS flow FROM nodes
UNION ALL SELECT k + 1, id, 0.15e0 / n + 0.85e0 * (got + dead / n) FROM (
  SELECT w.k, w.id, count(*) OVER () AS n, coalesce((SELECT sum(v.flow * pr.p) FROM pr JOIN walk v ON v.id = pr.src WHERE pr.dst = w.id), 0) AS got, sum(CASE WHEN o.src IS NULL THEN w.flow ELSE 0 END) OVER () AS dead
  FROM walk w LEFT JOIN o ON o.src = w.id WHERE w.k < 180))"""


def _flow(t):
    g = Graph(t)
    edges = cut(g.diffusion())
    nodes = g.nodes().select("id")
    return nodes, edges, metrics.page_rank(edges, nodes)


@query(f"{RANK} SELECT id, flow FROM walk WHERE k = 180")
def g7_stationary_flow(t):
    return _flow(t)[2]


@query(f"""{RANK}, f AS (SELECT id, flow FROM walk WHERE k = 180), {PART}, lv AS (SELECT a.community, sum(f.flow * d.weight / o.out) AS q FROM d JOIN o USING (src) JOIN f ON f.id = d.src JOIN p a ON a.id = d.src JOIN p b ON b.id = d.dst WHERE a.community <> b.community GROUP BY 1),
m AS (SELECT community, sum(flow) AS p, sum(CASE WHEN flow > 0 THEN flow * log2(flow) ELSE 0 END) AS nl FROM f JOIN p USING (id) GROUP BY 1), x AS (SELECT m.*, coalesce(q, 0) AS q FROM m LEFT JOIN lv USING (community)),
y AS (SELECT sum(q) AS q, sum(CASE WHEN q > 0 THEN q * log2(q) ELSE 0 END) AS ql, sum(CASE WHEN q + p > 0 THEN (q + p) * log2(q + p) ELSE 0 END) AS pl, sum(nl) AS nl, count(*) AS modules FROM x)
SELECT modules, (CASE WHEN q > 0 THEN q * log2(q) ELSE 0 END) - 2 * ql - nl + pl AS codelength FROM y""")
def g8_codelength(t):
    nodes, edges, flow = _flow(t)
    return metrics.codelength(edges, flow, tenths(nodes))


@query(f"""{G1}, {NODES}, {DIFF}, {PART}, w AS (SELECT a.community AS ca, b.community AS cb, weight FROM d JOIN p a ON a.id = d.src JOIN p b ON b.id = d.dst),
e AS (SELECT c, cast(sum(weight) AS double) AS k FROM (SELECT ca AS c, weight FROM w UNION ALL SELECT cb, weight FROM w) GROUP BY 1)
SELECT (SELECT sum(CASE WHEN ca = cb THEN weight ELSE 0 END) / sum(weight) FROM w) - (SELECT sum(k * k) FROM e) / (4.0e0 * (SELECT sum(weight) FROM w) * (SELECT sum(weight) FROM w)) AS modularity""")
def g10_modularity(t):
    g = Graph(t)
    return metrics.modularity(g.diffusion(), tenths(g.nodes()))


@query(f"""{G1}, {NODES}, {DIFF}, {PART}, pr AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM d), s AS (SELECT community, count(*) AS n FROM p GROUP BY 1),
x AS (SELECT count(*) AS pairs, 100.0e0 * count_if(p1.community = p2.community) / count(*) AS intra_pct FROM pr JOIN p p1 ON p1.id = a JOIN p p2 ON p2.id = b), y AS (SELECT 100.0e0 * sum(n * n) / (sum(n) * sum(n)) AS expected_pct FROM s)
SELECT *, intra_pct >= 3 * expected_pct AS passes FROM x, y""")
def g11_intra_share(t):
    g = Graph(t)
    return metrics.intra(g.diffusion(), tenths(g.nodes()))


@query(f"""{G1}, {NODES}, {DIFF}, {PART} SELECT (SELECT 100.0e0 * sum(CASE WHEN a.community = b.community THEN weight ELSE 0 END) / sum(weight) FROM d JOIN p a ON a.id = d.src JOIN p b ON b.id = d.dst) AS containment_pct,
(SELECT count(DISTINCT community) FROM p) AS communities, (SELECT 100.0e0 * max(n) / sum(n) FROM (SELECT count(*) AS n FROM p GROUP BY community)) AS largest_pct""")
def g12_containment(t):
    g = Graph(t)
    return metrics.containment(g.diffusion(), tenths(g.nodes()))


@query(f"WITH {FUSED}, {NODES}, {PART} SELECT community, count(*) AS size, cast(row_number() OVER (ORDER BY count(*) DESC, community) AS int) AS rank FROM p GROUP BY 1")
def l8_community_sizes(t):
    return metrics.sizes(tenths(Graph(t).nodes()))


@query(f"""WITH {FUSED}, {NODES}, j AS (SELECT id % 10 AS a, followers % 7 AS b, cast(count(*) AS double) AS n FROM nodes GROUP BY 1, 2), t AS (SELECT sum(n) AS s FROM j), ma AS (SELECT a, sum(n) AS na FROM j GROUP BY 1), mb AS (SELECT b, sum(n) AS nb FROM j GROUP BY 1)
SELECT 2 * (SELECT sum(n / s * ln(n * s / (na * nb))) FROM j JOIN ma USING (a) JOIN mb USING (b), t) / ((SELECT -sum(na / s * ln(na / s)) FROM ma, t) + (SELECT -sum(nb / s * ln(nb / s)) FROM mb, t)) AS nmi""")
def g13_mutual_information(t):
    nodes = Graph(t).nodes()
    return metrics.mutual_information(tenths(nodes), nodes.select("id", (F.col("followers") % 7).alias("community")))


def _communities(t):
    g = Graph(t)
    return cut(g.diffusion()), cut(g.nodes().select("id"))


@query()
def g5_flow_communities(t):
    edges, nodes = _communities(t)
    return communities.flow_communities(edges, nodes)


@query()
def g6_modularity_communities(t):
    edges, nodes = _communities(t)
    return communities.modularity_communities(edges, nodes)


@query()
def g6_split_communities(t):
    edges, nodes = _communities(t)
    return communities.modularity_communities(edges, nodes, refine=True)


@query()
def g15_null_model(t):
    return nullmodel.configuration(_communities(t)[0])


@query()
def g16_significance(t):
    edges, nodes = _communities(t)
    return nullmodel.significance(edges, nodes)


@query()
def g17_method_table(t):
    edges, nodes = _communities(t)
    flow, found = communities.by_methods(edges, nodes)
    return metrics.method_table(edges, flow, found)


REACH = "reach AS (SELECT n.id, n.acct, n.followers, coalesce(e.n, 0) AS direct_reached FROM v_cascade_nodes n LEFT JOIN (SELECT source AS id, count(*) AS n FROM v_cascade_edges WHERE fired GROUP BY 1) e USING (id) WHERE is_seed)"


@query("SELECT step, count(*) AS fired_edges FROM v_cascade_edges WHERE fired GROUP BY 1")
def k1_fired_by_step(t):
    return cascade.fired_by_step(t.cascade_edges)


@query("SELECT fired, count(*) AS n FROM v_cascade_edges GROUP BY 1")
def f21_fired_split(t):
    on, off = cascade.fired(t.cascade_edges)
    return on.unionByName(off).groupBy("fired").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT activation_step AS step, count(*) AS new_nodes, count_if(is_ia) AS new_ai, count_if(NOT is_ia) AS new_human FROM v_cascade_nodes WHERE activation_step IS NOT NULL GROUP BY 1), f AS (SELECT step, count(*) AS n FROM v_cascade_edges WHERE fired GROUP BY 1)
SELECT s.*, cast(sum(new_nodes) OVER (ORDER BY step) AS bigint) AS cumulative, 100.0e0 * sum(new_nodes) OVER (ORDER BY step) / (SELECT count(*) FROM v_cascade_nodes) AS cumulative_pct, coalesce(n, 0) AS fired_edges FROM s LEFT JOIN f USING (step)""")
def k2_step_statistics(t):
    return cascade.step_statistics(t.cascade_nodes, t.cascade_edges)


@query(f"WITH {REACH} SELECT *, CASE WHEN followers > 0 THEN direct_reached / followers ELSE 0 END AS efficiency FROM reach")
def k3_seed_leaderboard(t):
    return cascade.seed_leaderboard(t.cascade_nodes, t.cascade_edges)


@query("SELECT id, acct, followers, activation_step FROM v_cascade_nodes WHERE NOT is_ia AND activation_step IS NOT NULL ORDER BY followers DESC, activation_step, id LIMIT 50")
def k4_top_targets(t):
    return cascade.top_targets(t.cascade_nodes).select("id", "acct", "followers", "activation_step")


@query("SELECT count_if(activation_step IS NOT NULL) AS activated, count_if(activation_step IS NOT NULL AND is_ia) AS activated_ai, count_if(activation_step IS NOT NULL AND NOT is_ia) AS activated_human, count_if(is_seed) AS seeds FROM v_cascade_nodes")
def k5_demographics(t):
    return cascade.demographics(t.cascade_nodes)


@query(f"""WITH {REACH}, s AS (SELECT id FROM reach ORDER BY direct_reached DESC, followers DESC, id LIMIT 60),
e AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY step, target) AS k FROM v_cascade_edges WHERE fired AND source IN (SELECT id FROM s)) SELECT source, target, p_ic, step FROM e WHERE k <= 6 OR target IN (SELECT id FROM s)""")
def k6_display_edges(t):
    return cascade.display_edges(t.cascade_nodes, t.cascade_edges)


def _tree(t):
    best = cascade.seed_leaderboard(t.cascade_nodes, t.cascade_edges).orderBy(*cascade.leader_order()).limit(1).collect()[0]["id"]
    return cascade.tree(cut(t.cascade_nodes), cut(t.cascade_edges), best)


@query()
def k7_cascade_tree(t):
    return _tree(t)[0]


@query()
def k7_cascade_links(t):
    return _tree(t)[1]


@query("SELECT count_if(activation_step <= 5) AS activated, 100.0e0 * count_if(activation_step <= 5) / count(*) AS pct FROM v_cascade_nodes")
def k8_reached_until(t):
    return cascade.reached_until(t.cascade_nodes, 5)


@query("SELECT count_if(activation_step IS NOT NULL) / count_if(is_seed) AS mean_reached FROM v_cascade_nodes")
def k9_reached_per_seed(t):
    return cascade.reached_per_seed(t.cascade_nodes)


@query("SELECT id, acct FROM v_cascade_nodes WHERE activation_step = 3 AND NOT is_ia AND (contains(lower(acct), '7') OR contains(cast(id AS string), '7'))")
def f17_active_nodes(t):
    return cascade.active_nodes(t.cascade_nodes, 3, "human", "7").select("id", "acct")


@query(f"WITH {REACH} SELECT id, direct_reached FROM reach WHERE contains(acct, '2')")
def f18_search_seeds(t):
    return cascade.search_seeds(cascade.seed_leaderboard(t.cascade_nodes, t.cascade_edges), "2").select("id", "direct_reached")
