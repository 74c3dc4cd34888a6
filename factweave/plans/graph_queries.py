"""Graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import conflicts as K
from ..operators import graph as G
from ..operators import modularity as M
from ..operators import hypotheses as H
from ..sources import testdata as T
from .oracle import cte, pair_id, uuid5
from .registry import query

RELS = ["LOCATED_IN", "USED_BY", "USED_IN"]


def community_nodes(spark, sf):
    """Nodes with their first metadata value as community: brand, nation, segment, year."""
    return T.nodes(spark, sf).withColumn("community", F.element_at(F.map_values("metadata"), 1))


cte("t_com", """
SELECT 'part-'||p_partkey AS id, p_brand AS community FROM part UNION ALL SELECT DISTINCT 'type-'||p_type, 'type' FROM part
UNION ALL SELECT 'supplier-'||s_suppkey, s_nationkey::VARCHAR FROM supplier UNION ALL SELECT 'nation-'||n_nationkey, n_regionkey::VARCHAR FROM nation
UNION ALL SELECT 'customer-'||c_custkey, c_mktsegment FROM customer UNION ALL SELECT 'order-'||o_orderkey, year(o_orderdate)::VARCHAR FROM orders""")
cte("t_nodec", "SELECT n.*, c.community FROM t_node n JOIN t_com c USING (id)")
cte("t_adj", """
SELECT id AS edge_id, source AS id, target AS neighbour, relation, data_class FROM t_edge UNION ALL SELECT id, target, source, relation, data_class FROM t_edge""")
cte("t_deg", "SELECT id, count(*) AS degree FROM t_adj GROUP BY ALL")


@query("degrees", "SELECT * FROM t_deg")
def degrees(spark, sf):
    return G.degrees(T.edges(spark, sf))


@query("adjacency", "SELECT id, neighbour, edge_id FROM t_adj WHERE relation IN ('LOCATED_IN','EXPERT_IN')")
def adjacency(spark, sf):
    return G.adjacency(T.edges(spark, sf), ["located_in", "EXPERT_IN"]).drop("data_class")


@query("edges_within", """
SELECT e.id FROM t_edge e JOIN t_node a ON a.id=e.source JOIN t_node b ON b.id=e.target WHERE a.data_class='public' AND b.data_class='public'""")
def edges_within(spark, sf):
    return G.edges_within(T.edges(spark, sf), T.nodes(spark, sf).filter("data_class = 'public'")).select("id")


_BACK = """WITH top AS (SELECT n.id FROM t_node n LEFT JOIN t_deg d ON n.id=d.id ORDER BY coalesce(degree,0) DESC, label, n.id LIMIT 600),
e AS (SELECT * FROM t_edge WHERE source IN (SELECT id FROM top) AND target IN (SELECT id FROM top) ORDER BY id LIMIT 3000)"""


@query("graph_backbone", _BACK + " SELECT id FROM top WHERE id IN (SELECT source FROM e UNION SELECT target FROM e)")
def graph_backbone(spark, sf):
    return G.graph_backbone(T.nodes(spark, sf), T.edges(spark, sf))[0].select("id")


@query("graph_backbone_report", _BACK + """
SELECT (SELECT count(*) FROM top WHERE id IN (SELECT source FROM e UNION SELECT target FROM e)) AS nodes_shown, (SELECT count(*) FROM t_node) AS nodes_total,
 (SELECT count(*) FROM e) AS edges_shown, (SELECT count(*) FROM t_edge) AS edges_total""")
def graph_backbone_report(spark, sf):
    return G.graph_backbone(T.nodes(spark, sf), T.edges(spark, sf))[2]


@query("ego", """
SELECT c.id AS centre, count(DISTINCT a.neighbour)+1 AS members, count(DISTINCT a.edge_id) AS edges FROM (SELECT id FROM t_node WHERE type='location') c JOIN t_adj a ON a.id=c.id GROUP BY ALL""")
def ego(spark, sf):
    nodes = T.nodes(spark, sf)
    n, e = G.ego(nodes, T.edges(spark, sf), nodes.filter("type = 'location'").select("id"))
    return n.groupBy("centre").agg(F.count("*").alias("members")).join(e.groupBy("centre").agg(F.count("*").alias("edges")), "centre")


@query("connections", """
SELECT e.target AS node_id, e.id AS edge_id, relation, 'in' AS direction, e.source AS other_id, n.label AS other_label FROM t_edge e JOIN t_node n ON n.id=e.source
WHERE e.target IN (SELECT id FROM t_node WHERE type='process')
UNION ALL SELECT e.source, e.id, relation, 'out', e.target, n.label FROM t_edge e JOIN t_node n ON n.id=e.target WHERE e.source IN (SELECT id FROM t_node WHERE type='process')""")
def connections(spark, sf):
    nodes = T.nodes(spark, sf)
    return G.connections(nodes, T.edges(spark, sf), nodes.filter("type = 'process'").select("id"))


@query("search_nodes", """
SELECT id, community='Brand#7' AS in_area FROM t_nodec WHERE contains(lower(label),'ring') OR type='process'""")
def search_nodes(spark, sf):
    n = community_nodes(spark, sf)
    return G.search_nodes(n, "Ring", "Brand#7").unionByName(G.search_nodes(n, "технолог", "Brand#7")).select("id", "in_area")


@query("area_rollup", """
WITH l AS (SELECT a.community, count(*) AS links FROM t_edge e JOIN t_com a ON a.id=e.source JOIN t_com b ON b.id=e.target WHERE a.community=b.community GROUP BY ALL)
SELECT n.community, count(*) AS records, 0::BIGINT AS claims, count(*) FILTER (type='publication') AS sources, count(*) FILTER (type<>'publication') AS entities, coalesce(any_value(links),0) AS links
FROM t_nodec n LEFT JOIN l ON l.community=n.community GROUP BY n.community""")
def area_rollup(spark, sf):
    return G.area_rollup(community_nodes(spark, sf), T.edges(spark, sf))


@query("finding_nodes", "SELECT 'finding-'||id AS finding_id, id AS node_id FROM t_node")
def finding_nodes(spark, sf):
    n = T.nodes(spark, sf)
    return G.finding_nodes(n.select(F.concat(F.lit("finding-"), "id").alias("id")), n)


@query("node_findings", """
SELECT 'document-'||document_id AS node_id, e.id AS finding_id, confidence FROM (SELECT DISTINCT id, document_id FROM t_evid) e JOIN t_find f ON f.id=e.id""")
def node_findings(spark, sf):
    f = T.findings(spark, sf)
    docs = f.select(F.explode("evidence.document_id").alias("d")).distinct().select(F.concat(F.lit("document-"), "d").alias("id"))
    return G.node_findings(docs, f)


# --- anchors and traversal ---

cte("t_name", """
SELECT DISTINCT 'w-'||string_split(p_name,' ')[2] AS query_id, string_split(p_name,' ')[2] AS name FROM part
UNION ALL SELECT DISTINCT 't-'||p_type, 'all '||lower(p_type)||' goods' FROM part UNION ALL SELECT 'n-'||n_name, n_name FROM nation""")


def names(spark, sf):
    part, nation = T.table(spark, sf, "part"), T.table(spark, sf, "nation")
    words = part.selectExpr("concat('w-', split(p_name, ' ')[1]) AS query_id", "split(p_name, ' ')[1] AS name").distinct()
    types = part.selectExpr("concat('t-', p_type) AS query_id", "concat('all ', lower(p_type), ' goods') AS name").distinct()
    return words.unionByName(types).unionByName(nation.selectExpr("concat('n-', n_name) AS query_id", "n_name AS name"))


@query("anchors", """
WITH ex AS (SELECT query_id, n.id, n.data_class, label FROM t_name JOIN t_node n ON label=name WHERE n.data_class IN ('public','internal')),
lo AS (SELECT DISTINCT query_id, n.id, n.data_class, label FROM t_name JOIN t_node n ON contains(lower(label), lower(name)) OR contains(lower(name), lower(label)) WHERE n.data_class IN ('public','internal')),
c AS (SELECT query_id, count(*) AS n FROM ex GROUP BY ALL), m AS (SELECT query_id, count(*) AS matched FROM (SELECT query_id FROM ex UNION ALL SELECT query_id FROM lo) GROUP BY ALL),
p AS (SELECT query_id, id, 0 AS level FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY data_class, label, id) AS r FROM ex) WHERE r<=5
 UNION ALL SELECT l.query_id, id, 1 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY data_class, label, id) AS r FROM lo) l LEFT JOIN c ON c.query_id=l.query_id WHERE r<=5-least(coalesce(n,0),5))
SELECT p.query_id, id, min(level)::INTEGER AS level, any_value(matched) AS matched FROM p JOIN m ON m.query_id=p.query_id GROUP BY p.query_id, id""")
def anchors(spark, sf):
    return G.anchors(names(spark, sf), T.nodes(spark, sf), {"public", "internal"})


_WALK = """
w AS (SELECT DISTINCT a.id, neighbour FROM t_adj a JOIN t_node n ON n.id=neighbour WHERE relation IN ('LOCATED_IN','USED_BY','USED_IN') AND a.data_class<>'restricted' AND n.data_class<>'restricted'),
v0 AS (SELECT n_name AS query_id, 'nation-'||n_nationkey AS id FROM nation),
l1 AS (SELECT DISTINCT query_id, neighbour AS id FROM v0 JOIN w ON w.id=v0.id WHERE NOT EXISTS (SELECT 1 FROM v0 x WHERE x.query_id=v0.query_id AND x.id=neighbour)),
v1 AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS r FROM l1) WHERE r<=199),
s1 AS (SELECT query_id, id, 0 AS level FROM v0 UNION ALL SELECT query_id, id, 1 FROM v1),
l2 AS (SELECT DISTINCT v1.query_id, neighbour AS id FROM v1 JOIN w ON w.id=v1.id WHERE NOT EXISTS (SELECT 1 FROM s1 x WHERE x.query_id=v1.query_id AND x.id=neighbour)),
n1 AS (SELECT query_id, 200-count(*) AS room FROM s1 GROUP BY ALL),
v2 AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS r FROM l2) JOIN n1 USING (query_id) WHERE r<=room),
vis AS (SELECT query_id, id, level FROM s1 UNION ALL SELECT query_id, id, 2 FROM v2)"""


def visited(spark, sf):
    starts = T.table(spark, sf, "nation").selectExpr("n_name AS query_id", "concat('nation-', n_nationkey) AS id")
    return G.neighbourhood(starts, T.nodes(spark, sf), T.edges(spark, sf), 2, RELS, {"public", "internal"})


@query("neighbourhood", f"WITH {_WALK} SELECT query_id, id, level::INTEGER AS level FROM vis")
def neighbourhood(spark, sf):
    return visited(spark, sf)


@query("subgraph_edges", f"""
WITH {_WALK}, i AS (SELECT a.query_id, e.id, row_number() OVER (PARTITION BY a.query_id ORDER BY e.id, source, target) AS r, count(*) OVER (PARTITION BY a.query_id) AS matched
 FROM t_edge e JOIN vis a ON a.id=e.source JOIN vis b ON b.id=e.target AND a.query_id=b.query_id WHERE relation IN ('LOCATED_IN','USED_BY','USED_IN') AND data_class<>'restricted')
SELECT query_id, id, r::INTEGER AS rank, matched FROM i WHERE r<=2000""")
def subgraph_edges(spark, sf):
    return G.subgraph_edges(visited(spark, sf), T.edges(spark, sf), RELS, {"public", "internal"}).select("query_id", "id", "rank", "matched")


@query("experts", """
WITH l AS (SELECT p_type AS query_id, 'customer-'||o_custkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, p_type) AS r FROM t_bought) WHERE r=1),
v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS r FROM l)
SELECT query_id, v.id, n.label FROM v JOIN t_node n ON n.id=v.id WHERE r<=199""")
def experts(spark, sf):
    starts = T.table(spark, sf, "part").selectExpr("p_type AS query_id", "concat('type-', p_type) AS id").distinct()
    nodes = T.nodes(spark, sf)
    return G.experts(G.neighbourhood(starts, nodes, T.edges(spark, sf), 1, ["EXPERT_IN"]), nodes)


# --- components, communities ---


@query("communities")
def communities(spark, sf):
    """No SQL: iterative. ``community_checks`` states what must hold of it."""
    return M.communities(T.nodes(spark, sf), T.edges(spark, sf))


@query("community_checks", "SELECT count(*) AS nodes, 0::BIGINT AS misplaced, 0::BIGINT AS gaining_moves, 0::BIGINT AS split_communities FROM t_node")
def community_checks(spark, sf):
    nodes, edges = T.nodes(spark, sf), T.edges(spark, sf)
    return M.checks(M.communities(nodes, edges), nodes, edges)


@query("label_communities", """
WITH s AS (SELECT community, count(*) AS size FROM t_com GROUP BY ALL), c AS (SELECT community, label, count(*) AS n FROM t_nodec GROUP BY ALL),
m AS (SELECT community, arg_min(lower(label), (-n, -length(label), lower(label))) AS name FROM c GROUP BY ALL)
SELECT CASE WHEN size<15 THEN 'small' ELSE 'named' END AS kind, count(*) AS communities, sum(size)::BIGINT AS nodes, CASE WHEN size<15 THEN 1 ELSE count(*) END::BIGINT AS names FROM s GROUP BY size<15""")
def label_communities(spark, sf):
    n = community_nodes(spark, sf)
    named = G.label_communities(n, n.select("id", "community"))
    rows = named.join(n.select("id", "community"), "id")
    kind = F.when(F.col("name") == G.SMALL_COMMUNITY, "small").otherwise("named")
    return rows.groupBy(kind.alias("kind")).agg(
        F.count_distinct("community").alias("communities"), F.count("*").alias("nodes"), F.count_distinct("name").alias("names")
    )


_PROFILE = """
p AS (SELECT n.community, n.id, n.label, n.type, coalesce(degree,0) AS degree FROM t_nodec n LEFT JOIN t_deg d ON d.id=n.id),
lb AS (SELECT community, label, min((-degree, label, id)) AS b FROM p GROUP BY ALL),
ll AS (SELECT community, string_agg(label, ', ' ORDER BY b) AS labels FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY b) AS r FROM lb) WHERE r<=8 GROUP BY ALL),
sb AS (SELECT community, label, min((-degree, label, id)) AS b FROM p WHERE type='publication' GROUP BY ALL),
sl AS (SELECT community, string_agg(label, ', ' ORDER BY b) AS sources FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY b) AS r FROM sb) WHERE r<=3 GROUP BY ALL),
tp AS (SELECT community, string_agg(type||':'||n, ', ' ORDER BY n DESC, type) AS types, sum(n)::BIGINT AS size FROM (SELECT community, type, count(*) AS n FROM p GROUP BY ALL) GROUP BY ALL),
pr AS (SELECT tp.community, size, types, labels, coalesce(sources,'') AS sources FROM tp JOIN ll ON ll.community=tp.community LEFT JOIN sl ON sl.community=tp.community)"""


def profiles(spark, sf):
    nothing = T.findings(spark, sf).select("id", "statement")
    return G.community_profiles(community_nodes(spark, sf), T.edges(spark, sf), nothing)


@query("community_profiles", f"WITH {_PROFILE} SELECT * FROM pr")
def community_profiles(spark, sf):
    return profiles(spark, sf).select("community", "size", "types", F.array_join("labels", ", ").alias("labels"), F.array_join("sources", ", ").alias("sources"))


_RU = ", ".join(f"'{k}': '{v.lower()}'" for k, v in G.TYPE_NAMES.items())


@query("rank_profiles", f"""
WITH {_PROFILE},
h AS (SELECT pr.community, size, lower(pr.community||' '||replace(labels,', ',' ')||' '||replace(sources,', ',' '))||' '||
 (SELECT string_agg(coalesce(MAP {{{_RU}}}[type], type), ' ') FROM (SELECT DISTINCT type FROM p WHERE p.community=pr.community)) AS hay FROM pr),
k AS (SELECT DISTINCT r_name AS query_id, lower(t) AS t FROM region, (SELECT unnest(['ring','small','brand#1']) AS t UNION ALL SELECT DISTINCT string_split(p_name,' ')[1] FROM part)),
x AS (SELECT q.query_id, h.community, size, count(*) FILTER (contains(hay, t)) AS hits FROM k q, h GROUP BY ALL)
SELECT query_id, community, hits, size, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, size DESC, community)::INTEGER AS rank FROM x QUALIFY rank<=4""")
def rank_profiles(spark, sf):
    words = T.table(spark, sf, "part").selectExpr("split(p_name, ' ')[0] AS token").distinct()
    fixed = F.array(*[F.lit(w) for w in ("ring", "small", "brand#1")])
    all_words = words.agg(F.array_union(fixed, F.collect_set("token")))
    tokens = T.table(spark, sf, "region").select(F.col("r_name").alias("query_id"), F.explode(all_words.scalar()).alias("token"))
    return G.rank_profiles(tokens, profiles(spark, sf))


@query("profile_summary", f"""
WITH {_PROFILE},
y AS (SELECT community, CASE WHEN min(community::INTEGER)=max(community::INTEGER) THEN min(community) END AS year FROM p WHERE type='publication' GROUP BY ALL),
t3 AS (SELECT community, string_agg(CASE type {' '.join(f"WHEN '{k}' THEN '{v.lower()}'" for k, v in G.TYPE_NAMES.items())} END||' '||n, ', ' ORDER BY n DESC, type) AS t FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, type) AS r FROM (SELECT community, type, count(*) AS n FROM p GROUP BY ALL)) WHERE r<=3 GROUP BY ALL),
s AS (SELECT pr.community, '«'||pr.community||'»: '||size||' сущностей · '||t||' · сущности: '||labels||CASE WHEN sources<>'' THEN ' · источники: '||sources||coalesce(', '||year,'') ELSE '' END AS x FROM pr JOIN t3 ON t3.community=pr.community LEFT JOIN y ON y.community=pr.community)
SELECT community, CASE WHEN length(x)<=520 THEN x ELSE rtrim(substr(x,1,519))||'…' END AS summary FROM s""")
def profile_summary(spark, sf):
    return G.profile_summary(profiles(spark, sf))


# --- merge proposals ---


def _proposals(spark, sf):
    r = T.extraction(spark, sf)[2].groupBy("mention", "canonical_name", "action").agg(F.max("confidence").alias("confidence"), F.min("document_id").alias("rationale")).withColumn("seq", F.lit(1))
    base = r.filter("confidence >= 0.8").select(
        G.proposal_id(F.col("mention"), F.col("canonical_name")).alias("id"), F.col("mention").alias("source"), F.col("canonical_name").alias("target"),
        F.lit(0.1).alias("confidence"), F.lit("old").alias("rationale"), F.when(F.length("mention") > 4, "accepted").otherwise("rejected").alias("status"),
    )
    one = lambda df: df.groupBy("id").agg(F.min_by(F.struct(*[x for x in df.columns if x != "id"]), F.struct("source")).alias("x")).select("id", "x.*")
    return one(base), r.withColumn("mention", F.lower("mention")).groupBy("mention", "action").agg(
        F.max("confidence").alias("confidence"), F.min("rationale").alias("rationale")
    ).withColumn("canonical_name", F.concat(F.lit("canon "), "mention")).withColumn("seq", F.lit(1))


_PID = uuid5(ids.MERGE_NAMESPACE, "lower(m)||'->canon '||lower(m)")
cte("t_mp", f"""
SELECT lower(m) AS source, {_PID} AS id, max(confidence) AS confidence, bool_or(confidence>=0.8) AS old,
 min(m) FILTER (confidence>=0.8) AS old_name FROM (SELECT mention AS m, max(confidence) AS confidence FROM t_res GROUP BY ALL) GROUP BY lower(m), id""")


@query("register_proposals", """
SELECT id, CASE WHEN old AND length(old_name)>4 THEN 'accepted' ELSE 'proposed' END AS status, confidence FROM t_mp""")
def register_proposals(spark, sf):
    base, batch = _proposals(spark, sf)
    return G.register_proposals(base, batch).select("id", "status", "confidence")


@query("alias_map", "SELECT lower(w3) AS alias, max('agreed '||lower(w3)) AS canonical FROM t_words WHERE length(w3)>6 GROUP BY ALL")
def alias_map(spark, sf):
    acc = T.extraction(spark, sf)[3]
    props = acc.select(F.col("alias").alias("source"), F.col("canonical").alias("target"), F.lit("accepted").alias("status"))
    return G.alias_map(props.unionByName(props.withColumn("status", F.lit("reverted")).withColumn("target", F.lit("zzz"))))


# --- hypotheses ---


def _same_nation_pairs(spark, sf):
    return K.detect_conflicts(K.to_claims(T.findings(spark, sf), carry=("object",)), by=["object"])


def signals(spark, sf):
    """Numeric signals of the pairs of one nation; the claims carry what the signals need."""
    f = T.findings(spark, sf)
    claims = H.with_sides(K.to_claims(f, carry=("object",)), f).drop("evidence_ids", "kind")
    return H.numeric_signals(K.detect_conflicts(claims, by=["object"], carry=H.SIDES), f)


@query("numeric_signals", f"""
WITH p AS (SELECT * FROM t_pair WHERE l_nation=r_nation),
s AS (SELECT {pair_id('left_claim_id', 'right_claim_id', 'p.property_name', 'shared_scope')} AS pair_id, a.s_name AS an, b.s_name AS bn, least(a.confidence,b.confidence) AS confidence,
 CASE WHEN 'restricted' IN (a.data_class,b.data_class) THEN 'restricted' WHEN 'internal' IN (a.data_class,b.data_class) THEN 'internal' ELSE 'public' END AS data_class FROM p JOIN t_find a ON a.id=least(left_finding_id,right_finding_id) JOIN t_find b ON b.id=greatest(left_finding_id,right_finding_id)
 WHERE NOT (a.doc=b.doc AND a.quote=b.quote AND a.n=1 AND b.n=1))
SELECT pair_id, 'numeric_discrepancy' AS kind, an AS first_source, bn AS second_source, confidence, data_class FROM s""")
def numeric_signals(spark, sf):
    s = signals(spark, sf)
    title = lambda i: F.get(F.regexp_extract_all("statement", F.lit("«([^»]*)»"), F.lit(1)), F.lit(i))
    return s.select("pair_id", "kind", title(0).alias("first_source"), title(1).alias("second_source"), "confidence", "data_class")


@query("pack_batches")
def pack_batches(spark, sf):
    """Ordered packing, tested against a plain loop. One group per nation, as a conflict graph would give."""
    f = T.findings(spark, sf)
    return H.pack_batches(f.select("id", F.col("object").alias("root"), "data_class"), f)


@query("ground_drafts", """
WITH d AS (SELECT id, quote, supp, n, n_name, yr FROM t_find)
SELECT id AS draft_id, CASE WHEN supp%5=0 THEN 'unknown_evidence' WHEN supp%5=1 THEN 'restatement' WHEN supp%5=2 AND n<2 THEN 'one_document' WHEN supp%5=3 THEN 'reserved_kind' END AS refused FROM d""")
def ground_drafts(spark, sf):
    f = T.findings(spark, sf).withColumn("k", F.regexp_extract("id", r"-(\d+)-\d+$", 1).cast("bigint") % 5)
    eids = F.transform("evidence", lambda e, i: F.concat_ws(":", "id", i.cast("string")))
    drafts = f.select(
        F.col("id").alias("draft_id"), F.expr("CASE k WHEN 2 THEN 'cross_source_conflict' WHEN 3 THEN 'numeric_discrepancy' ELSE 'cause' END").alias("kind"),
        F.when(F.col("k") == 1, F.element_at("evidence", 1)["quote"]).otherwise("why do the numbers move with the season").alias("statement"),
        F.lit(0.7).alias("confidence"), eids.alias("evidence_ids"), F.when(F.col("k") == 0, F.slice(eids, 1, 0)).otherwise(eids).alias("batch_ids"),
    )
    pairs = _same_nation_pairs(spark, sf)
    return H.ground_drafts(drafts, f, pairs).select("draft_id", "refused")


@query("signal_window", """
SELECT id, statement, (SELECT count(*) FROM t_find WHERE data_class='public') AS total FROM t_find WHERE data_class='public' ORDER BY status, statement, id LIMIT 100 OFFSET 10""")
def signal_window(spark, sf):
    f = T.findings(spark, sf).select("id", F.col("status").alias("kind"), "statement", "data_class")
    both = f.withColumn("seq", F.lit(2)).unionByName(f.withColumns({"seq": F.lit(1), "statement": F.lit("old")}))
    return H.signal_window(both, {"public"}, 100, 10).select("id", "statement", "total")
