"""Filters, access, retention, merging and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import measures, scope as scopes
from ..operators import access as A
from ..operators import catalog as C
from ..operators.lineage import written
from ..sources import testdata as T
from .registry import query

_AS_OF = "2024-02-10 00:00:00"


def _as_of():
    return F.lit(_AS_OF).cast("timestamp_ntz")


def candidates(spark, sf, marks=None):
    """Findings of each nation's plan in confidence order; ``marks`` adds columns before rows are moved to be numbered."""
    from pyspark.sql import Window

    rows = T.findings(spark, sf).join(T.plans(spark, sf), F.col("object") == F.col("plan_id"))
    rows = marks(rows) if marks else rows
    w = Window.partitionBy("plan_id").orderBy(F.desc("confidence"), "id")
    return rows.withColumn("pos", F.row_number().over(w))


# --- predicates ---


@query("numeric_filter", "SELECT plan_id, id FROM t_cand WHERE numeric_ok")
def numeric_filter(spark, sf):
    rows = T.findings(spark, sf).join(T.plans(spark, sf), F.col("object") == F.col("plan_id"))
    return C.apply_numeric_filters(rows, F.col("numeric_filters")).select("plan_id", "id")


@query("observation_matches", """
SELECT o.id, o.property_name, t.op AS operator, CASE WHEN o.unit<>t.u THEN false ELSE coalesce(CASE t.op
  WHEN 'between' THEN CASE WHEN o.value IS NOT NULL THEN o.value BETWEEN t.a AND t.b ELSE o.min_value<=t.b AND o.max_value>=t.a END
  WHEN 'gte' THEN coalesce(o.value, o.max_value)>=t.v WHEN 'lt' THEN coalesce(o.value, o.min_value)<t.v END, true) END AS matches
FROM t_find f JOIN t_flt t ON t.plan_id=f.n_name JOIN t_obs o ON o.id=f.id AND o.property_name=t.prop""")
def observation_matches(spark, sf):
    rows = T.findings(spark, sf).join(T.plans(spark, sf), F.col("object") == F.col("plan_id"))
    pairs = rows.select("id", F.explode("observations").alias("o"), "numeric_filters").select(
        "id", "o", F.explode("numeric_filters").alias("f")
    ).filter(F.col("o.property_name") == F.col("f.property_name"))
    return pairs.select(
        "id", "o.property_name", "f.operator", measures.observation_matches(F.col("o"), F.col("f")).alias("matches")
    )


@query("enforce_scope", """
SELECT plan_id, count(*) AS candidates, count(*) FILTER (out_year OR out_geo) AS dropped,
 count(*) FILTER (wants_year AND s_year IS NULL) AS unknown_year, 0::BIGINT AS unknown_geography FROM t_cand GROUP BY ALL""")
def enforce_scope(spark, sf):
    rows = T.findings(spark, sf).join(T.plans(spark, sf), F.col("object") == F.col("plan_id"))
    return C.scope_report(C.enforce_scope(rows), ["plan_id"])


@query("document_years", """
SELECT 'doc-'||doc_id AS document_id, CASE WHEN doc_id%5<>0 THEN (1990+doc_id%40)::INTEGER END AS year,
 CASE WHEN doc_id%4<>0 THEN CASE doc_id%3 WHEN 0 THEN 'россия' WHEN 1 THEN 'казахстан' ELSE 'урал россия' END END AS geography FROM documents""")
def document_years(spark, sf):
    from ..operators.ingest import document_scope

    d = document_scope(T.documents(spark, sf))
    return d.select(
        "document_id", scopes.documented_year(F.col("scope")).alias("year"),
        scopes.normalize_geography(scopes.documented_geography(F.col("scope"))).alias("geography"),
    )


@query("geography_matches", """
SELECT doc_id, doc_id%4<>0 AND doc_id%3<>1 AS russia, doc_id%4<>0 AND doc_id%3=2 AS ural, doc_id%4<>0 AND doc_id%3=1 AS kz FROM documents""")
def geography_matches(spark, sf):
    d = T.documents(spark, sf)
    hit = lambda *names: F.coalesce(
        scopes.geography_matches(F.col("geography"), F.array(*[F.lit(n) for n in names])), F.lit(False)
    )
    return d.select(
        F.substring("document_id", 5, 20).cast("bigint").alias("doc_id"), hit("RU", "x").alias("russia"),
        hit("УРАЛ").alias("ural"), hit("Kazakhstan").alias("kz"),
    )


@query("semantic_findings", "SELECT id FROM t_find WHERE s_origin IS NULL")
def semantic_findings(spark, sf):
    return C.semantic(T.findings(spark, sf)).select("id")


@query("demo_split", """
SELECT plan_id, id, coalesce(s_origin='demo', false) AS is_demo, row_number() OVER (PARTITION BY plan_id ORDER BY (s_origin IS NOT NULL), pos)::INTEGER AS place
FROM t_cand""")
def demo_split(spark, sf):
    from pyspark.sql import Window

    rows = candidates(spark, sf).withColumn("is_demo", scopes.is_demo(F.col("scope")))
    w = Window.partitionBy("plan_id").orderBy("is_demo", "pos")
    return rows.select("plan_id", "id", "is_demo", F.row_number().over(w).alias("place"))


@query("facts", "SELECT id, subject, n_name AS object FROM t_find WHERE subject IS NOT NULL")
def facts(spark, sf):
    return C.facts(T.findings(spark, sf)).select("id", "subject", "object")


@query("filter_findings", """
SELECT id FROM t_find WHERE status='disputed' AND contains(lower(subject), 'brand#2') AND (contains(lower(statement), 'in 1996') OR contains(lower(s_name), 'in 1996'))""")
def filter_findings(spark, sf):
    return C.filter_findings(T.findings(spark, sf), status="disputed", subject="BRAND#2", text="in 1996").select("id")


@query("filter_entities", """
SELECT id FROM t_find WHERE regexp_matches(lower(subject), '(^|[^a-z0-9_])(brand#1|promo)([^a-z0-9_]|$)')""")
def filter_entities(spark, sf):
    return C.filter_entities(T.findings(spark, sf), ["Brand#1", "promo "]).select("id")


@query("access_rows", "SELECT id FROM t_find WHERE data_class IN ('public','internal')")
def access_rows(spark, sf):
    return A.acl_rows(T.findings(spark, sf), {"public", "internal"}).select("id")


@query("access_graph", """
SELECT e.id FROM t_edge e JOIN t_node a ON e.source=a.id JOIN t_node b ON e.target=b.id
WHERE e.data_class IN ('public','internal') AND a.data_class IN ('public','internal') AND b.data_class IN ('public','internal')""")
def access_graph(spark, sf):
    return A.acl_graph(T.nodes(spark, sf), T.edges(spark, sf), {"public", "internal"})[1].select("id")


@query("access_decisions", """
SELECT c_custkey, CASE WHEN c_mktsegment='MACHINERY' THEN 'missing_permission' WHEN c_custkey%4<>0 AND c_nationkey%5=0 THEN 'project_scope_denied'
 WHEN c_custkey%3=2 AND c_acctbal<5000 THEN 'restricted_review_required' ELSE 'allowed' END AS reason_code FROM customer""")
def access_decisions(spark, sf):
    rows = T.table(spark, sf, "customer").selectExpr(
        "c_custkey", "IF(c_mktsegment = 'MACHINERY', array('graph:read'), IF(c_acctbal < 5000, array('findings:read'), "
        "array('findings:read', 'restricted:read'))) AS permissions",
        "IF(c_nationkey % 5 = 0, array('p0'), array('p0', 'p1')) AS projects", "'findings:read' AS required_permission",
        "IF(c_custkey % 4 <> 0, 'p1', '') AS project_id",
        "CASE c_custkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' ELSE 'restricted' END AS data_class",
    )
    return A.decide(rows).select("c_custkey", "reason_code")


@query("access_answers", """
WITH a AS (SELECT n_name AS query_id, list(id ORDER BY id) FILTER (data_class<>'restricted') AS kept, count(*) AS n,
 count(*) FILTER (data_class<>'restricted') AS k FROM t_find GROUP BY ALL)
SELECT query_id, k AS findings, n>k AS hidden, (CASE WHEN n>k THEN 0 ELSE 1 END)::BIGINT AS conflicts,
 (SELECT count(*) FROM t_find f WHERE f.n_name=query_id AND f.data_class<>'restricted') AS observations FROM a""")
def access_answers(spark, sf):
    # One answer per supplier nation with one tool observation per finding.
    findings = written(T.findings(spark, sf).select(F.col("object").alias("query_id"), "id", "data_class"))
    answers = findings.select("query_id").distinct().withColumns({"conflicts": F.array(F.lit("c")), "knowledge_gaps": F.array(F.lit("g"))})
    observations = findings.select("query_id", "id", F.array("id").alias("finding_ids"))
    cut, kept, seen = A.acl_answers(answers, findings, observations, {"public", "internal"})
    for name, rows in (("findings", kept), ("observations", seen)):
        counts = rows.groupBy(F.col("query_id").alias("_q")).agg(F.count("*").alias(name))
        cut = cut.join(counts, F.col("query_id").eqNullSafe(F.col("_q")), "left").drop("_q").fillna(0, [name])
    return cut.select("query_id", "findings", "hidden", F.size("conflicts").cast("bigint").alias("conflicts"), "observations")


@query("answer_gate", f"""
SELECT event_id AS query_id, CASE WHEN event_type='error' OR CASE WHEN event_type='signup' THEN ts ELSE ts+INTERVAL 30 DAY END <= TIMESTAMP '{_AS_OF}'
 THEN 'not_found' WHEN user_id%3=2 AND event_type<>'click' THEN 'forbidden' ELSE 'ok' END AS verdict FROM events""")
def answer_gate(spark, sf):
    stored = T.answers(spark, sf).join(
        T.table(spark, sf, "events").selectExpr(
            "event_id AS query_id", "IF(user_id % 3 = 2, array('public', 'restricted'), array('public')) AS data_classes"
        ), "query_id"
    )
    readers = T.table(spark, sf, "events").selectExpr(
        "event_id AS query_id", "IF(event_type = 'error', 'x', concat('u', user_id)) AS reader_id",
        "IF(event_type = 'click', array('public', 'internal', 'restricted'), array('public', 'internal')) AS allowed",
    )
    return A.answer_gate(stored, readers, _as_of()).select("query_id", "verdict")


# --- retention and pages ---

_USED = "coalesce(CASE WHEN value>20 THEN ts+INTERVAL 3 DAY END, ts)"


@query("trim_answers", f"""
WITH a AS (SELECT event_id AS query_id, user_id, {_USED} AS used FROM events
 WHERE CASE WHEN event_type='signup' THEN ts ELSE ts+INTERVAL 30 DAY END > TIMESTAMP '2024-01-20'),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY used DESC, query_id DESC) AS n FROM a)
SELECT query_id FROM r WHERE n<=100 ORDER BY used DESC, query_id DESC LIMIT 5000""")
def trim_answers(spark, sf):
    return C.trim_answers(T.answers(spark, sf), F.lit("2024-01-20").cast("timestamp_ntz")).select("query_id")


@query("trim_log", "SELECT event_id AS id FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000")
def trim_log(spark, sf):
    return C.trim_log(T.audit(spark, sf), 2000).select("id")


@query("trim_queue", "SELECT event_id AS query_id FROM events ORDER BY (event_type='purchase') DESC, ts DESC, event_id DESC LIMIT 500")
def trim_queue(spark, sf):
    return C.trim_queue(T.answers(spark, sf).withColumn("id", F.col("query_id")), 500).select("query_id")


@query("page", """
WITH a AS (SELECT id FROM t_find WHERE status='disputed') SELECT id, (SELECT count(*) FROM a) AS total FROM a ORDER BY id LIMIT 500 OFFSET 40""")
def page(spark, sf):
    return C.page(C.filter_findings(T.findings(spark, sf), status="disputed").select("id"), 9999, 40, [F.col("id")])


@query("recent", "SELECT event_id AS id FROM events WHERE user_id=7 ORDER BY ts DESC, event_id DESC LIMIT 51 OFFSET 5")
def recent(spark, sf):
    return C.recent(T.audit(spark, sf), 50, 5, actor="u7").select("id")


@query("latest", "SELECT 'u'||user_id AS actor_id, max_by(event_id, (ts, event_id)) AS id FROM events GROUP BY ALL")
def latest(spark, sf):
    return C.latest(T.audit(spark, sf), "actor_id", [F.desc("created_at"), F.desc("id")]).select("actor_id", "id")


@query("top_k", """
SELECT n_name AS object, id, r::INTEGER AS rank FROM (SELECT n_name, id, row_number() OVER (PARTITION BY n_name ORDER BY confidence DESC, id) AS r FROM t_find) WHERE r<=25""")
def top_k(spark, sf):
    return C.top_k(T.findings(spark, sf).select("object", "id", "confidence"), ["object"], [F.desc("confidence"), F.col("id")], 25).drop("confidence")


# --- merging ---


@query("dedupe_findings", """
WITH u AS (SELECT n_name, data_class, id, confidence, 0 AS src FROM t_find UNION ALL SELECT n_name, data_class, id, confidence, 1 FROM t_find WHERE status='consensus')
SELECT n_name AS object, id, min(src)::INTEGER AS src FROM u GROUP BY ALL""")
def dedupe_findings(spark, sf):
    f = T.findings(spark, sf).select("object", "id", "status")
    both = f.withColumn("src", F.lit(0)).unionByName(f.filter(F.col("status") == "consensus").withColumn("src", F.lit(1)))
    return C.dedupe_findings(both, ["object"], "src").select("object", "id", "src")


@query("merge_by_id", """
SELECT id, CASE WHEN status='disputed' THEN 'reviewed' ELSE status END AS status, confidence FROM t_find WHERE status<>'hypothesis'
UNION ALL SELECT id, 'new', confidence FROM t_find WHERE status='hypothesis'""")
def merge_by_id(spark, sf):
    f = T.findings(spark, sf).select("id", "status", "confidence").withColumn("pos", F.lit(0))
    left = f.filter(F.col("status") != "hypothesis")
    right = f.filter(F.col("status") != "consensus").withColumn(
        "status", F.when(F.col("status") == "disputed", "reviewed").otherwise("new")
    )
    return C.merge_by_id(left, right).drop("pos", "first_side")


@query("merge_graphs", """
SELECT type AS kind, count(*) AS n FROM t_node GROUP BY ALL UNION ALL SELECT relation, count(*) FROM t_edge GROUP BY ALL""")
def merge_graphs(spark, sf):
    nodes, edges = T.nodes(spark, sf), T.edges(spark, sf)
    names = nodes.select(F.col("type").alias("name")).distinct()
    left = (nodes.filter(F.col("type") != "expert"), edges.filter(F.col("relation") != "EXPERT_IN"), names)
    right = (nodes.filter(F.col("type") != "material"), edges.filter(F.col("relation") != "USED_IN"), names)
    n, e, _ = C.merge_graphs(left, right)
    return n.groupBy(F.col("type").alias("kind")).agg(F.count("*").alias("n")).unionByName(
        e.groupBy(F.col("relation").alias("kind")).agg(F.count("*").alias("n"))
    )


@query("upsert", """
SELECT id, CASE WHEN type='location' THEN upper(label)||' (new)' ELSE label END AS label FROM t_node""")
def upsert(spark, sf):
    nodes = T.nodes(spark, sf)
    batch = nodes.filter(F.col("type") == "location").withColumn("label", F.concat(F.upper("label"), F.lit(" (new)")))
    return C.upsert(nodes, batch, "id").select("id", "label")


@query("register_new", "SELECT id FROM t_find WHERE status='disputed'")
def register_new(spark, sf):
    f = T.findings(spark, sf)
    return C.register_new(f.filter(F.col("status") != "disputed"), f).select("id")


@query("rollback_batch", """
SELECT e.id FROM t_edge e WHERE e.source NOT LIKE 'customer-%' AND e.relation<>'USED_BY'""")
def rollback_batch(spark, sf):
    nodes = T.nodes(spark, sf).withColumn("created_by", F.when(F.col("type") == "expert", "b2").otherwise("b1"))
    edges = T.edges(spark, sf).withColumn("created_by", F.when(F.col("relation") == "USED_BY", "b2").otherwise("b1"))
    return C.rollback_batch(nodes, edges, "b2")[1].select("id")


@query("set_status", "SELECT id, CASE WHEN data_class='public' AND status='hypothesis' THEN 'consensus' ELSE status END AS status FROM t_find")
def set_status(spark, sf):
    f = T.findings(spark, sf)
    updates = f.filter((F.col("data_class") == "public") & (F.col("status") == "hypothesis")).select("id", F.lit("consensus").alias("status"))
    return C.set_status(f, updates).select("id", "status")


@query("backfill_fields", """
SELECT id, CASE WHEN data_class='public' THEN status ELSE 'old' END AS status, CASE WHEN data_class='public' THEN lower(subject) END AS subject_lower,
 CASE WHEN data_class='public' THEN concat_ws(';', 'geography='||s_geo, 'origin='||s_origin, 'year='||s_year) END AS scope_text,
 data_class='public' AS updated FROM t_find""")
def backfill_fields(spark, sf):
    f = T.findings(spark, sf)
    stored = f.select(
        "id", F.to_json(F.struct("id", "status", "subject", "superseded_by", "scope")).alias("finding_json"),
        F.lit("old").alias("status"), F.lit(None).cast("string").alias("subject_lower"),
        F.lit(None).cast("string").alias("superseded_by"), F.lit(None).cast("string").alias("scope_text"),
        F.when(F.col("data_class") == "internal", 3).when(F.col("data_class") == "restricted", 3).otherwise(2).alias("schema_version"),
    )
    return C.backfill_fields(stored).select("id", "status", "subject_lower", "scope_text", "updated")


@query("import_difference", """
SELECT 'node' AS kind, id FROM t_node WHERE type='expert' UNION ALL SELECT 'edge', id FROM t_edge WHERE relation='USED_BY'""")
def import_difference(spark, sf):
    nodes, edges = T.nodes(spark, sf), T.edges(spark, sf)
    kinds = lambda n, e: n.select(F.lit("node").alias("kind"), "id").unionByName(e.select(F.lit("edge").alias("kind"), "id"))
    before = kinds(nodes.filter(F.col("type") != "expert"), edges.filter(F.col("relation") != "USED_BY"))
    return C.id_diff(before, kinds(nodes, edges))


@query("dedupe_requests", """
WITH r AS (SELECT conv_id, turn AS pos, CASE WHEN turn%2=0 THEN 'hybrid_search' ELSE 'graph_traverse' END AS tool, substr(text,1,1) AS query FROM conversations)
SELECT conv_id, pos, min(pos) OVER (PARTITION BY conv_id, tool, query) AS owner_pos,
 pos<>min(pos) OVER (PARTITION BY conv_id, tool, query) AS duplicate FROM r""")
def dedupe_requests(spark, sf):
    r = T.table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn AS pos", "IF(turn % 2 = 0, 'hybrid_search', 'graph_traverse') AS tool", "substring(text, 1, 1) AS query",
        "array('a') AS finding_ids", "array('b') AS entities", "IF(turn % 4 < 2, array('USES', 'FEEDS'), array('FEEDS', 'USES')) AS relation_types",
        "2 AS max_hops",
    )
    return C.dedupe_requests(r, ["conv_id"]).select("conv_id", "pos", "owner_pos", "duplicate")


@query("load_findings", """
SELECT plan_id, id, pos::INTEGER AS pos, CASE WHEN status='hypothesis' THEN 'fallback' ELSE 'primary' END AS store FROM t_cand WHERE status<>'disputed'""")
def load_findings(spark, sf):
    ids = candidates(spark, sf).select("plan_id", "id", "pos")
    ids = ids.unionByName(ids.withColumn("pos", F.col("pos") + 1000000))
    f = T.findings(spark, sf).select("id", "status", F.when(F.col("status") == "disputed", "x").alias("superseded_by"))
    primary = f.filter(F.col("status") != "hypothesis").withColumn("store", F.lit("primary"))
    return C.load_findings(ids, primary, f.withColumn("store", F.lit("fallback")), ["plan_id"]).select("plan_id", "id", "pos", "store")


# --- versions ---


@query("supersede", "SELECT id, version::INTEGER AS version, superseded_by, statement FROM t_ver")
def supersede(spark, sf):
    return T.versioned_findings(spark, sf).select("id", "version", "superseded_by", "statement")


@query("supersede_refused", "SELECT id AS finding_id, 2 AS seq, 'already_superseded' AS refused FROM t_find WHERE status='disputed' AND data_class='restricted'")
def supersede_refused(spark, sf):
    f = T.findings(spark, sf)
    return C.supersede(f, T.corrections(f))[2]


@query("supersede_edges", """
SELECT 'supersedes-'||id||'-v2' AS id, id||'-v2' AS source, id AS target, 'SUPERSEDES' AS relation, data_class FROM t_find WHERE status='disputed'""")
def supersede_edges(spark, sf):
    f = T.findings(spark, sf)
    return C.supersede(f, T.corrections(f))[1].drop("confidence")


@query("version_history", """
SELECT a.id AS finding_id, count(*) AS versions, string_agg(b.version||':'||b.id, ' ' ORDER BY b.version) AS chain FROM t_ver a JOIN t_ver b ON a.root=b.root GROUP BY a.id""")
def version_history(spark, sf):
    """One row per finding, with the versions of its chain in order."""
    rows = C.version_history(T.versioned_findings(spark, sf))
    chain = F.array_sort(F.collect_list(F.struct("position", F.concat_ws(":", "version", "version_id").alias("x"))))
    return rows.groupBy("finding_id").agg(F.count("*").alias("versions"), F.array_join(F.transform(chain, lambda x: x["x"]), " ").alias("chain"))


@query("lookup_findings", """
SELECT a.id AS finding_id, b.id AS version_id, b.statement FROM t_find a JOIN t_ver b ON a.id=b.root AND b.superseded_by IS NULL
WHERE b.data_class IN ('public','internal')""")
def lookup_findings(spark, sf):
    ids = T.findings(spark, sf).select(F.col("id").alias("finding_id"))
    return C.lookup_findings(ids, T.versioned_findings(spark, sf), {"public", "internal"}).select("finding_id", "version_id", "statement")


# --- rollups ---


@query("corpus_stats", """
SELECT count(*) FILTER (type='publication') AS documents, count(*) FILTER (type='chunk') AS chunks, count(*) FILTER (type='claim') AS claims,
 count(*) FILTER (type NOT IN ('publication','chunk','claim')) AS entities, 0::BIGINT AS semantic_documents FROM t_node""")
def corpus_stats(spark, sf):
    return C.corpus_stats(T.nodes(spark, sf))


@query("document_count", "SELECT count(DISTINCT document_id) AS documents FROM t_evid")
def document_count(spark, sf):
    return C.document_count(T.findings(spark, sf))


@query("subject_index", """
SELECT coalesce(subject,'') AS subject, count(*) AS findings, count(*) FILTER (status='consensus') AS consensus,
 count(*) FILTER (status='disputed') AS disputed, count(*) FILTER (status='hypothesis') AS hypothesis FROM t_find GROUP BY ALL""")
def subject_index(spark, sf):
    return C.subject_index(T.findings(spark, sf))


@query("dashboard", """
WITH g AS (SELECT DISTINCT a.s_geo AS g, y.s_year AS y, o.s_origin AS o FROM (SELECT DISTINCT s_geo FROM t_claim) a
 JOIN (SELECT DISTINCT s_year FROM t_claim WHERE s_year IS NOT NULL) y ON true
 LEFT JOIN (SELECT DISTINCT s_origin FROM t_claim WHERE s_origin IS NOT NULL) o ON true),
h AS (SELECT count(*) AS free FROM g WHERE NOT EXISTS (SELECT 1 FROM t_claim c WHERE c.s_geo=g AND c.s_year=y AND (o IS NULL OR c.s_origin=o)))
SELECT (SELECT count(*) FROM t_node WHERE type='publication') AS documents, 0::BIGINT AS claims,
 (SELECT count(*) FROM t_node WHERE type NOT IN ('publication','chunk','claim')) AS entities, (SELECT count(*) FROM t_find) AS findings,
 (SELECT count(*) FROM t_evid) AS evidence, (SELECT count(*) FROM t_find WHERE status='disputed') AS conflicts,
 least(free, 12)::BIGINT AS gaps, greatest(free-12,0)::BIGINT AS gaps_omitted FROM h""")
def dashboard(spark, sf):
    return C.dashboard(T.findings(spark, sf), T.nodes(spark, sf))
