"""The named read operations called by name, retrieval with vectors, and a corpus read from files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import measures
from ..operators import catalog as C
from ..operators import conflicts as K
from ..operators import hypotheses as H
from ..operators import tools
from ..operators.lineage import shared_folder
from ..sources import corpus
from ..sources import testdata as T
from .conflict_queries import GAPS
from .graph_queries import _PROFILE, _RU, profiles, signals
from .number_queries import _scaled, scaled
from .oracle import cte, pair_id
from .registry import query
from .search_queries import _GREEDY, _LEGS, _SIGNALS, _top

# --- named read operations ---------------------------------------------------------------------------------------------

cte("t_dv", """
SELECT 'q-'||a.vec_id AS query_id, 'd-'||b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
FROM embeddings a JOIN benchmark ON item_id=a.vec_id, embeddings b""")
_VECTOR_LEGS = _LEGS.replace("\nfu AS", f"\nl3 AS ({_top('t_dv', 18)}),\nfu AS").replace(
    "FROM l2)", "FROM l2 UNION ALL SELECT query_id, id, 0.6/(5+rank) FROM l3)"
)


@query("tool_hybrid_search", _GREEDY.format(signals=_SIGNALS.replace(_LEGS, _VECTOR_LEGS).strip(), k=6))
def tool_hybrid_search(spark, sf):
    """All three legs: vector i stands for document i, and for question i as well."""
    vectors = T.table(spark, sf, "embeddings").select(F.concat(F.lit("d-"), "vec_id").alias("id"), "vec_id", "embedding")
    asked = vectors.join(T.table(spark, sf, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id")
    pool = {
        "passages": T.passages(spark, sf), "vectors": vectors.select("id", "embedding"),
        "query_vectors": asked.select(F.concat(F.lit("q-"), "vec_id").alias("query_id"), "embedding"),
    }
    return tools.TOOLS["hybrid_search"](spark, T.search_queries(spark, sf), pool).select("query_id", "id", "rank")


def _walk(names: str) -> str:
    """Sub-queries of a walk of two levels from the anchors of (query_id, name, hops); the result is ``vis``."""
    first = "row_number() OVER (PARTITION BY query_id ORDER BY data_class, label, id) AS r"
    fresh = lambda level, seen: (
        f"SELECT DISTINCT {level}.query_id, neighbour AS id FROM {level} JOIN w ON w.id={level}.id "
        f"WHERE NOT EXISTS (SELECT 1 FROM {seen} x WHERE x.query_id={level}.query_id AND x.id=neighbour)"
    )
    enter = lambda new, seen: (
        f"SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS r FROM {new}) "
        f"JOIN (SELECT query_id, 200-count(*) AS room FROM {seen} GROUP BY ALL) USING (query_id) WHERE r<=room"
    )
    return f"""
nm AS ({names}),
ex AS (SELECT query_id, n.id, data_class, label FROM nm JOIN t_node n ON label=name),
lo AS (SELECT DISTINCT query_id, n.id, data_class, label FROM nm JOIN t_node n ON contains(lower(label), lower(name)) OR contains(lower(name), lower(label))),
ec AS (SELECT query_id, count(*) AS n FROM ex GROUP BY ALL),
v0 AS (SELECT query_id, id FROM (SELECT *, {first} FROM ex) WHERE r<=5
 UNION SELECT query_id, id FROM (SELECT *, {first} FROM lo) LEFT JOIN ec USING (query_id) WHERE r<=5-least(coalesce(n,0),5)),
w AS (SELECT DISTINCT a.id, neighbour FROM t_adj a JOIN t_node n ON n.id=neighbour),
l1 AS ({fresh('v0', 'v0')}), v1 AS ({enter('l1', 'v0')}), s1 AS (SELECT query_id, id, 0 AS level FROM v0 UNION ALL SELECT query_id, id, 1 FROM v1),
l2 AS ({fresh('v1', 's1')}), v2 AS ({enter('l2', 's1')}),
vis AS (SELECT query_id, id, level FROM (SELECT * FROM s1 UNION ALL SELECT query_id, id, 2 FROM v2) JOIN (SELECT DISTINCT query_id, hops FROM nm) USING (query_id) WHERE level<=hops)"""


def _graph(spark, sf):
    return {"nodes": T.nodes(spark, sf), "edges": T.edges(spark, sf)}


@query("tool_graph_traverse", f"""
WITH {_walk("SELECT n_name AS query_id, n_name AS name, 1+n_nationkey%2 AS hops FROM nation")} SELECT query_id, id, level::INTEGER AS level FROM vis""")
def tool_graph_traverse(spark, sf):
    requests = T.table(spark, sf, "nation").selectExpr("n_name AS query_id", "array(n_name) AS entity_names", "CAST(1 + n_nationkey % 2 AS INT) AS max_hops")
    return tools.TOOLS["graph_traverse"](spark, requests, _graph(spark, sf)).select("query_id", "id", "level")


@query("tool_expert_lookup", f"""
WITH {_walk("SELECT DISTINCT p_type AS query_id, p_type AS name, 1 AS hops FROM part")}
SELECT query_id, v.id, label FROM vis v JOIN t_node n ON n.id=v.id WHERE type='expert'""")
def tool_expert_lookup(spark, sf):
    requests = T.table(spark, sf, "part").selectExpr("p_type AS query_id", "array(p_type) AS entity_names", "1 AS max_hops").distinct()
    return tools.TOOLS["expert_lookup"](spark, requests, _graph(spark, sf))


@query("tool_community_search", f"""
WITH {_PROFILE},
h AS (SELECT pr.community, size, lower(pr.community||' '||replace(labels,', ',' ')||' '||replace(sources,', ',' '))||' '||
 (SELECT string_agg(coalesce(MAP {{{_RU}}}[type], type), ' ') FROM (SELECT DISTINCT type FROM p WHERE p.community=pr.community)) AS hay FROM pr),
k AS (SELECT n_name AS query_id, lower(unnest(list_concat(['small', 'brand#1'], CASE WHEN length(n_name)>=4 THEN [n_name] ELSE [] END))) AS t FROM nation),
x AS (SELECT q.query_id, h.community, size, count(*) FILTER (contains(hay, t)) AS hits FROM k q, h GROUP BY ALL)
SELECT query_id, community, hits, size, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, size DESC, community)::INTEGER AS rank FROM x QUALIFY rank<=4""")
def tool_community_search(spark, sf):
    requests = T.table(spark, sf, "nation").selectExpr("n_name AS query_id", "concat('Small Brand#1: ', replace(n_name, ' ', '_')) AS text")
    return tools.TOOLS["community_search"](spark, requests, {"profiles": profiles(spark, sf)})


@query("tool_numeric_filter", "SELECT plan_id AS query_id, id FROM t_cand WHERE numeric_ok")
def tool_numeric_filter(spark, sf):
    pool = T.findings(spark, sf).withColumn("query_id", F.col("object"))
    requests = T.plans(spark, sf).select(F.col("plan_id").alias("query_id"), "numeric_filters")
    return tools.TOOLS["numeric_filter"](spark, requests, {"pool": pool}).select("query_id", "id")


_REPORT = """SELECT * EXCLUDE (key), CASE WHEN shown>0 THEN 'success' ELSE 'warning' END AS status, total-covered AS uncovered
FROM ({gaps}) JOIN (SELECT {key} AS key, count(*) AS claims, count(DISTINCT finding_id) AS findings FROM t_claim GROUP BY ALL) ON key={name}"""


@query("gap_report", _REPORT.format(gaps=GAPS, key="data_class", name="data_class"))
def gap_report(spark, sf):
    return K.gap_report(K.to_claims(T.findings(spark, sf), carry=("data_class",)), ["data_class"])


# A nation without years and origins has one scope dimension alone, so its space is property by subject.
_FIELD_GAPS = """
WITH z AS (SELECT n_name FROM t_claim GROUP BY ALL HAVING count(s_year)=0 AND count(s_origin)=0 AND count(DISTINCT subject_id)>1 AND count(DISTINCT property_name)>1),
c AS (SELECT DISTINCT n_name, property_name AS p, subject_id AS s FROM t_claim JOIN z USING (n_name)),
g AS (SELECT a.n_name, p, s FROM (SELECT DISTINCT n_name, p FROM c) a JOIN (SELECT DISTINCT n_name, s FROM c) b USING (n_name)),
f AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY p, s) AS pos FROM g ANTI JOIN c USING (n_name, p, s)),
x AS (SELECT n_name, count(*) AS shown, string_agg('property='||p||', subject='||s, ' | ' ORDER BY pos) AS gaps FROM f WHERE pos<=12 GROUP BY ALL),
n AS (SELECT n_name, count(DISTINCT p) AS np, count(DISTINCT s) AS ns, count(*) AS covered FROM c GROUP BY ALL)
SELECT n.n_name, 'property:'||np||'×subject:'||ns AS dimensions, concat_ws(', ', CASE WHEN np>=8 THEN 'property' END, CASE WHEN ns>=8 THEN 'subject' END) AS wide,
 np*ns AS total, covered, coalesce(shown,0) AS shown, np*ns-covered-coalesce(shown,0) AS omitted, coalesce(gaps,'') AS gaps FROM n LEFT JOIN x USING (n_name)"""


@query("tool_gap_scan", _REPORT.format(
    gaps=f"SELECT * FROM ({GAPS.replace('data_class', 'n_name')}) UNION ALL SELECT * FROM ({_FIELD_GAPS})", key="n_name", name="n_name"
).replace("* EXCLUDE (key)", "n_name AS query_id, * EXCLUDE (key, n_name)"))
def tool_gap_scan(spark, sf):
    pool = T.findings(spark, sf).withColumn("query_id", F.col("object"))
    return tools.TOOLS["gap_scan"](spark, pool.select("query_id").distinct(), {"pool": pool})


@query("tool_finding_lookup", "SELECT a.id AS finding_id, b.id AS version_id, b.statement FROM t_find a JOIN t_ver b ON a.id=b.root AND b.superseded_by IS NULL")
def tool_finding_lookup(spark, sf):
    requests = T.findings(spark, sf).select(F.array("id").alias("finding_ids"))
    return tools.TOOLS["finding_lookup"](spark, requests, {"findings": T.versioned_findings(spark, sf)}).select("finding_id", "version_id", "statement")


# --- signals, bands ----------------------------------------------------------------------------------------------------


@query("filter_signals", f"""
WITH p AS (SELECT * FROM t_pair WHERE l_nation=r_nation),
s AS (SELECT {pair_id('left_claim_id', 'right_claim_id', 'p.property_name', 'shared_scope')} AS pair_id, a.id AS a, b.id AS b
 FROM p JOIN t_find a ON a.id=least(left_finding_id,right_finding_id) JOIN t_find b ON b.id=greatest(left_finding_id,right_finding_id)
 WHERE NOT (a.doc=b.doc AND a.quote=b.quote AND a.n=1 AND b.n=1))
SELECT pair_id FROM s WHERE EXISTS (SELECT 1 FROM t_evid e WHERE e.id IN (s.a, s.b) AND contains(lower(quote), 'promo shipped'))""")
def filter_signals(spark, sf):
    return C.filter_signals(signals(spark, sf), H.NUMERIC_KIND, " PROMO shipped ").select("pair_id")


@query("bands", f"""
WITH g AS (SELECT property_name, unit, min(lo) AS least, max(hi) AS most FROM t_claim GROUP BY ALL)
SELECT claim_id, {_scaled('(lo-least)/(most-least)*100', 'left')}, {_scaled('greatest((hi-lo)/(most-least)*100, 1.5::DOUBLE)', 'width')}
FROM t_claim JOIN g USING (property_name, unit) WHERE most>least""")
def bands(spark, sf):
    """Every claim on the scale of its property and unit."""
    claims = K.to_claims(T.findings(spark, sf)).select("claim_id", "property_name", "unit", "lo", "hi")
    scales = claims.groupBy("property_name", "unit").agg(F.min("lo").alias("least"), F.max("hi").alias("most"))
    c = F.col
    placed = claims.join(scales, ["property_name", "unit"]).withColumn("band", measures.band(c("lo"), c("hi"), c("least"), c("most")))
    return placed.filter("band IS NOT NULL").select("claim_id", "band.*").select("claim_id", scaled("left"), scaled("width"))


# --- files -------------------------------------------------------------------------------------------------------------

#: Documents of one file, and the size above which the test corpus calls a file too large.
SHELF, LARGE = 20, 60_000


def written_corpus(spark, sf) -> str:
    """The documents as files of the shared folder, ``SHELF`` ids a file: text, every seventh shelf packed, every fifth as comma-separated."""
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = T.table(spark, sf, "documents").select(F.floor(F.col("doc_id") / SHELF).alias("shelf"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.repartition("shelf")
    docs.filter("shelf % 7 = 0").write.partitionBy("shelf").option("compression", "gzip").text(f"{folder}/packed")
    docs.filter("shelf % 7 <> 0 AND shelf % 5 = 0").write.partitionBy("shelf").csv(f"{folder}/rows")
    docs.filter("shelf % 7 <> 0 AND shelf % 5 <> 0").write.partitionBy("shelf").text(f"{folder}/plain")
    return folder


_SHELVES = f"""
WITH d AS (SELECT doc_id // {SHELF} AS shelf, sum(length(coalesce(text,''))+1)::BIGINT AS chars, sum(strlen(coalesce(text,''))+1)::BIGINT AS bytes FROM documents GROUP BY ALL)"""


@query("scan_corpus", f"""{_SHELVES}
SELECT shelf, CASE WHEN shelf%7=0 OR shelf%5=0 THEN 'unsupported' WHEN bytes>{LARGE} THEN 'oversize' ELSE 'pending' END AS status,
 CASE WHEN shelf%7<>0 AND shelf%5<>0 THEN bytes END AS bytes FROM d""")
def scan_corpus(spark, sf):
    """One row per file; sizes of the text files only, since packing decides the others."""
    shelf = F.regexp_extract("path", r"/shelf=(\d+)/", 1).cast("bigint")
    files = corpus.scan_corpus(spark, written_corpus(spark, sf), LARGE)
    return files.select(shelf.alias("shelf"), "status", F.when(F.col("status") != "unsupported", F.col("length")).alias("bytes"))


@query("read_text_documents", f"""{_SHELVES}
SELECT shelf, CASE WHEN bytes>{LARGE} THEN 'oversize' END AS error, CASE WHEN bytes<={LARGE} THEN chars END AS chars FROM d WHERE shelf%7<>0 AND shelf%5<>0""")
def read_text_documents(spark, sf):
    shelf = F.regexp_extract("path", r"/shelf=(\d+)/", 1).cast("bigint")
    return corpus.read_text_documents(spark, written_corpus(spark, sf), LARGE).select(shelf.alias("shelf"), "error", F.length("text").cast("bigint").alias("chars"))
