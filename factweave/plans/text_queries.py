"""Text functions and shape rules over the given texts and derived records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as X
from ..functions.text import STOPWORDS
from ..operators import budget as B
from ..operators import logs as L
from ..operators import ranks
from ..operators import validation as V
from ..schemas import RELATION_ROWS, relations
from ..sources import testdata as T
from .ingest_queries import _MARKED, _RELATIONS
from .oracle import uuid5
from .registry import query
from .search_queries import tokens

_STOP = ",".join(f"'{w}'" for w in STOPWORDS)


def prefixes(x):
    return (
        f"list_distinct(list_transform(list_filter(regexp_extract_all(lower({x}), '[а-яёa-z0-9]+'), lambda w: length(w)>=4 AND w NOT IN ({_STOP})),"
        " lambda w: substr(w,1,5)))"
    )


def nums(x):
    joined = x
    for _ in range(3):
        joined = f"regexp_replace({joined}, '(\\d) (\\d{{3}})(\\D|$)', '\\1\\2\\3', 'g')"
    one = "CASE WHEN v=floor(v) THEN CAST(CAST(v AS HUGEINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END"
    return (
        f"list_distinct(list_transform(list_transform(regexp_extract_all({joined}, '\\d+(?:[.,]\\d+)?'), lambda n: CAST(replace(n, ',', '.') AS DOUBLE)), lambda v: {one}))"
    )


def joined(x):
    return f"array_to_string(list_sort({x}), ' ')"


@query("tokenize", f"SELECT doc_id, len({tokens('text')})::INTEGER AS n, coalesce(array_to_string({tokens('text')}, ' '),'') AS tokens FROM documents")
def tokenize(spark, sf):
    t = X.tokenize(F.col("text"))
    return T.table(spark, sf, "documents").select("doc_id", F.size(t).alias("n"), F.array_join(t, " ").alias("tokens"))


@query("query_tokens", """
WITH w AS (SELECT doc_id, unnest(string_split(trim(regexp_replace(text,'\\s+',' ','g')),' ')) AS w FROM documents),
t AS (SELECT DISTINCT doc_id, trim(lower(w), '.,;:!?()[]{}«»"''') AS t FROM w WHERE length(w)>=4)
SELECT doc_id, string_agg(t, ' ' ORDER BY t) AS tokens FROM t WHERE t<>'' GROUP BY ALL""")
def query_tokens(spark, sf):
    t = F.array_sort(X.query_tokens(F.col("text")))
    return T.table(spark, sf, "documents").filter(F.size(t) > 0).select("doc_id", F.array_join(t, " ").alias("tokens"))


@query("term_prefixes", f"SELECT doc_id, {joined(prefixes('text'))} AS prefixes FROM documents")
def term_prefixes(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(X.term_prefixes(F.col("text"))), " ").alias("prefixes"))


@query("canonical_numbers", f"SELECT doc_id, {joined(nums('text'))} AS numbers FROM documents")
def canonical_numbers(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(X.canonical_numbers(F.col("text"))), " ").alias("numbers"))


@query("split_sentences", f"""
WITH s AS (SELECT document_id, pos, i, trim(string_split({_MARKED}, chr(1))[i]) AS sentence FROM t_frag, unnest(generate_series(1, len(string_split({_MARKED}, chr(1))))) AS t(i))
SELECT document_id, pos::INTEGER AS pos, sentence, count(*) AS n FROM s WHERE sentence<>'' GROUP BY ALL""")
def split_sentences(spark, sf):
    f = T.documents(spark, sf).select("document_id", F.posexplode("fragments").alias("pos", "f"))
    s = f.select("document_id", "pos", F.explode(X.split_sentences(F.col("f.text"))).alias("sentence"))
    return s.groupBy("document_id", "pos", "sentence").agg(F.count("*").alias("n"))


@query("text_scalars", f"""
SELECT doc_id, CASE WHEN length(text)<=120 THEN text WHEN contains(substr(text,1,120),' ') THEN regexp_extract(substr(text,1,120), '(?s)^(.*) ', 1) ELSE '' END AS excerpt,
 CASE WHEN length(text)>0 THEN CAST(floor(length(text)/2.4::DOUBLE) AS INTEGER)+1 ELSE 0 END AS tokens, substr(sha256(source),1,16) AS reference,
 {uuid5(ids.NAMESPACE, 'text')} AS uuid, len(regexp_extract_all(lower(text),'[а-яё]'))>len(regexp_extract_all(lower(text),'[a-z]')) AS not_english FROM documents""")
def text_scalars(spark, sf):
    c = F.col("text")
    return T.table(spark, sf, "documents").select(
        "doc_id", X.excerpt(c, 120).alias("excerpt"), X.estimate_tokens(c).alias("tokens"), ids.reference_id(F.col("source")).alias("reference"),
        ids.fact_uuid(c).alias("uuid"), X.language_mismatch(c, F.lit("en")).alias("not_english"),
    )


@query("restatement", """
WITH a AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(string_split(text,chr(10))[1]), '[\\p{L}\\p{N}]+')) AS s, list_distinct(regexp_extract_all(lower(b.text2), '[\\p{L}\\p{N}]+')) AS q
 FROM (SELECT doc_id, text, coalesce(lag(text) OVER (PARTITION BY lang ORDER BY doc_id), text) AS text2 FROM documents) b)
SELECT doc_id, len(s)>=4 AND len(list_intersect(s,q))>=len(s)*0.9::DOUBLE AS restated FROM a""")
def restatement(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", "lang", "text")
    d = ranks.row_before(d, ["lang"], [F.col("doc_id")], "text", "before").withColumn("q", F.coalesce("before", "text"))
    return d.select("doc_id", X.source_restated(F.substring_index("text", "\n", 1), F.array("q")).alias("restated"))


@query("citations", """
SELECT id, id AS cited, 'https://example.org/other/'||supp AS unknown_link FROM t_find""")
def citations(spark, sf):
    f = T.findings(spark, sf)
    e = F.element_at("evidence", 1)
    text = F.concat(
        "statement", F.lit(" [a](finding:"), "id", F.lit(") and [b]("), e["source_url"], F.lit(") [c](https://example.org/other/"),
        F.substring_index(e["source_url"], "/", -1), F.lit(")"),
    )
    rows = f.select("id", text.alias("text"), F.transform("evidence", lambda x: x["source_url"]).alias("known"))
    return rows.select("id", F.array_join(X.cited_ids(F.col("text")), ",").alias("cited"),
                       F.array_join(F.array_except(X.http_links(F.col("text")), "known"), ",").alias("unknown_link"))


@query("explicit_ids", """
SELECT n_nationkey, array_to_string(list_slice(list_sort(list_distinct(['supplier-'||n_nationkey, 'x-'||n_nationkey, 'y_'||n_nationkey, 'z'||n_nationkey])),1,10), ',') AS ids FROM nation""")
def explicit_ids(spark, sf):
    q = T.table(spark, sf, "nation").selectExpr(
        "n_nationkey", "concat('Compare [s](finding:supplier-', n_nationkey, ') with finding x-', n_nationkey, ', y_', n_nationkey, ' and находки z', n_nationkey, '?') AS text"
    )
    return q.select("n_nationkey", F.array_join(X.explicit_ids(F.col("text")), ",").alias("ids"))


@query("redact", """
SELECT event_id, CASE event_type WHEN 'error' THEN 'провайдер: превышен лимит запросов провайдера (HTTP 429)' WHEN 'click' THEN 'провайдер: провайдер недоступен (HTTP 503)'
 WHEN 'view' THEN 'провайдер: провайдер отклонил обращение (HTTP 418)' ELSE 'провайдер: connect to провайдер: failed user '||user_id END AS message FROM events""")
def redact(spark, sf):
    e = T.table(spark, sf, "events").selectExpr(
        "event_id", "CASE event_type WHEN 'error' THEN concat('429 https://api.example/', event_id, \" b'x'\") WHEN 'click' THEN '503 down' WHEN 'view' THEN '418' "
        "ELSE concat('connect to https://h/p?q=1  failed', \" b'secret' \", ' user ', user_id, ' Headers({x: 1})') END AS m"
    )
    return e.select("event_id", X.redact(F.col("m")).alias("message"))


@query("strip_fence", "SELECT event_id, props AS json FROM events")
def strip_fence(spark, sf):
    e = T.table(spark, sf, "events").selectExpr("event_id", "IF(user_id % 2 = 0, concat('```json\\n', props, '\\n```'), concat('  ', props, ' ')) AS t")
    return e.select("event_id", X.strip_fence(F.regexp_replace("t", "\n", " ")).alias("json"))


# --- shape rules ---


@query("validate_observations", """
SELECT id, idx::INTEGER AS pos, CASE WHEN operator='between' AND supp%4=0 THEN 'low_above_high' WHEN operator<>'between' AND supp%4=1 THEN 'point_without_value'
 WHEN operator='between' AND supp%4=2 THEN 'between_with_value' ELSE '' END AS violations FROM t_obs JOIN t_find USING (id)""")
def validate_observations(spark, sf):
    f = T.findings(spark, sf).withColumn("k", F.regexp_extract("id", r"-(\d+)-\d+$", 1).cast("bigint") % 4)
    between = lambda o: o["operator"] == "between"
    broken = F.transform("observations", lambda o: F.when(
        between(o) & (F.col("k") == 0), o.withField("min_value", o["max_value"] + 1)
    ).when(~between(o) & (F.col("k") == 1), o.withField("value", F.lit(None).cast("double"))).when(
        between(o) & (F.col("k") == 2), o.withField("value", F.lit(1.0))
    ).otherwise(o))
    return V.validate_observations(f.withColumn("observations", broken)).withColumn("violations", F.array_join("violations", ","))


@query("validate_evidence", """
SELECT id, pos::INTEGER AS pos, CASE WHEN pos=0 AND supp%3=0 THEN 'end_without_start' WHEN pos=1 AND supp%3=1 THEN 'no_quote' WHEN pos=0 AND supp%3=2 THEN 'end_not_after_start' ELSE '' END AS violations
FROM t_evid JOIN (SELECT id, supp FROM t_find) USING (id)""")
def validate_evidence(spark, sf):
    f = T.findings(spark, sf).withColumn("k", F.regexp_extract("id", r"-(\d+)-\d+$", 1).cast("bigint") % 3)
    broken = F.transform("evidence", lambda e, i: F.when((i == 0) & (F.col("k") == 0), e.withField("char_end", F.lit(5))).when(
        (i == 1) & (F.col("k") == 1), e.withField("quote", F.lit("  "))
    ).when((i == 0) & (F.col("k") == 2), e.withField("char_start", F.lit(9)).withField("char_end", F.lit(9))).otherwise(e))
    return V.validate_evidence(f.withColumn("evidence", broken)).withColumn("violations", F.array_join("violations", ","))


@query("validate_plans", """
SELECT plan_id, CASE WHEN n_nationkey%4=1 THEN NULL ELSE year_from END::INTEGER AS year_from, greatest(1, least(CASE n_nationkey%6 WHEN 0 THEN 3 ELSE n_nationkey%6 END, 4))::INTEGER AS max_hops,
 concat_ws(',', CASE WHEN n_nationkey%4<>1 AND year_from>1994 THEN 'year_order' END, CASE WHEN n_nationkey%3=1 THEN 'filter_fields' END) AS violations FROM t_plan""")
def validate_plans(spark, sf):
    p = T.plans(spark, sf).withColumns({
        "year_from": F.expr("IF(n_nationkey % 4 = 1, 0, year_from)"), "year_to": F.lit(1994), "max_hops": F.col("n_nationkey") % 6,
        "numeric_filters": F.transform("numeric_filters", lambda f: F.when(f["operator"] == "gte", f.withField("value", F.lit(None).cast("double"))).otherwise(f)),
    })
    return V.validate_plans(p).select("plan_id", "year_from", "max_hops", F.array_join("violations", ",").alias("violations"))


@query("canonical_predicate", """
WITH p AS (SELECT p_partkey, CASE p_partkey%3 WHEN 0 THEN '1 '||p_name WHEN 1 THEN '  '||p_name||' ' ELSE p_brand||'_'||p_type END AS raw FROM part),
t AS (SELECT *, trim(upper(regexp_replace(trim(raw), '[^A-Za-z0-9_]+', '_', 'g')), '_') AS t FROM p)
SELECT p_partkey, CASE WHEN regexp_matches(t, '^[A-Z]') THEN t ELSE raw END AS predicate FROM t""")
def canonical_predicate(spark, sf):
    p = T.table(spark, sf, "part").selectExpr(
        "p_partkey", "CASE p_partkey % 3 WHEN 0 THEN concat('1 ', p_name) WHEN 1 THEN concat('  ', p_name, ' ') ELSE concat(p_brand, '_', p_type) END AS raw"
    )
    return p.select("p_partkey", V.canonical_predicate(F.col("raw")).alias("predicate"))


@query("entity_types", """
SELECT p_partkey, CASE p_size%7 WHEN 0 THEN 'location' WHEN 1 THEN 'organization' WHEN 2 THEN 'equipment' ELSE 'material' END AS type FROM part""")
def entity_types(spark, sf):
    raw = "CASE p_size % 7 WHEN 0 THEN 'Place' WHEN 1 THEN 'company' WHEN 2 THEN 'APPARATUS' ELSE 'material' END"
    return T.table(spark, sf, "part").select("p_partkey", V.normalize_entity_type(F.expr(raw)).alias("type"))


_KNOWN = "k AS (SELECT document_id, unnest([lower(name), lower(canonical_name), lower(alias)]) AS k FROM t_ent)"


_FAULTS = f"""WITH {_KNOWN}, f AS (
SELECT document_id, 'subject' AS path, subject AS value, 'unknown' AS rule FROM t_cin c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.document_id=c.document_id AND k.k=lower(subject))
UNION ALL SELECT document_id, 'object', object, 'unknown' FROM t_cin c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.document_id=c.document_id AND k.k=lower(object))
UNION ALL SELECT document_id, 'predicate', predicate, 'pattern' FROM t_cin WHERE predicate='unknown thing')"""


@query("validate_extraction", _FAULTS + " SELECT document_id, path, value, rule, count(*) AS n FROM f GROUP BY ALL")
def validate_extraction(spark, sf):
    claims, entities, _, _ = T.extraction(spark, sf)
    return V.validate_extraction(claims, entities).groupBy("document_id", "path", "value", "rule").agg(F.count("*").alias("n"))


@query("validation_report", _FAULTS + """, r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY path, value, rule) AS rk, count(*) OVER (PARTITION BY document_id) AS total FROM f)
SELECT document_id, path, value, rk::INTEGER AS rank, total, greatest(total-8,0) AS hidden FROM r WHERE rk<=8""")
def validation_report(spark, sf):
    claims, entities, _, _ = T.extraction(spark, sf)
    return V.report(V.validate_extraction(claims, entities)).drop("rule")


@query("validate_edges", f"""
SELECT e.id, CASE WHEN r.name IS NULL THEN 'unknown_relation' WHEN len(source_types)>0 AND NOT list_contains(source_types, a.type) THEN 'source_type'
 WHEN len(target_types)>0 AND NOT list_contains(target_types, b.type) THEN 'target_type' END AS violation
FROM (SELECT id, source, target, CASE WHEN relation='USED_IN' AND data_class='restricted' THEN 'SHIPS' ELSE relation END AS relation FROM t_edge) e JOIN t_node a ON a.id=e.source JOIN t_node b ON b.id=e.target LEFT JOIN {_RELATIONS.replace(' AS rel(', ' AS r(')} ON r.name=e.relation""")
def validate_edges(spark, sf):
    e = T.edges(spark, sf).withColumn("relation", F.expr("IF(relation = 'USED_IN' AND data_class = 'restricted', 'ships', relation)"))
    return V.validate_edges(e, T.nodes(spark, sf), relations(spark)).select("id", "violation")


_SEM = ",".join(r[0] for r in RELATION_ROWS if r[1] == "semantic")
_PROV = ",".join(r[0] for r in RELATION_ROWS if r[1] == "provenance")


@query("resolve_relations", f"""
SELECT c_custkey, CASE c_custkey%3 WHEN 0 THEN '{_SEM}' WHEN 1 THEN 'USES,{_PROV}' ELSE 'FEEDS' END AS accepted, CASE c_custkey%3 WHEN 2 THEN upper(c_mktsegment) ELSE '' END AS rejected FROM customer""")
def resolve_relations(spark, sf):
    r = T.table(spark, sf, "customer").selectExpr(
        "c_custkey", "CASE c_custkey % 3 WHEN 0 THEN CAST(array() AS ARRAY<STRING>) WHEN 1 THEN array('uses', 'Provenance', 'USES') ELSE array(' feeds', c_mktsegment, '') END AS relation_types"
    )
    return V.resolve_relations(r).select("c_custkey", F.array_join("accepted", ",").alias("accepted"), F.array_join("rejected", ",").alias("rejected"))


# --- budgets ---


@query("fit_evidence", """
WITH RECURSIVE c AS (SELECT conv_id, turn, length(text)//3+1 AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
f AS (SELECT conv_id, 0::BIGINT AS i, '' AS taken, 0::BIGINT AS spent FROM (SELECT DISTINCT conv_id FROM c)
 UNION ALL SELECT f.conv_id, c.i, CASE WHEN cost<=300-spent THEN taken||CASE WHEN taken='' THEN '' ELSE ',' END||turn ELSE taken END, CASE WHEN cost<=300-spent THEN spent+cost ELSE spent END
 FROM f JOIN c ON c.conv_id=f.conv_id AND c.i=f.i+1)
SELECT conv_id, max_by(taken, i) AS taken, max_by(spent, i) AS spent FROM f GROUP BY ALL""")
def fit_evidence(spark, sf):
    c = T.table(spark, sf, "conversations").selectExpr("conv_id", "turn", "CAST(turn AS STRING) AS id", "CAST(length(text) DIV 3 + 1 AS BIGINT) AS cost")
    rows = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "id", "cost"))), lambda x: F.struct(x["id"].alias("id"), x["cost"].alias("cost"))).alias("items"))
    return B.fit_evidence(rows, F.lit(300)).select("conv_id", F.array_join("taken", ",").alias("taken"), "spent")


@query("active_policy", """
WITH RECURSIVE c AS (SELECT conv_id, turn, length(trim(text)) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
f AS (SELECT conv_id, 0::BIGINT AS i, '' AS applied, 0::BIGINT AS used FROM (SELECT DISTINCT conv_id FROM c)
 UNION ALL SELECT f.conv_id, c.i, CASE WHEN applied='' THEN turn::VARCHAR WHEN used+n+2<=900 THEN applied||','||turn ELSE applied END, CASE WHEN applied='' THEN n WHEN used+n+2<=900 THEN used+n+2 ELSE used END
 FROM f JOIN c ON c.conv_id=f.conv_id AND c.i=f.i+1)
SELECT conv_id, max_by(applied, i) AS applied, max_by(used, i)::INTEGER AS chars FROM f GROUP BY ALL""")
def active_policy(spark, sf):
    c = T.table(spark, sf, "conversations").selectExpr("conv_id", "turn", "CAST(turn AS STRING) AS id", "text AS change")
    rows = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "id", "change"))), lambda x: F.struct(x["id"].alias("id"), x["change"].alias("change"))).alias("changes"))
    return B.active_policy(rows, 900).select("conv_id", F.array_join("applied", ",").alias("applied"), F.length("text").alias("chars"))


@query("fit_sections", """
WITH RECURSIVE c AS (SELECT conv_id, turn, 's'||turn AS label, length('s'||turn)+1+length(trim(text)) AS n FROM conversations WHERE trim(text)<>''),
t AS (SELECT conv_id, sum(n+2)-2 AS size, count(*) AS k, max(turn) AS last FROM c GROUP BY ALL),
f AS (SELECT conv_id, last AS i, size, k, '' AS dropped FROM t
 UNION ALL SELECT f.conv_id, f.i-1, CASE WHEN d THEN size-2-n ELSE size END, CASE WHEN d THEN k-1 ELSE k END, CASE WHEN d THEN dropped||CASE WHEN dropped='' THEN '' ELSE ',' END||label ELSE dropped END
 FROM (SELECT f.*, c.n, c.label, coalesce(CASE WHEN size>0 THEN floor(size/2.4::DOUBLE)+1 ELSE 0 END > 400 AND f.i<>1 AND k>1 AND c.n IS NOT NULL, false) AS d FROM f LEFT JOIN c ON c.conv_id=f.conv_id AND c.turn=f.i WHERE f.i>=0) f)
SELECT conv_id, arg_min(dropped, i) AS dropped, CASE WHEN arg_min(size, i)>0 THEN floor(arg_min(size, i)/2.4::DOUBLE)+1 ELSE 0 END > 400 AS truncated FROM f GROUP BY ALL""")
def fit_sections(spark, sf):
    c = T.table(spark, sf, "conversations").selectExpr("conv_id", "turn", "concat('s', turn) AS label", "text AS body")
    rows = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "label", "body"))), lambda x: F.struct(x["label"].alias("label"), x["body"].alias("body"))).alias("sections"))
    return B.fit_sections(rows, 400, ("s1",)).select("conv_id", F.array_join("dropped", ",").alias("dropped"), "truncated")


@query("valid_email", """
SELECT c_custkey, c_custkey%4<2 AS valid FROM customer""")
def valid_email(spark, sf):
    e = T.table(spark, sf, "customer").selectExpr(
        "c_custkey", "CASE c_custkey % 4 WHEN 0 THEN concat(' ', c_name, '@Mail.Example ') WHEN 1 THEN concat('a', c_custkey, '@b.cd') WHEN 2 THEN concat(c_name, '@x.y') ELSE concat(c_name, ' @x.org') END AS e"
    )
    return e.select("c_custkey", L.valid_email(F.col("e")).alias("valid"))
