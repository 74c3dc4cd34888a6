"""Search and ranking over documents, benchmark passages as questions, and vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import search as S
from ..operators import text_index as TI
from ..operators import vector_index as V
from ..operators.lineage import shared_folder
from ..sources import testdata as T
from .catalog_queries import candidates
from .number_queries import _scaled, scaled
from .oracle import WORD, cte, pick
from .registry import query
from ..functions.text import STEM_SUFFIXES

_STEM = "^(.{3,}?)(?:" + "|".join(STEM_SUFFIXES) + ")$"


def tokens(x):
    return f"list_transform(list_filter(regexp_extract_all(lower({x}), '{WORD}'), lambda w: length(w)>=3), lambda w: regexp_replace(w, '{_STEM}', '\\1'))"


cte("t_pass", f"""
SELECT 'd-'||doc_id AS id, doc_id, text AS quote, string_split(text, chr(10))[1] AS statement, source||' '||lang AS source_title,
 string_split(array_to_string(list_slice(string_split(text,' '),1,2),' '), chr(10))[1] AS subject, (doc_id%10)/10.0::DOUBLE AS confidence,
 {pick('doc_id', 'public', 'internal', 'restricted')} AS data_class, source AS community, doc_id%4 AS n_obs, doc_id%3 AS n_units FROM documents""")
cte("t_q", "SELECT 'q-'||item_id AS query_id, text FROM benchmark")
cte("t_qt", f"SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens('text')}) AS term FROM t_q) GROUP BY ALL")


def _bm(name, field):
    cte(f"t_p{name}", f"SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({tokens(field)}) AS term FROM t_pass) GROUP BY ALL")
    cte(f"t_b{name}", f"""
SELECT query_id, id, sum(qtf*ln((n-df+0.5)/(df+0.5)+1)*tf*2.5/(tf+1.5*(0.25+0.75*dl/greatest(avgdl,1)))) AS score
FROM t_qt JOIN t_p{name} p USING (term) JOIN (SELECT term, count(*) AS df FROM t_p{name} GROUP BY ALL) USING (term)
 JOIN (SELECT id, sum(tf) AS dl FROM t_p{name} GROUP BY ALL) USING (id), (SELECT count(*) AS n FROM t_pass), (SELECT sum(tf)/(SELECT count(*) FROM t_pass) AS avgdl FROM t_p{name})
GROUP BY ALL""")


_bm("q", "quote")
_bm("s", "statement")


@query("bm25", f"SELECT query_id, id, {_scaled('score', 'score')} FROM t_bq")
def bm25(spark, sf):
    return S.bm25(T.search_queries(spark, sf), T.passages(spark, sf), "quote").withColumn("score", scaled("score"))


def _top(src, k, order="round(score,9) DESC, id"):
    return f"SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY {order})::INTEGER AS rank FROM {src} QUALIFY rank<={k}"


@query("lexical_leg", f"""
WITH b AS (SELECT query_id, id, max(score) AS score FROM (SELECT query_id, id, score*3 AS score FROM t_bs UNION ALL SELECT * FROM t_bq) GROUP BY ALL)
{_top('b', 18)}""")
def lexical_leg(spark, sf):
    return S.lexical_leg(T.search_queries(spark, sf), T.passages(spark, sf), 18).drop("score")


def _index(spark, docs, field):
    return TI.build(docs, f"{shared_folder(spark).rstrip('/')}/text-{uuid.uuid4().hex}", field)


@query("text_index_top", _top("t_bq", 10))
def text_index_top(spark, sf):
    return TI.search(_index(spark, T.passages(spark, sf), "quote"), T.search_queries(spark, sf), 10).drop("score")


@query("text_index_leg", f"""
WITH b AS (SELECT query_id, id, max(score) AS score FROM (SELECT query_id, id, score*3 AS score FROM t_bs UNION ALL SELECT * FROM t_bq) GROUP BY ALL)
{_top('b', 18)}""")
def text_index_leg(spark, sf):
    """The lexical leg from two stored indexes."""
    docs = T.passages(spark, sf)
    return TI.leg([(_index(spark, docs, "statement"), 3.0), (_index(spark, docs, "quote"), 1.0)], T.search_queries(spark, sf), 18).drop("score")


cte("t_ptitle", f"SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({tokens('source_title')}) AS term FROM t_pass) GROUP BY ALL")


@query("chunk_leg", f"""
WITH t AS (SELECT query_id, id, sum(qtf*ln((n-df+0.5)/(df+0.5)+1)*tf*2.5/(tf+1.5*(0.25+0.75*dl/greatest(avgdl,1)))) AS score
FROM t_qt JOIN t_ptitle p USING (term) JOIN (SELECT term, count(*) AS df FROM t_ptitle GROUP BY ALL) USING (term)
 JOIN (SELECT id, sum(tf) AS dl FROM t_ptitle GROUP BY ALL) USING (id), (SELECT count(*) AS n FROM t_pass), (SELECT sum(tf)/(SELECT count(*) FROM t_pass) AS avgdl FROM t_ptitle) GROUP BY ALL),
b AS (SELECT query_id, id, max(score) AS score FROM (SELECT query_id, id, score*3 AS score FROM t_bq UNION ALL SELECT query_id, id, score*2 FROM t) GROUP BY ALL)
{_top('b', 18)}""")
def chunk_leg(spark, sf):
    p = T.passages(spark, sf).withColumnsRenamed({"quote": "text", "source_title": "title"})
    return S.chunk_leg(T.search_queries(spark, sf), p, 18).drop("score")


def label_vectors(spark, sf):
    """One question vector per label: the mean of its vectors, rounded so that both engines start from the same numbers."""
    v = T.vectors(spark, sf).select("label", F.posexplode("embedding").alias("i", "x"))
    mean = v.groupBy("label", "i").agg((F.round(F.sum(F.round(F.col("x") * 1e6).cast("bigint")) / F.count("*")) / 1e6).alias("m"))
    return mean.groupBy(F.concat(F.lit("label-"), "label").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding")
    )


cte("t_lv", """
SELECT 'label-'||label AS query_id, list(m ORDER BY i) AS e FROM (SELECT label, i, round(sum(CAST(round(x::DOUBLE*1e6) AS BIGINT))/count(*))/1e6 AS m
 FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY ALL""")
cte("t_vs", """
SELECT query_id, 'v-'||vec_id AS id, list_cosine_similarity(e, embedding::DOUBLE[]) AS score, vec_id%3 AS cls FROM t_lv, embeddings""")


@query("vector_leg", f"SELECT query_id, id, rank, {_scaled('score', 'score')} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM t_vs WHERE cls<2) WHERE rank<=18")
def vector_leg(spark, sf):
    return S.vector_leg(label_vectors(spark, sf), T.vectors(spark, sf), 18, {"public", "internal"}, 64).withColumn("score", scaled("score"))


def vector_index(spark, sf):
    """An index of the vectors in the shared folder, questions from every tenth vector, and the cells to probe for nine in ten."""
    index = V.build(T.vectors(spark, sf), f"{shared_folder(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}", 64)
    asked = T.table(spark, sf, "embeddings").filter("vec_id % 10 = 0").select(F.concat(F.lit("q-"), "vec_id").alias("query_id"), "embedding")
    return index, asked, V.probes_for(index, asked, 18, 0.95, {"public", "internal"})


@query("vector_index")
def vector_index_search(spark, sf):
    """No SQL: approximate. ``vector_index_recall`` states what must hold of it."""
    index, asked, probes = vector_index(spark, sf)
    return V.search(index, asked, 18, probes, {"public", "internal"}).withColumn("score", scaled("score"))


@query("vector_index_recall", """
WITH q AS (SELECT vec_id FROM embeddings WHERE vec_id % 10 = 0), n AS (SELECT count(*) AS n FROM embeddings WHERE vec_id % 3 < 2)
SELECT (SELECT count(*) FROM q) AS questions, (SELECT count(*) FROM q)*least(18, n.n) AS places, TRUE AS recalled, TRUE AS truthful FROM n""")
def vector_index_recall(spark, sf):
    """Questions, places of the exact answer, whether nine in ten are found, and whether all found scores are those of exact search."""
    index, asked, probes = vector_index(spark, sf)
    exact = S.vector_leg(asked, index.rows, 18, {"public", "internal"}, 64).select("query_id", "id", "score")
    found = V.search(index, asked, 18, probes, {"public", "internal"}).select("query_id", "id", F.col("score").alias("found"))
    both = exact.join(found, ["query_id", "id"], "left")
    return both.agg(
        F.count_distinct("query_id").alias("questions"), F.count("*").alias("places"), (F.count("found") >= 0.9 * F.count("*")).alias("recalled"),
        F.coalesce(F.bool_and(F.abs(F.col("found") - F.col("score")) < 1e-9), F.lit(True)).alias("truthful"),
    )


_PUNCT = ".,;:!?()[]{}«»\"''"
cte("t_tok", f"""
SELECT DISTINCT query_id, trim(lower(w), '{_PUNCT}') AS token FROM (SELECT query_id, unnest(regexp_split_to_array(trim(regexp_replace(text,'\\s+',' ','g')), ' ')) AS w FROM t_q)
WHERE length(w)>=4 AND trim(lower(w), '{_PUNCT}')<>''""")
cte("t_score", """
SELECT q.query_id, p.id, s, e, t, b, (10*s+3*e+5*t+5*b)/10.0::DOUBLE AS score, confidence FROM (
 SELECT k.query_id, p.id, count(*) FILTER (contains(lower(statement), token)) AS s, count(*) FILTER (contains(lower(quote), token)) AS e,
  count(*) FILTER (contains(lower(source_title), token)) AS t FROM t_tok k, t_pass p GROUP BY ALL) h JOIN t_pass p ON h.id=p.id JOIN t_q q ON q.query_id=h.query_id,
 LATERAL (SELECT CASE WHEN trim(subject)<>'' AND contains(lower(q.text), lower(subject)) THEN 1 ELSE 0 END AS b)
WHERE 10*s+3*e+5*t+5*b>0""")


@query("score_findings", "SELECT query_id, id, score, s::BIGINT AS statement_hits, e::BIGINT AS quote_hits, t::BIGINT AS title_hits, b::BIGINT AS subject_hit FROM t_score")
def score_findings(spark, sf):
    return S.score_findings(T.search_queries(spark, sf), T.passages(spark, sf)).drop("confidence")


@query("score_findings_lexical", "SELECT query_id, id, s::DOUBLE AS score FROM t_score WHERE s>0")
def score_findings_lexical(spark, sf):
    return S.score_findings(T.search_queries(spark, sf), T.passages(spark, sf), "lexical").select("query_id", "id", "score")


@query("select_relevant", """
WITH a AS (SELECT q.query_id, p.id, coalesce(s,0) AS s, coalesce(e,0) AS e, p.confidence FROM t_q q CROSS JOIN t_pass p LEFT JOIN t_score x ON x.query_id=q.query_id AND x.id=p.id)
SELECT query_id, id, s::BIGINT AS statement_hits, e::BIGINT AS quote_hits, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, e DESC, confidence DESC, id)::INTEGER AS rank FROM a QUALIFY rank<=10""")
def select_relevant(spark, sf):
    return S.select_relevant(T.search_queries(spark, sf), T.passages(spark, sf), 10).drop("confidence")


_LEGS = f"""
l1 AS ({_top('t_score', 18, 'score DESC, s DESC, confidence DESC, id')}), l2 AS ({_top('t_bq', 18)}),
fu AS (SELECT query_id, id, sum(w) AS fusion FROM (SELECT query_id, id, 1.0/(5+rank) AS w FROM l1 UNION ALL SELECT query_id, id, 0.3/(5+rank) FROM l2) GROUP BY ALL)"""


@query("rrf", f"WITH {_LEGS} SELECT query_id, id, {_scaled('fusion', 'fusion')} FROM fu")
def rrf(spark, sf):
    q, p = T.search_queries(spark, sf), T.passages(spark, sf)
    legs = {
        "lexical": S.ranked(S.score_findings(q, p), 18, S.score_order()), "chunk": S.best_terms(q, p, 18, "quote"),
    }
    return S.rrf(legs).withColumn("fusion", scaled("fusion"))


_SIGNALS = _LEGS + """,
fk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fusion,12) DESC, id) AS fr FROM fu) WHERE fr<=18),
cs AS (SELECT c.query_id, c.id, c.fusion, p.community, n_obs, n_units, trim(lower(subject)) AS b, q.text, p.statement, p.quote, p.source_title FROM fk c JOIN t_pass p ON p.id=c.id JOIN t_q q ON q.query_id=c.query_id),
hs AS (SELECT c.query_id, c.id, count(*) FILTER (contains(lower(statement), token) OR contains(lower(quote), token)) AS h, count(*) FILTER (contains(lower(source_title), token)) AS t,
 count(*) FILTER (contains(b, token)) AS bh FROM cs c LEFT JOIN t_tok k ON k.query_id=c.query_id GROUP BY ALL),
sg AS (SELECT c.query_id, c.id, community, fusion/max(fusion) OVER (PARTITION BY c.query_id) AS s_fusion, least(h,5)/5.0::DOUBLE AS s_lexical,
 CASE WHEN b='' THEN 0 WHEN contains(lower(text), b) THEN 1 ELSE least(bh,2)/2.0::DOUBLE END AS s_subject, least(t,2)/2.0::DOUBLE AS s_source,
 CASE WHEN n_obs=0 THEN 0 ELSE least(1, ln(1+n_obs)/ln(4)+CASE WHEN n_units>1 THEN 0.1 ELSE 0 END) END AS s_numeric FROM cs c JOIN hs ON hs.query_id=c.query_id AND hs.id=c.id),
bs AS (SELECT *, CAST(round((0.42*s_fusion+0.28*s_lexical+0.09*s_subject+0.09*s_source+0.05*s_numeric)*1000000000) AS BIGINT) AS base FROM sg)"""


def _candidates(spark, sf):
    q, p = T.search_queries(spark, sf), T.passages(spark, sf)
    legs = {
        "lexical": S.ranked(S.score_findings(q, p), 18, S.score_order()), "chunk": S.best_terms(q, p, 18, "quote"),
    }
    fused = S.ranked(S.rrf(legs).withColumn("score", F.round("fusion", 12)), 18).drop("score", "rank")
    return fused.join(p, "id").join(q, "query_id")


@query("rerank_signals", f"WITH {_SIGNALS} SELECT query_id, id, {_scaled('s_fusion', 's_fusion')}, {_scaled('s_lexical', 's_lexical')}, {_scaled('s_subject', 's_subject')}, {_scaled('s_source', 's_source')}, {_scaled('s_numeric', 's_numeric')} FROM bs")
def rerank_signals(spark, sf):
    out = S.rerank_signals(_candidates(spark, sf))
    return out.select("query_id", "id", *[scaled(f"s_{n}") for n in ("fusion", "lexical", "subject", "source", "numeric")])


# The greedy choice itself, one pick per recursion step.
_GREEDY = """
WITH RECURSIVE {signals},
arr AS (SELECT query_id, list({{'id': id, 'c': community, 'b': base}} ORDER BY id) AS items FROM bs GROUP BY ALL),
pick AS (SELECT query_id, items, []::VARCHAR[] AS chosen, []::VARCHAR[] AS taken, 0 AS step FROM arr
 UNION ALL SELECT query_id, items, list_append(chosen, best.id), list_append(taken, best.c), step+1 FROM (
  SELECT *, list_sort(list_transform(list_filter(items, lambda x: NOT list_contains(chosen, x.id)),
   lambda x: {{'k': -(x.b + CASE WHEN list_contains(taken, x.c) THEN 70000000 ELSE 0 END), 'id': x.id, 'c': x.c}}))[1] AS best FROM pick WHERE step<{k} AND step<len(items)))
SELECT query_id, chosen[i] AS id, i::INTEGER AS rank FROM (SELECT query_id, max_by(chosen, step) AS chosen FROM pick GROUP BY ALL), unnest(generate_series(1, len(chosen))) AS t(i)"""


@query("rerank", _GREEDY.format(signals=_SIGNALS.strip(), k=12))
def rerank(spark, sf):
    return S.rerank(S.rerank_signals(_candidates(spark, sf)), 12).select("query_id", "id", "rank")


@query("rerank_degraded", f"WITH {_SIGNALS} SELECT query_id, max(base)<=0 AS degraded FROM bs GROUP BY ALL")
def rerank_degraded(spark, sf):
    return S.rerank_degraded(S.rerank(S.rerank_signals(_candidates(spark, sf))))


@query("candidate_window", """
SELECT plan_id, CASE WHEN n_nationkey%3<2 OR len(countries)>0 OR year_from IS NOT NULL OR year_to IS NOT NULL THEN 36 ELSE 18 END::INTEGER AS "window" FROM t_plan""")
def candidate_window(spark, sf):
    return S.candidate_window(T.plans(spark, sf)).select("plan_id", "window")


@query("finalize", """
WITH k AS (SELECT * FROM t_cand WHERE numeric_ok AND NOT out_year AND NOT out_geo)
SELECT plan_id, id, row_number() OVER (PARTITION BY plan_id ORDER BY (s_origin IS NOT NULL), pos)::INTEGER AS rank FROM k QUALIFY rank<=6""")
def finalize(spark, sf):
    return S.finalize(candidates(spark, sf, S.limit_marks), "plan_id")[0].select("plan_id", "id", "rank")


@query("cut_report", """
WITH k AS (SELECT *, numeric_ok AND NOT out_year AND NOT out_geo AS ok FROM t_cand)
SELECT plan_id, count(*) AS pool, count(*) FILTER (NOT numeric_ok) AS numeric_removed, count(*) FILTER (numeric_ok AND (out_year OR out_geo)) AS scope_removed,
 count(*) FILTER (ok AND wants_year AND s_year IS NULL) AS unknown_year, count(*) FILTER (ok) AS matching, least(count(*) FILTER (ok), 6) AS returned,
 count(*) FILTER (ok AND s_origin IS NOT NULL) AS demo, count(*) FILTER (ok)=0 AS no_evidence FROM k GROUP BY ALL""")
def cut_report(spark, sf):
    return S.finalize(candidates(spark, sf, S.limit_marks), "plan_id")[1].drop("unknown_geography")


_KEYWORDS = ("tion", "ering", "elle", "ment")


HYBRID = f"""
t AS (SELECT query_id, unnest({tokens('text')}) AS term FROM t_q), l AS (SELECT * FROM t WHERE length(term)>=4),
tt AS (SELECT query_id, lower(source_title) AS title, count(*)*0.2 AS score FROM l JOIN (SELECT DISTINCT source_title FROM t_pass) p ON contains(lower(source_title), substr(term,1,4)) GROUP BY ALL),
x AS (SELECT DISTINCT * FROM l WHERE {' OR '.join(f"contains(term,'{k}') OR contains('{k}',term)" for k in _KEYWORDS)}),
en AS (SELECT query_id, p.id, count(*)*0.5*max(confidence) AS score FROM x JOIN t_ps s ON s.term=x.term JOIN t_pass p ON p.id=s.id GROUP BY ALL),
a AS (SELECT * FROM t_bs UNION ALL SELECT query_id, id, 0.3*score FROM t_bq UNION ALL SELECT query_id, id, score FROM tt JOIN t_pass ON lower(source_title)=title UNION ALL SELECT * FROM en),
s AS (SELECT query_id, id, sum(score) AS score FROM a GROUP BY ALL)
{_top('s', 10)}"""


@query("hybrid_retrieval", f"WITH {HYBRID.strip()}")
def hybrid_retrieval(spark, sf):
    return S.hybrid_retrieval(T.search_queries(spark, sf), T.passages(spark, sf), 10, _KEYWORDS).drop("score")


@query("retrieve", _GREEDY.format(signals=_SIGNALS.strip(), k=6))
def retrieve(spark, sf):
    """All classes visible: lexical and chunk legs, fusion, re-ranking."""
    return S.retrieve(T.search_queries(spark, sf), T.passages(spark, sf), None, None, "hybrid").select("query_id", "id", "rank")
