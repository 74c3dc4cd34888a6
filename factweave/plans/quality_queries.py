"""Ranking metrics, grounding, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import quality as Q
from ..operators import search as S
from ..sources import testdata as T
from .number_queries import _scaled, scaled
from .oracle import cte
from .registry import query
from .search_queries import HYBRID, hybrid_retrieval
from .text_queries import nums, prefixes

# --- ranking: the ten best documents of every benchmark passage against two expected sources each ---

cte("t_run", """
SELECT query_id AS case_id, source_title, rank FROM (SELECT query_id, b.id, source_title, row_number() OVER (PARTITION BY query_id ORDER BY round(score,9) DESC, b.id) AS rank
 FROM t_bq b JOIN t_pass p ON p.id=b.id) WHERE rank<=10""")
cte("t_lrun", """
SELECT query_id AS case_id, source_title, rank FROM (SELECT query_id, b.id, source_title, row_number() OVER (PARTITION BY query_id ORDER BY round(score,9) DESC, b.id) AS rank
 FROM t_bs b JOIN t_pass p ON p.id=b.id) WHERE rank<=10""")
cte("t_qrel", """
SELECT 'q-'||item_id AS case_id, 'src'||(item_id%20)||' en' AS source_title FROM benchmark UNION SELECT 'q-'||item_id, 'src'||(item_id*7%20)||' en' FROM benchmark
UNION SELECT 'q-'||item_id, 'src'||(item_id*3%20)||' en' FROM benchmark""")


def runs(spark, sf, field="quote"):
    p = T.passages(spark, sf)
    best = S.ranked(S.bm25(T.search_queries(spark, sf), p, field).withColumn("score", F.round("score", 9)), 10)
    return best.join(p.select("id", "source_title"), "id").select(F.col("query_id").alias("case_id"), "source_title", "rank")


def qrels(spark, sf):
    return T.table(spark, sf, "benchmark").selectExpr(
        "concat('q-', item_id) AS case_id", "explode(array_distinct(array(concat('src', item_id % 20, ' en'), concat('src', item_id * 7 % 20, ' en'), concat('src', item_id * 3 % 20, ' en')))) AS source_title"
    )


_E1 = """
e AS (SELECT case_id, count(*) AS total FROM t_qrel GROUP BY ALL), h AS (SELECT r.* FROM t_run r SEMI JOIN t_qrel q ON q.case_id=r.case_id AND q.source_title=r.source_title),
m AS (SELECT case_id, min(rank) AS first, sum(CASE WHEN rank<=3 THEN 1/log2(rank+1) END) AS dcg, count(DISTINCT CASE WHEN rank<=3 THEN source_title END) AS f3, count(DISTINCT CASE WHEN rank<=5 THEN source_title END) AS f5,
 count(DISTINCT source_title) AS f10, count(*) FILTER (rank<=3) AS n3, count(*) FILTER (rank<=5) AS n5 FROM h GROUP BY ALL),
x AS (SELECT e.case_id, coalesce(f3,0)/total AS recall_at_3, coalesce(f5,0)/total AS recall_at_5, coalesce(f10,0)/total AS recall_at_10, (coalesce(f3,0)>0)::INT AS hit_at_3, (coalesce(f5,0)>0)::INT AS hit_at_5, (coalesce(f10,0)>0)::INT AS hit_at_10,
 coalesce(n3,0)/3.0 AS precision_at_3, coalesce(n5,0)/5.0 AS precision_at_5, coalesce(1/first,0) AS mrr, coalesce(dcg,0)/CASE WHEN total>=3 THEN 1+1/log2(3)+0.5 WHEN total=2 THEN 1+1/log2(3) ELSE 1 END AS ndcg_at_3 FROM e LEFT JOIN m ON m.case_id=e.case_id)"""
_METRICS = ["recall_at_3", "recall_at_5", "recall_at_10", "hit_at_3", "hit_at_5", "hit_at_10", "precision_at_3", "precision_at_5", "mrr", "ndcg_at_3"]


@query("ranking_metrics", f"WITH {_E1} SELECT case_id, {', '.join(_scaled(m, m) for m in _METRICS)} FROM x")
def ranking_metrics(spark, sf):
    return Q.ranking_metrics(runs(spark, sf), qrels(spark, sf)).select("case_id", *[scaled(m) for m in _METRICS])


@query("mean_with_n", f"""
WITH {_E1} SELECT metric, {_scaled('round(avg(value::DOUBLE),3)', 'mean')}, count(*) AS n FROM (SELECT unnest(['mrr','recall_at_10','ndcg_at_3']) AS metric, unnest([mrr, recall_at_10, ndcg_at_3]) AS value FROM x) GROUP BY ALL""")
def mean_with_n(spark, sf):
    m = Q.ranking_metrics(runs(spark, sf), qrels(spark, sf))
    return Q.mean_with_n(m, ["mrr", "recall_at_10", "ndcg_at_3"]).withColumn("mean", scaled("mean"))


def _e2(src):
    return f"""
e AS (SELECT case_id, count(*) AS total FROM t_qrel GROUP BY ALL), d AS (SELECT case_id, source_title, row_number() OVER (PARTITION BY case_id ORDER BY min(rank), source_title) AS rank FROM {src} GROUP BY case_id, source_title),
h AS (SELECT d.* FROM d SEMI JOIN t_qrel q ON q.case_id=d.case_id AND q.source_title=d.source_title WHERE rank<=3), m AS (SELECT case_id, count(*) AS n, min(rank) AS first, sum(1/log2(rank+1)) AS dcg FROM h GROUP BY ALL),
x AS (SELECT e.case_id, coalesce(n,0)/total AS recall_at_3, coalesce(n,0)/3.0 AS precision_at_3, coalesce(1/first,0) AS mrr, coalesce(dcg,0)/CASE WHEN total>=3 THEN 1+1/log2(3)+0.5 WHEN total=2 THEN 1+1/log2(3) ELSE 1 END AS ndcg_at_3 FROM e LEFT JOIN m ON m.case_id=e.case_id)"""


_M2 = ["recall_at_3", "precision_at_3", "mrr", "ndcg_at_3"]


def _titled(df):
    return df.withColumn("evidence_pos", F.lit(0))


@query("ranking_metrics_titles", f"WITH {_e2('t_run')} SELECT case_id, {', '.join(_scaled(m, m) for m in _M2)} FROM x")
def ranking_metrics_titles(spark, sf):
    return Q.ranking_metrics_titles(_titled(runs(spark, sf)), qrels(spark, sf)).select("case_id", *[scaled(m) for m in _M2])


@query("retrieval_benchmark", f"""
WITH {_e2('t_run')}, a AS (SELECT case_id FROM t_qrel WHERE source_title NOT IN (SELECT source_title FROM t_pass))
SELECT (SELECT count(*) FROM e) AS gold_cases, (SELECT count(*) FROM e WHERE case_id NOT IN (SELECT case_id FROM a)) AS scored_cases, (SELECT count(DISTINCT source_title) FROM t_pass) AS corpus_documents,
 {_scaled('(SELECT round(avg(recall_at_3::DOUBLE),3) FROM x)', 'hybrid_recall_at_3')}, {_scaled('(SELECT round(avg(mrr::DOUBLE),3) FROM x)', 'hybrid_mrr')}, false AS passed""")
def retrieval_benchmark(spark, sf):
    p = T.passages(spark, sf)
    out = Q.retrieval_benchmark(
        _titled(runs(spark, sf)), _titled(runs(spark, sf, "statement")), qrels(spark, sf), T.search_queries(spark, sf), p.select("source_title")
    )
    return out.select("gold_cases", "scored_cases", "corpus_documents", scaled("hybrid_recall_at_3"), scaled("hybrid_mrr"), "passed")


# --- grounding of findings ---

_VALUES = "list_transform(list_filter([value, min_value, max_value], lambda v: v IS NOT NULL), lambda v: CASE WHEN v=floor(v) THEN CAST(CAST(v AS HUGEINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END)"
cte("t_sup", f"""
SELECT id, list_distinct(flatten(list(l))) AS supported FROM (SELECT id, {nums('quote')} AS l FROM t_evid UNION ALL SELECT id, {nums('raw_text')} FROM t_obs UNION ALL SELECT id, {_VALUES} FROM t_obs) GROUP BY ALL""")
cte("t_gr", f"""
SELECT f.id, n_name, yr, supp, n, confidence, list_sort(list_filter({nums('statement')}, lambda v: NOT list_contains(supported, v))) AS missing FROM t_find f JOIN t_sup s ON s.id=f.id""")


@query("numbers_grounded", "SELECT id, array_to_string(missing, ',') AS missing_numbers, len(missing)=0 AS grounded FROM t_gr")
def numbers_grounded(spark, sf):
    return Q.numbers_grounded(T.findings(spark, sf)).select("id", F.array_join("missing_numbers", ",").alias("missing_numbers"), "grounded")


cte("t_cm", f"""
SELECT id, len(list_filter({nums('statement')}, lambda v: NOT list_contains({nums('q')}, v)))=0
 AND len(list_intersect({prefixes('statement')}, {prefixes('q')}))>=0.5*len({prefixes('statement')}) AS matched FROM (SELECT f.id, f.statement, string_agg(e.quote, ' ' ORDER BY e.pos) AS q FROM t_find f JOIN t_evid e ON e.id=f.id GROUP BY ALL)""")


@query("content_match", "SELECT id, matched AS content_match FROM t_cm")
def content_match(spark, sf):
    return Q.content_match(T.findings(spark, sf)).select("id", "content_match")


_AM = """a AS (SELECT n_name||' '||yr AS query_id, count(*) AS findings, 1.0 AS citation_coverage, 1.0 AS numeric_support, count(*) FILTER (len(missing)>0)/count(*) AS unsupported_ratio,
 count(*) FILTER (matched)/count(*) AS content_match, sum(round(confidence*1000000)::BIGINT)/(count(*)*1000000) AS mean_confidence FROM t_gr g JOIN t_cm c ON c.id=g.id GROUP BY ALL)"""


def answer_rows(spark, sf):
    """Findings of a nation and year as the findings of one answer."""
    year = F.regexp_extract("id", r"-(\d+)$", 1)
    return T.findings(spark, sf).withColumn("query_id", F.concat_ws(" ", "object", year))


_AMC = ["citation_coverage", "numeric_support", "unsupported_ratio", "content_match", "mean_confidence"]


@query("answer_metrics", f"WITH {_AM} SELECT query_id, findings, {', '.join(_scaled(m, m) for m in _AMC)} FROM a")
def answer_metrics(spark, sf):
    return Q.answer_metrics(answer_rows(spark, sf)).select("query_id", "findings", *[scaled(m) for m in _AMC])


@query("assess", f"""
WITH {_AM}, o AS (SELECT *, round((1+1+(1-unsupported_ratio)+round(content_match,3))/4, 3) AS overall FROM a)
SELECT query_id, {_scaled('overall', 'overall')}, 4 AS components, unsupported_ratio<=0.001 AND round(content_match,3)>=0.999 AND overall>=0.8 AS passed FROM o""")
def assess(spark, sf):
    null = F.lit(None).cast("double")
    m = Q.answer_metrics(answer_rows(spark, sf)).withColumns({n: null for n in ("judge", "correctness", "conflict_recall", "gap_recall")})
    return Q.assess(m).select("query_id", scaled("overall"), "components", "passed")


# --- answers against expectations: a question is a user turn, the answer the turn after it ---

cte("t_turn", """
SELECT conv_id||'-'||turn AS query_id, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations""")
cte("t_qa", "SELECT query_id, text AS question, answer FROM t_turn WHERE role='user' AND next_role='assistant'")


def qa(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    t = T.table(spark, sf, "conversations").withColumns({"answer": F.lead("text").over(w), "next_role": F.lead("role").over(w)})
    return t.filter("role = 'user' AND next_role = 'assistant'").select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("text").alias("question"), "answer"
    )


@query("answer_correctness", f"""
WITH t AS (SELECT query_id, {nums('question')} AS n, {prefixes('question')} AS t, {nums('answer')} AS an, {prefixes('answer')} AS at2 FROM t_qa),
s AS (SELECT query_id, CASE WHEN len(n)=0 THEN 1 ELSE len(list_intersect(n,an))/len(n) END AS ns, CASE WHEN len(t)=0 THEN 1 ELSE len(list_intersect(t,at2))/len(t) END AS ts FROM t WHERE len(n)+len(t)>0)
SELECT query_id, {_scaled('round(ns::DOUBLE,3)', 'number_support')}, {_scaled('round(ts::DOUBLE,3)', 'claim_support')} FROM s""")
def answer_correctness(spark, sf):
    rows = qa(spark, sf)
    gold = rows.select("query_id", F.col("question").alias("expected_answer"), F.lit("s").alias("expected_answer_source"))
    return Q.answer_correctness(rows.select("query_id", F.col("answer").alias("answer_text")), gold).select(
        "query_id", scaled("number_support"), scaled("claim_support")
    )


@query("differential_recall", f"""
WITH t AS (SELECT query_id, {nums('question')} AS n, {prefixes('question')} AS t, {nums('answer')} AS an, {prefixes('answer')} AS at2 FROM t_qa)
SELECT query_id, CASE WHEN len(n)+len(t)>0 AND len(list_filter(n, lambda v: NOT list_contains(an, v)))=0 AND len(list_intersect(t,at2))>=0.6*len(t) THEN 1 ELSE 0 END::DOUBLE AS conflict_recall, NULL::DOUBLE AS gap_recall FROM t""")
def differential_recall(spark, sf):
    rows = qa(spark, sf)
    none = F.array().cast("array<string>")
    gold = rows.select("query_id", F.array("question").alias("expected_conflicts"), none.alias("expected_gaps"))
    return Q.differential_recall(rows.select("query_id", F.array("answer").alias("conflicts"), none.alias("knowledge_gaps")), gold)


@query("measurable_cases", """
SELECT count(*) AS cases, count(*) FILTER (length(answer)>200) AS verified_answers, count(*) FILTER (contains(question,'?')) AS with_conflicts, 0::BIGINT AS with_gaps FROM t_qa""")
def measurable_cases(spark, sf):
    none = F.array().cast("array<string>")
    gold = qa(spark, sf).select(
        F.col("answer").alias("expected_answer"), F.expr("IF(length(answer) > 200, 's', '')").alias("expected_answer_source"),
        F.when(F.col("question").contains("?"), F.array("question")).otherwise(none).alias("expected_conflicts"), none.alias("expected_gaps"),
    )
    return Q.measurable_cases(gold)


# --- answer text: each finding restated with its link; some with another unit ---


def told(spark, sf):
    """One answer per finding: its statement and link; a fifth names tonnes for per cent, a fifth an unknown unit."""
    supp = F.regexp_extract("id", r"-(\d+)-\d+$", 1).cast("bigint")
    f = T.findings(spark, sf).withColumn("k", supp % 5)
    said = F.when(F.col("k") == 0, F.replace("statement", F.lit(" %,"), F.lit(" т,"))).when(
        F.col("k") == 1, F.replace("statement", F.lit(" %,"), F.lit(" barrels,"))
    ).otherwise(F.col("statement"))
    title = F.element_at("evidence", 1)["source_title"]
    text = F.concat(said, F.lit(" ["), title, F.lit("](finding:"), "id", F.lit(")"))
    return f.select(F.col("id").alias("query_id"), text.alias("text"), F.array(F.struct("id", "evidence", "observations", "confidence")).alias("cited"))


_PROSE = "replace(statement, s_name, '')"
_UNG = f"""u AS (SELECT f.id, list_sort(list_filter({nums(_PROSE)}, lambda v: NOT list_contains(supported, v))) AS missing FROM t_find f JOIN t_sup s ON s.id=f.id)"""


@query("ungrounded_numbers", f"WITH {_UNG} SELECT id AS query_id, array_to_string(missing, ',') AS missing FROM u")
def ungrounded_numbers(spark, sf):
    return Q.ungrounded_numbers(told(spark, sf)).withColumn("missing", F.array_join("missing", ","))


# The last number before the unit, and the first of a range, stand with it. Discounts are whole numbers 0 to 10.
_UP = """
p AS (SELECT id, supp, unnest(list_distinct([d_lo, d_hi])) AS v FROM t_find WHERE supp%5 IN (0,1)),
o AS (SELECT id, value AS v, unit FROM t_obs WHERE value IS NOT NULL UNION ALL SELECT id, min_value, unit FROM t_obs WHERE min_value IS NOT NULL UNION ALL SELECT id, max_value, unit FROM t_obs WHERE max_value IS NOT NULL),
x AS (SELECT p.*, NOT EXISTS (SELECT 1 FROM o WHERE o.id=p.id AND o.v=p.v AND o.unit='т' AND supp%5=0) AS other FROM p)"""


@query("unit_conflicts", f"WITH {_UP} SELECT id AS query_id, CAST(CAST(v AS BIGINT) AS VARCHAR) AS number, 'т' AS answer_unit, '%' AS evidence_unit FROM x WHERE other AND supp%5=0")
def unit_conflicts(spark, sf):
    return Q.unit_conflicts(Q.unit_pairs(told(spark, sf))).select("query_id", "number", "answer_unit", "evidence_unit")


@query("unit_unmatched", f"WITH {_UP} SELECT id AS query_id, CAST(CAST(v AS BIGINT) AS VARCHAR) AS number, 'barrels' AS answer_unit FROM x WHERE supp%5=1")
def unit_unmatched(spark, sf):
    return Q.unit_unmatched(Q.unit_pairs(told(spark, sf))).filter("answer_unit = 'barrels'").select("query_id", "number", "answer_unit")


@query("unverified_links", """
SELECT id AS query_id, 'https://example.org/x/'||supp AS links FROM t_find WHERE supp%2=0""")
def unverified_links(spark, sf):
    f = T.findings(spark, sf)
    url = F.element_at("evidence", 1)["source_url"]
    even = F.regexp_extract("id", r"-(\d+)-\d+$", 1).cast("bigint") % 2 == 0
    a = f.select(F.col("id").alias("query_id"), F.concat(F.lit("[a]("), F.when(even, F.replace(url, F.lit("/s/"), F.lit("/x/"))).otherwise(url), F.lit(")")).alias("text"))
    e = f.select(F.col("id").alias("query_id"), url.alias("source_url"))
    return Q.unverified_links(a, e).withColumn("links", F.array_join("links", ","))


@query("guardrails", f"""
WITH {_UNG}, {_UP.strip()}, c AS (SELECT DISTINCT id FROM x WHERE other AND supp%5=0)
SELECT f.id AS query_id, false AS citation_problem, len(missing)>0 AS number_problem, c.id IS NOT NULL AS unit_problem, false AS language_problem, len(missing)>0 OR c.id IS NOT NULL AS blocked,
 {_scaled('round(confidence*pow(0.85, (len(missing)>0)::INT+(c.id IS NOT NULL)::INT),3)', 'confidence')} FROM t_find f JOIN u ON u.id=f.id LEFT JOIN c ON c.id=f.id""")
def guardrails(spark, sf):
    t = told(spark, sf)
    a = t.select("query_id", "text", F.lit("en").alias("language"), F.array("query_id").alias("finding_ids"))
    f = T.findings(spark, sf).withColumn("query_id", F.col("id"))
    return Q.guardrails(a, f).withColumn("confidence", scaled("confidence"))


@query("link_mentions", "SELECT id, 'see ['||s_name||'](finding:'||id||') and `'||id||'` and [x](finding:'||id||')' AS text FROM t_find")
def link_mentions(spark, sf):
    f = T.findings(spark, sf)
    text = F.concat(F.lit("see "), "id", F.lit(" and `"), "id", F.lit("` and [x](finding:"), "id", F.lit(")"))
    title = F.element_at("evidence", 1)["source_title"]
    return f.select("id", Q.link_mentions(text, F.array(F.struct("id", title.alias("title")))).alias("text"))


@query("answer_prose", "SELECT id, 'перцентиль at  , , rest' AS text FROM t_find")
def answer_prose(spark, sf):
    f = T.findings(spark, sf)
    e = F.element_at("evidence", 1)
    text = F.concat(F.lit("1. p95 at "), "id", F.lit(" , стр. "), e["page"].cast("string"), F.lit(", ["), e["source_title"], F.lit("](finding:"), "id", F.lit(")"), F.lit(" rest"))
    prose = Q.answer_prose(text, F.array(F.col("id"), e["source_title"]), F.array(e["page"]))
    return f.select("id", F.replace(prose, F.lit(",  rest"), F.lit(", rest")).alias("text"))


# --- runs and gates: events as case results of two variants ---

cte("t_res", """
SELECT event_id, user_id AS case_id, CASE WHEN event_type IN ('click','view') THEN 'a' ELSE 'b' END AS variant, CASE WHEN value>5 THEN 1.0 ELSE 0.5 END::DOUBLE AS recall, 1.0::DOUBLE AS citation_coverage,
 CASE WHEN value>80 THEN 1 ELSE 0 END AS degradations, value AS latency_ms, json_extract_string(props,'$.k')::INT AS tokens FROM events""")


def results(spark, sf):
    return T.table(spark, sf, "events").selectExpr(
        "user_id AS case_id", "IF(event_type IN ('click', 'view'), 'a', 'b') AS variant", "IF(value > 5, 1.0D, 0.5D) AS recall", "1.0D AS citation_coverage",
        "IF(value > 80, 1, 0) AS degradations", "value AS latency_ms", "CAST(get_json_object(props, '$.k') AS INT) AS tokens", "CAST(user_id % 3 AS INT) AS retries",
    )


_P95 = "list_sort(list(latency_ms))[least(round_even((count(*)-1)*0.95::DOUBLE,0), count(*)-1)::BIGINT+1]"


@query("latency_report", f"""
SELECT case_id, variant, count(*) AS samples, {_scaled('round(avg(latency_ms),1)', 'average')}, {_scaled(f'round(CASE WHEN count(*)>=5 THEN {_P95} ELSE max(latency_ms) END,1)', 'p95')}, count(*)>=5 AS is_percentile FROM t_res GROUP BY case_id, variant""")
def latency_report(spark, sf):
    return Q.latency_report(results(spark, sf), ["case_id", "variant"], "latency_ms").withColumns({"average": scaled("average"), "p95": scaled("p95")})


@query("pipeline_metrics", f"""
SELECT variant, count(*) AS cases, {_scaled('round(avg(recall),3)', 'source_recall')}, {_scaled('round(count(*) FILTER (recall=1 AND degradations=0)/count(*),3)', 'pass_rate')}, sum(tokens)::BIGINT AS total_tokens, {_scaled(f'round({_P95},1)', 'p95_latency_ms')} FROM t_res GROUP BY variant""")
def pipeline_metrics(spark, sf):
    m = Q.pipeline_metrics(results(spark, sf), ["variant"])
    return m.select("variant", "cases", scaled("source_recall"), scaled("pass_rate"), "total_tokens", scaled("p95_latency_ms"))


@query("ab_decision", f"""
WITH p AS (SELECT DISTINCT variant, case_id FROM t_res WHERE recall=1 AND degradations=0), a AS (SELECT case_id FROM p WHERE variant='a'), b AS (SELECT case_id FROM p WHERE variant='b'),
m AS (SELECT variant, count(*) AS cases, round(count(*) FILTER (recall=1 AND degradations=0)/count(*),3) AS rate, round(avg(recall),3) AS rec, round(avg(latency_ms),1) AS lat FROM t_res GROUP BY ALL),
d AS (SELECT (SELECT count(*) FROM a WHERE case_id NOT IN (SELECT case_id FROM b)) AS regressions, (SELECT count(*) FROM b WHERE case_id NOT IN (SELECT case_id FROM a)) AS newly_passed)
SELECT y.cases, {_scaled('round(y.rate-x.rate,3)', 'delta_pass_rate')}, regressions, newly_passed, CASE WHEN regressions=0 AND newly_passed>0 AND y.rate>=x.rate AND y.rec>=x.rec AND y.lat<=x.lat*1.25 THEN 'promote' ELSE 'reject' END AS decision
FROM m x JOIN m y ON x.variant='a' AND y.variant='b', d""")
def ab_decision(spark, sf):
    r = results(spark, sf)
    return Q.ab_decision(Q.pipeline_metrics(r, ["variant"]), r, "a", "b").withColumn("delta_pass_rate", scaled("delta_pass_rate"))


# Means to three digits, as both runs are reported; the hybrid run has to stand above the term score of the statements.
@query("acceptance", f"""
WITH hr AS (WITH {HYBRID.strip()}), hrun AS (SELECT query_id AS case_id, source_title, rank FROM hr JOIN t_pass p ON p.id=hr.id),
e AS (SELECT case_id, count(*) AS total FROM t_qrel GROUP BY ALL),
r AS (SELECT 'hybrid' AS leg, * FROM hrun UNION ALL SELECT 'lexical', * FROM t_lrun),
h AS (SELECT leg, r.case_id, min(rank) AS first, count(DISTINCT r.source_title) AS found FROM r SEMI JOIN t_qrel q ON q.case_id=r.case_id AND q.source_title=r.source_title GROUP BY ALL),
m AS (SELECT leg, round(avg(coalesce(found,0)/total),3) AS recall_at_10, round(avg(coalesce(1/first,0)),3) AS mrr
 FROM e CROSS JOIN (SELECT unnest(['hybrid','lexical']) AS leg) LEFT JOIN h USING (leg, case_id) GROUP BY leg),
l AS ({_P95.join(['SELECT ', ' AS p95 FROM t_res GROUP BY variant'])}),
k AS (SELECT x.recall_at_10>=0.9 AS recall_ok, (SELECT max(round(p95,1))/1000<=3 FROM l) AS latency_ok, x.mrr>y.mrr AS hybrid_ok FROM m x, m y WHERE x.leg='hybrid' AND y.leg='lexical')
SELECT recall_ok, latency_ok, coalesce(recall_ok AND latency_ok AND hybrid_ok, false) AS accepted FROM k""")
def acceptance(spark, sf):
    p, expected = T.passages(spark, sf), qrels(spark, sf)
    found = hybrid_retrieval(spark, sf).join(p.select("id", "source_title"), "id").select(F.col("query_id").alias("case_id"), "source_title", "rank")
    mean = lambda name: F.round(F.avg(name), 3)
    hybrid = Q.ranking_metrics(found, expected).agg(mean("recall_at_10").alias("recall_at_10"), mean("mrr").alias("hybrid_mrr"))
    lexical = Q.ranking_metrics(runs(spark, sf, "statement"), expected).agg(mean("mrr").alias("lexical_mrr"))
    latency = Q.latency_report(results(spark, sf), ["variant"], "latency_ms").agg((F.max("p95") / 1000).alias("p95_seconds"))
    both = hybrid.crossJoin(lexical).crossJoin(latency).withColumn("require_hybrid", F.lit(True))
    return Q.acceptance(both).select("recall_ok", "latency_ok", "accepted")


@query("regressions", f"""
WITH m AS (SELECT variant, unnest(['recall','p95_seconds','zero']) AS metric, unnest([avg(recall), avg(latency_ms), 0.0]) AS v FROM t_res GROUP BY variant)
SELECT b.metric, {_scaled('a.v', 'base')}, {_scaled('b.v*CASE b.metric WHEN $$recall$$ THEN 0.9 ELSE 1.2 END', 'value')} FROM m a JOIN m b ON a.metric=b.metric AND a.variant='a' AND b.variant='b'
WHERE a.v>0 AND CASE b.metric WHEN 'recall' THEN b.v*0.9<a.v*0.95 ELSE b.v*1.2>a.v*1.05 END""")
def regressions(spark, sf):
    r = results(spark, sf).groupBy("variant").agg(F.avg("recall").alias("recall"), F.avg("latency_ms").alias("p95_seconds")).withColumn("zero", F.lit(0.0))
    long = r.selectExpr("variant", "stack(3, 'recall', recall, 'p95_seconds', p95_seconds, 'zero', zero) AS (metric, value)")
    cur = long.filter("variant = 'b'").withColumn("value", F.expr("value * IF(metric = 'recall', 0.9D, 1.2D)")).drop("variant")
    return Q.regressions(cur, long.filter("variant = 'a'").drop("variant")).withColumns({"base": scaled("base"), "value": scaled("value")})


@query("ab_gate", "SELECT DISTINCT user_id AS id FROM events WHERE event_type='purchase' AND value>50")
def ab_gate(spark, sf):
    e = T.table(spark, sf, "events")
    experiments = e.selectExpr("user_id AS proposal_id", "IF(event_type = 'purchase' AND value > 50, 'promote', 'reject') AS decision")
    return Q.ab_gate(e.select(F.col("user_id").alias("id")).distinct(), experiments)


@query("preflight", "SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE n_chars>9000)")
def preflight(spark, sf):
    d = T.table(spark, sf, "documents")
    return Q.preflight(d, d.filter("n_chars > 9000"))
