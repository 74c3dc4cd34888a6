"""Numeric comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions import units as U
from ..operators import numbers as N
from ..sources import testdata as T
from .registry import query

BIG = 1000000


def scaled(name):
    """Computed fractions in millionths, so that both engines agree on the last digit."""
    return F.round(F.col(name) * BIG).cast("bigint").alias(name)


def _scaled(x, name):
    return f'CAST(round(({x})*{BIG}) AS BIGINT) AS "{name}"'


@query("scales", """
SELECT property_name, unit, min(v) AS lo, max(v) AS hi, count(*) AS n FROM (SELECT property_name, unit, unnest([value, min_value, max_value]) AS v FROM t_obs) WHERE v IS NOT NULL GROUP BY ALL""")
def scales(spark, sf):
    return N.scales(T.findings(spark, sf))


_SCALES = """s AS (SELECT property_name, unit, min(v) AS lo, max(v) AS hi FROM (SELECT property_name, unit, unnest([value, min_value, max_value]) AS v FROM t_obs) WHERE v IS NOT NULL GROUP BY ALL)"""


@query("measure_bars", f"""
WITH {_SCALES} SELECT o.id, o.idx::INTEGER AS pos, o.property_name,
 {_scaled("CASE WHEN operator='between' THEN (min_value-lo)/(hi-lo)*100 WHEN operator='lte' THEN 0 ELSE (value-lo)/(hi-lo)*100 END", 'left')},
 {_scaled("CASE WHEN operator='between' THEN (max_value-lo)/(hi-lo)*100-(min_value-lo)/(hi-lo)*100 WHEN operator='lte' THEN (value-lo)/(hi-lo)*100 WHEN operator='gte' THEN 100-(value-lo)/(hi-lo)*100 ELSE 0 END", 'width')}
FROM t_obs o JOIN s ON o.property_name=s.property_name AND o.unit=s.unit""")
def measure_bars(spark, sf):
    return N.measure_bars(T.findings(spark, sf)).select("id", "pos", "property_name", "bar.*").select(
        "id", "pos", "property_name", scaled("left"), scaled("width")
    )


# The unit of a comparison is its printed form, so both spellings of mg/L meet.
_POINTS = """p AS (SELECT o.id AS finding_id, coalesce(subject,'') AS subject, property_name, CASE WHEN unit IN ('mg/L','мг/л') THEN 'мг/л' ELSE unit END AS unit,
 coalesce(min_value,value) AS lo, coalesce(max_value,value) AS hi FROM t_obs o JOIN t_find f ON o.id=f.id)"""
_COMPARED = f"""WITH {_POINTS},
o AS (SELECT *, lag(hi) OVER (PARTITION BY subject, property_name, unit ORDER BY lo, hi) AS before FROM p),
c AS (SELECT subject, property_name, unit, count(*) AS points, min(lo) AS lo, arg_max(hi, (lo,hi)) AS hi, max(lo) AS max_lo, min(hi) AS min_hi,
 coalesce(bool_and(before IS NULL OR lo>before), true) AS disjoint, arg_min(finding_id, (lo,hi,finding_id)) AS low_id, arg_max(finding_id, (lo,hi,finding_id)) AS high_id
 FROM o GROUP BY ALL HAVING count(*)>=2)"""


@query("points", f"WITH {_POINTS} SELECT * FROM p")
def points(spark, sf):
    return N.points(N._topics(T.findings(spark, sf)), ["subject"])


@query("comparisons", _COMPARED + f"""
SELECT subject, property_name, unit, points, lo, hi, hi-lo AS spread, {_scaled('CASE WHEN hi>=lo AND lo>0 THEN (hi-lo)/lo END', 'relative')},
 CASE WHEN min_hi>=max_lo THEN max_lo END AS overlap_lo, CASE WHEN min_hi>=max_lo THEN min_hi END AS overlap_hi, disjoint, hi-lo>0 AS diverges, low_id, high_id FROM c""")
def comparisons(spark, sf):
    return N.comparisons(N._topics(T.findings(spark, sf)), ["subject"]).withColumn("relative", scaled("relative"))


@query("headline", _COMPARED + """,
h AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY coalesce(CASE WHEN hi>=lo AND lo>0 THEN (hi-lo)/lo END,-1) DESC, hi-lo DESC, property_name, unit) AS n FROM c)
SELECT subject, property_name, unit FROM h WHERE n=1""")
def headline(spark, sf):
    return N.headline(N.comparisons(N._topics(T.findings(spark, sf)), ["subject"]), ["subject"]).select("subject", "property_name", "unit")


_LIMITS = """
WITH l AS (SELECT n_name AS object, o.id, property_name, idx, value AS lv, unit, CASE WHEN operator='lte' THEN 'lte' WHEN operator='gte' THEN 'gte'
  WHEN contains(raw_text,'не более') THEN 'lte' END AS kind, CASE WHEN operator IN ('lte','gte') THEN 'operator' ELSE 'wording' END AS origin
 FROM t_obs o JOIN t_find f ON o.id=f.id WHERE value IS NOT NULL),
k AS (SELECT * FROM l WHERE kind IS NOT NULL), f AS (SELECT object, property_name, arg_min(kind, (id,idx)) AS kind FROM k GROUP BY ALL),
lim AS (SELECT k.object, k.property_name, k.kind, CASE WHEN k.kind='lte' THEN min(lv) ELSE max(lv) END AS lv, min(unit) AS unit,
 arg_min(origin, (CASE WHEN k.kind='lte' THEN lv ELSE -lv END, id, idx)) AS origin FROM k JOIN f ON k.object=f.object AND k.property_name=f.property_name AND k.kind=f.kind GROUP BY k.object, k.property_name, k.kind)"""


@query("detect_limit", """
SELECT id, idx::INTEGER AS pos, value AS at, CASE WHEN operator='lte' OR operator='eq' AND contains(raw_text,'не более') THEN 'lte' WHEN operator='gte' THEN 'gte' END AS kind,
 CASE WHEN operator IN ('lte','gte') THEN 'operator' ELSE 'wording' END AS origin FROM t_obs
WHERE value IS NOT NULL AND (operator IN ('lte','gte') OR contains(raw_text,'не более'))""")
def detect_limit(spark, sf):
    rows = T.findings(spark, sf).select("id", F.posexplode("observations").alias("pos", "o")).withColumn("l", M.detect_limit(F.col("o")))
    return rows.filter("l IS NOT NULL").select("id", "pos", "l.at", "l.kind", "l.origin")


@query("strictest_limits", _LIMITS + ' SELECT object, property_name, kind, lv AS "at", unit, origin FROM lim')
def strictest_limits(spark, sf):
    return N.strictest_limits(T.findings(spark, sf), ["object"])


# The reference's cells print floats with a decimal part.
_F = lambda x: f"(CASE WHEN {x}=floor({x}) THEN CAST({x} AS BIGINT)||'.0' ELSE CAST({x} AS VARCHAR) END)"
_CELL = f"CASE WHEN operator='between' THEN {_F('min_value')}||'–'||{_F('max_value')} ELSE CASE operator WHEN 'lte' THEN '≤' WHEN 'gte' THEN '≥' ELSE '=' END||{_F('value')} END"
_MATRIX = f"""
r AS (SELECT n_name AS object, coalesce(subject, o.id) AS item, property_name, o.id, idx, confidence, quote, unit, {_CELL} AS plain,
  coalesce({_F('value')},'None')||' '||unit||' ('||{_CELL}||' '||unit||')' AS long_text FROM t_obs o JOIN t_find f ON o.id=f.id),
u AS (SELECT object, item, property_name, count(DISTINCT unit) AS units, min(unit) AS unit, max(confidence) AS confidence,
 arg_min(quote, (-confidence, id, idx)) AS evidence FROM r GROUP BY ALL),
d AS (SELECT r.object, r.item, r.property_name, CASE WHEN units=1 THEN plain ELSE long_text END AS text, min((r.id, idx)) AS fst FROM r JOIN u ON r.object=u.object AND r.item=u.item AND r.property_name=u.property_name GROUP BY ALL),
j AS (SELECT object, item, property_name, string_agg(text, ' / ' ORDER BY fst) AS text FROM d GROUP BY ALL),
m AS (SELECT u.object, u.item, u.property_name, CASE WHEN units=1 THEN text ELSE 'единицы измерений различаются: '||text END AS value, CASE WHEN units=1 THEN u.unit END AS unit, evidence, confidence
 FROM u JOIN j ON u.object=j.object AND u.item=j.item AND u.property_name=j.property_name)"""


@query("compare", "WITH " + _MATRIX + """ SELECT * FROM m UNION ALL SELECT DISTINCT object, item, 'salinity', NULL, NULL, NULL, NULL::DOUBLE FROM r""")
def compare(spark, sf):
    return N.compare(T.findings(spark, sf), ["object"], ["salinity ", "discount"])


_NUMS = "list_transform(regexp_extract_all(coalesce(value,''), '-?\\d+(?:[.,]\\d+)?'), lambda x: CAST(replace(x, ',', '.') AS DOUBLE))"


@query("limit_violations", _LIMITS + ", " + _MATRIX + f""",
x AS (SELECT m.*, lim.kind, lim.lv, CASE WHEN kind='lte' THEN list_max({_NUMS}) ELSE list_min({_NUMS}) END AS worst,
 coalesce(m.value<>'' AND lim.lv IS NOT NULL AND lower(m.unit)=lower(lim.unit), false) AS fits FROM m LEFT JOIN lim ON m.object=lim.object AND m.property_name=lim.property_name)
SELECT object, item, property_name, kind, lv AS "at", CASE WHEN NOT fits THEN 'none' WHEN (kind='lte' AND worst>lv) OR (kind='gte' AND worst<lv) THEN 'outside' ELSE 'within' END AS "check",
 CASE WHEN fits AND ((kind='lte' AND worst>lv) OR (kind='gte' AND worst<lv)) THEN worst END AS offending FROM x""")
def limit_violations(spark, sf):
    f = T.findings(spark, sf)
    cells = N.compare(f, ["object"]).select("object", "item", "property_name", "value", "unit")
    return N.limit_violations(cells, N.strictest_limits(f, ["object"]), ["object"]).drop("value", "unit")


_TOPICS = _COMPARED + """,
g AS (SELECT coalesce(subject,'') AS subject, count(*) AS findings, min(id) AS first_id, list_sort(list(id))[2] AS second_id FROM t_find GROUP BY ALL),
s AS (SELECT coalesce(subject,'') AS subject, count(DISTINCT document_id) AS sources FROM t_evid e JOIN t_find f ON e.id=f.id GROUP BY ALL),
n AS (SELECT subject, count(*) AS comparisons, arg_min(property_name, (-coalesce(CASE WHEN hi>=lo AND lo>0 THEN (hi-lo)/lo END,-1), lo-hi, property_name, unit)) AS headline,
 arg_min(low_id, (lo-hi, property_name, unit)) AS low_id, arg_min(high_id, (lo-hi, property_name, unit)) AS high_id FROM c GROUP BY ALL)"""


@query("topic_groups", _TOPICS + """
SELECT g.subject, findings, first_id, second_id, sources, coalesce(comparisons,0) AS comparisons, headline, low_id, high_id FROM g LEFT JOIN s ON g.subject=s.subject LEFT JOIN n ON g.subject=n.subject""")
def topic_groups(spark, sf):
    return N.topic_groups(T.findings(spark, sf)).drop("predicate", "divergence")


@query("widest_pair", _TOPICS + """,
w AS (SELECT g.subject, coalesce(low_id, first_id) AS base, coalesce(high_id, second_id) AS other, first_id, second_id FROM g LEFT JOIN n ON g.subject=n.subject)
SELECT subject, base, CASE WHEN other=base THEN CASE WHEN base=first_id THEN second_id ELSE first_id END ELSE other END AS other FROM w""")
def widest_pair(spark, sf):
    return N.widest_pair(N.topic_groups(T.findings(spark, sf))).drop("predicate")


# One topic per subject and year here, so that single findings and findings without numbers occur.
@query("gap_notes", """
WITH f AS (SELECT coalesce(subject,'')||' '||yr||' '||r_name AS subject, id, n, supp, s_origin FROM t_find),
g AS (SELECT subject, count(*) AS findings, min(id) AS first_id, count(*) FILTER (s_origin IS NULL) AS numeric_n FROM f GROUP BY ALL)
SELECT 'pair' AS kind, subject, first_id AS id, findings FROM g WHERE findings<2
UNION ALL SELECT 'unit', subject, first_id, findings FROM g WHERE findings>=2 AND numeric_n<2
UNION ALL SELECT 'value', f.subject, id, findings FROM f JOIN g ON f.subject=g.subject WHERE s_origin IS NOT NULL
UNION ALL SELECT 'locator', f.subject, id, findings FROM f JOIN g ON f.subject=g.subject WHERE n>2""")
def gap_notes(spark, sf):
    f = T.findings(spark, sf)
    year = F.regexp_extract("id", r"-(\d+)$", 1)
    f = f.withColumns({
        "subject": F.concat_ws(" ", F.coalesce("subject", F.lit("")), year, F.element_at("scope", "geography")),
        "observations": F.when(F.try_element_at("scope", F.lit("origin")).isNull(), F.col("observations")).otherwise(F.slice("observations", 1, 0)),
        "evidence": F.when(F.col("confidence") > 0.58, F.slice("evidence", 1, 0)).otherwise(F.col("evidence")),
    })
    return N.gap_notes(f).drop("predicate")


@query("interval_groups", f"""
WITH e AS (SELECT n_name AS object, o.id, min(coalesce(min_value,value)) AS elo, max(coalesce(max_value,value)) AS ehi FROM t_obs o JOIN t_find f ON o.id=f.id GROUP BY ALL),
g AS (SELECT object, min(elo) AS lo, max(ehi) AS hi FROM e GROUP BY ALL),
p AS (SELECT object, CASE WHEN lo=hi THEN lo-CASE WHEN lo=0 THEN 1 ELSE abs(lo)*0.1 END ELSE lo END AS lo, CASE WHEN lo=hi THEN hi+CASE WHEN lo=0 THEN 1 ELSE abs(lo)*0.1 END ELSE hi END AS hi FROM g),
b AS (SELECT e.*, lo, hi, (elo-lo)/(hi-lo)*100 AS l, (ehi-lo)/(hi-lo)*100 AS r FROM e JOIN p ON e.object=p.object)
SELECT object, '%' AS unit, id, lo, hi, {_scaled('greatest(0, least(l, 100))', 'left')}, {_scaled('greatest(1, least(r-l, 100-greatest(l,0)))', 'width')} FROM b""")
def interval_groups(spark, sf):
    out = N.interval_groups(T.findings(spark, sf), ["object"])
    return out.withColumns({"left": scaled("left"), "width": scaled("width")})


_ENV = "e AS (SELECT n_name||' '||yr AS query_id, f.subject, o.id, min(coalesce(min_value,value)) AS lo, max(coalesce(max_value,value)) AS hi FROM t_obs o JOIN t_find f ON o.id=f.id WHERE subject IS NOT NULL AND property_name='discount' GROUP BY ALL)"


@query("rivals", f"""
WITH {_ENV} SELECT a.query_id, a.subject, a.id AS finding_id, b.id AS rival_id, CASE WHEN a.hi<b.lo THEN b.lo-a.hi ELSE a.lo-b.hi END AS delta
FROM e a JOIN e b ON a.query_id=b.query_id AND a.subject=b.subject WHERE a.hi<b.lo OR b.hi<a.lo""")
def rivals(spark, sf):
    f = T.findings(spark, sf).withColumns({
        "query_id": F.concat_ws(" ", "object", F.regexp_extract("id", r"-(\d+)$", 1)),
        "observations": F.filter("observations", lambda o: o["property_name"] == "discount"),
    })
    return N.rivals(f, ["query_id"]).drop("predicate")


@query("filter_coverage", """
WITH o AS (SELECT n_name AS plan_id, property_name, coalesce(min_value,value) AS lo, coalesce(max_value,value) AS hi FROM t_obs o JOIN t_find f ON o.id=f.id),
t AS (SELECT *, (CASE WHEN prop='unit_price' THEN 1 ELSE 0 END)::INTEGER AS filter_pos FROM t_flt)
SELECT t.plan_id, filter_pos, prop AS property_name, op AS operator, (SELECT count(*) FROM o WHERE o.plan_id=t.plan_id AND o.property_name=t.prop
 AND CASE op WHEN 'between' THEN hi>=a AND lo<=b WHEN 'gte' THEN hi>=v ELSE lo<=v END) AS covered FROM t""")
def filter_coverage(spark, sf):
    return N.filter_coverage(T.plans(spark, sf), T.findings(spark, sf).withColumn("plan_id", F.col("object")), "plan_id")


@query("outside_filter", """
SELECT n_name AS plan_id, o.id, idx::INTEGER AS pos, property_name, coalesce(CASE op WHEN 'between' THEN coalesce(max_value,value)<a OR coalesce(min_value,value)>b
 WHEN 'gte' THEN coalesce(max_value,value)<v ELSE coalesce(min_value,value)>v END, false) AS outside
FROM t_obs o JOIN t_find f ON o.id=f.id LEFT JOIN t_flt t ON t.plan_id=n_name AND t.prop=property_name AND t.u=unit""")
def outside_filter(spark, sf):
    return N.outside_filter(T.plans(spark, sf), T.findings(spark, sf).withColumn("plan_id", F.col("object")), "plan_id")


@query("units", """
SELECT id, idx::INTEGER AS pos, CASE unit WHEN '%' THEN '%' WHEN 'т' THEN 'т' ELSE 'мг/л' END AS unit_key, CASE unit WHEN '%' THEN 1.0 WHEN 'т' THEN 1000.0 ELSE 0.001 END::DOUBLE AS scale,
 CASE unit WHEN 'т' THEN 'mass' END AS dimension, CASE unit WHEN '%' THEN '%' WHEN 'т' THEN 'т' ELSE 'мг/л' END AS label FROM t_obs""")
def units(spark, sf):
    o = T.findings(spark, sf).select("id", F.posexplode("observations").alias("pos", "o"))
    u = F.col("o.unit")
    return o.select(
        "id", "pos", U.unit_key(u).alias("unit_key"), U.unit_scale(u).alias("scale"), U.unit_dimension(u).alias("dimension"), U.unit_label(u).alias("label")
    )


@query("value_texts", f"""
SELECT id, idx::INTEGER AS pos, {_CELL} AS cell, CASE WHEN coalesce(min_value,value)=coalesce(max_value,value) THEN format('{{:g}}', coalesce(min_value,value))
 ELSE format('{{:g}}', min_value)||'–'||format('{{:g}}', max_value) END||' '||unit AS range_text FROM t_obs""")
def value_texts(spark, sf):
    o = T.findings(spark, sf).select("id", F.posexplode("observations").alias("pos", "o")).withColumn("b", M.bounds(F.col("o")))
    return o.select("id", "pos", M.format_value(F.col("o")).alias("cell"), M.format_range(F.col("b.lo"), F.col("b.hi"), F.col("b.unit")).alias("range_text"))


@query("deltas", f"""
WITH a AS (SELECT o_custkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS base, o_orderkey FROM orders)
SELECT o_orderkey, {_scaled('CASE WHEN base>0 THEN (o_totalprice-base)/base END', 'ratio')}, CASE WHEN base IS NULL THEN 'absent' WHEN base=0 THEN 'zero' WHEN base<0 THEN 'negative' END AS miss,
 {_scaled('CASE WHEN o_totalprice>base+10000 THEN o_totalprice-base-10000 WHEN base>o_totalprice THEN base-o_totalprice END', 'gap')} FROM a""")
def deltas(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = T.table(spark, sf, "orders").withColumn("base", F.lag("o_totalprice").over(w))
    o = o.withColumn("d", M.delta_from_base(F.col("base"), F.col("o_totalprice"))).withColumn(
        "gap", M.gap_between(F.col("base"), F.col("base") + 10000, F.col("o_totalprice"), F.col("o_totalprice"))
    )
    return o.select("o_orderkey", "d.ratio", "d.miss", "gap").withColumns({"ratio": scaled("ratio"), "gap": scaled("gap")})
