"""DuckDB form of the table bindings: named sub-queries, put in front of a query as needed."""

from __future__ import annotations

import re

from ..functions import ids


def uuid5(namespace, name: str) -> str:
    """Version 5 UUID of an SQL text expression."""
    h = f"sha1(unhex('{namespace.hex}') || encode({name}))"
    return (
        f"(SELECT substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||"
        f"substr('89ab', (instr('0123456789abcdef', substr(h,17,1))-1)%4+1, 1)||substr(h,18,3)||'-'||substr(h,21,12) "
        f"FROM (SELECT {h} AS h))"
    )


def num(x: str) -> str:
    """Double as text, whole numbers without a fraction."""
    return f"(CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS HUGEINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END)"


def span(a: str, b: str) -> str:
    return f"(CASE WHEN {a}={b} THEN {num(a)} ELSE {num(a)}||'–'||{num(b)} END)"


def pick(key: str, *values: str) -> str:
    return "(CASE " + " ".join(f"WHEN {key}%{len(values)}={i} THEN '{v}'" for i, v in enumerate(values)) + " END)"


# Latin and Cyrillic patterns shared by several queries.
WORD = "[а-яёa-z0-9]+(?:-[а-яёa-z0-9]+)?"

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def sql(body: str) -> str:
    """The query with every named sub-query it uses, directly or through another, in order of definition."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    ctes = [f"{name} AS ({CTES[name]})" for name in CTES if name in needed]
    if not ctes:
        return body.strip()
    rest = body.strip()
    if rest.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + rest[15:]
    if rest.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + rest[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + rest


cte("t_ship", """
SELECT p_brand, p_type, l_suppkey AS supp, year(l_shipdate) AS yr, s_name, n_name, r_name, count(*) AS n,
 count(*) FILTER (l_returnflag='R') AS n_r, count(*) FILTER (l_returnflag='N') AS n_n,
 min(round(l_discount*100)) AS d_lo, max(round(l_discount*100)) AS d_hi,
 min(round(l_extendedprice/l_quantity)) AS p_lo, max(round(l_extendedprice/l_quantity)) AS p_hi,
 min(l_quantity) AS q_lo, max(l_quantity) AS q_hi
FROM lineitem JOIN part ON l_partkey=p_partkey JOIN supplier ON l_suppkey=s_suppkey
 JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey
GROUP BY ALL""")

_UNIT = "(CASE WHEN supp%2=0 THEN 'mg/L' ELSE 'мг/л' END)"
_LABEL = "p_brand||' '||p_type"
_STATEMENT = (
    f"{_LABEL}||' shipped by '||s_name||' in '||yr||': discount '||{span('d_lo', 'd_hi')}||' %, unit price '||"
    f"{span('p_lo', 'p_hi')}||' '||{_UNIT}"
)
cte("t_find", f"""
SELECT *, 'f-'||replace(p_brand,'#','')||'-'||p_type||'-'||supp||'-'||yr AS id,
 {_STATEMENT} AS statement,
 CASE WHEN supp%7=0 THEN {_LABEL}||' shipped by '||s_name||', discount '||{span('d_lo', 'd_hi')}||' %' ELSE {_STATEMENT} END AS quote,
 (50+4*least(n,10))/100.0::DOUBLE AS confidence,
 CASE WHEN n_n*2>=n THEN 'consensus' WHEN n_r*2>n THEN 'disputed' ELSE 'hypothesis' END AS status,
 CASE WHEN NOT (p_type='PROMO' AND supp%10=0) THEN {_LABEL} END AS subject,
 {pick('supp', 'public', 'internal', 'restricted')} AS data_class,
 CASE WHEN supp%20<>0 THEN CAST(yr AS VARCHAR) END AS s_year, r_name AS s_geo, CASE WHEN supp%50=49 THEN 'demo' END AS s_origin,
 'doc-supplier-'||supp AS doc, {_UNIT} AS p_unit
FROM t_ship""")

_AMOUNT = pick("supp", "lte", "gte", "eq")
cte("t_obs", f"""
SELECT id, 0 AS idx, 'discount' AS property_name, 'between' AS operator, NULL::DOUBLE AS value, d_lo AS min_value, d_hi AS max_value,
 '%' AS unit, 'discount '||{span('d_lo', 'd_hi')}||' %' AS raw_text FROM t_find
UNION ALL SELECT id, 1, 'unit_price', CASE WHEN n=1 THEN 'eq' ELSE 'between' END, CASE WHEN n=1 THEN p_lo END,
 CASE WHEN n>1 THEN p_lo END, CASE WHEN n>1 THEN p_hi END, p_unit, 'price '||{span('p_lo', 'p_hi')} FROM t_find
UNION ALL SELECT id, 2, 'quantity', {_AMOUNT}, CASE WHEN supp%3=1 THEN q_lo ELSE q_hi END, NULL, NULL, 'т',
 {pick('supp', 'at most ', 'at least ', 'не более ')}||{num('q_hi')}||' т' FROM t_find WHERE n>1""")

cte("t_evid", """
SELECT id, 0 AS pos, doc AS document_id, s_name AS source_title, 'https://example.org/s/'||supp AS source_url, 1+supp%9 AS page,
 NULL AS sheet, quote FROM t_find
UNION ALL SELECT id, 1, 'doc-nation-'||n_name, n_name, NULL, NULL, 'S1', 'line items: '||n FROM t_find WHERE n>1""")

cte("t_claim", """
SELECT o.id||'#'||property_name||'#'||idx AS claim_id, o.id AS finding_id, coalesce(subject, o.id) AS subject_id,
 'HAS_PROPERTY' AS predicate, property_name, coalesce(min_value,value) AS lo, coalesce(max_value,value) AS hi, unit,
 s_year, s_geo, s_origin, CASE WHEN status='consensus' THEN 'expert_validated' ELSE 'extracted' END AS kind, n_name, data_class
FROM t_obs o JOIN t_find f ON o.id=f.id""")

cte("t_pair", f"""
SELECT a.subject_id, a.property_name, a.unit, a.n_name AS l_nation, b.n_name AS r_nation,
 a.claim_id AS left_claim_id, b.claim_id AS right_claim_id, a.finding_id AS left_finding_id, b.finding_id AS right_finding_id,
 a.lo AS l_lo, a.hi AS l_hi, b.lo AS r_lo, b.hi AS r_hi, a.s_origin AS l_origin, b.s_origin AS r_origin,
 concat_ws(';', 'geography='||a.s_geo, CASE WHEN a.s_origin=b.s_origin THEN 'origin='||a.s_origin END,
  CASE WHEN a.s_year=b.s_year THEN 'year='||a.s_year END) AS shared_scope
FROM t_claim a JOIN t_claim b ON a.subject_id=b.subject_id AND a.property_name=b.property_name AND a.unit=b.unit
 AND a.s_geo=b.s_geo AND a.claim_id<b.claim_id
WHERE (a.hi<b.lo OR b.hi<a.lo) AND (a.s_year IS NULL OR b.s_year IS NULL OR a.s_year=b.s_year)""")


def pair_id(left: str, right: str, prop: str, scope: str) -> str:
    return uuid5(ids.CONFLICT_NAMESPACE, f"least({left},{right})||'|'||greatest({left},{right})||'|'||{prop}||'|'||{scope}")


cte("t_next", """
SELECT *, lead(id) OVER w AS right_id, lead(s_year) OVER w AS r_year, lead(s_origin) OVER w AS r_origin
FROM t_find WHERE subject IS NOT NULL WINDOW w AS (PARTITION BY subject, s_geo, yr ORDER BY id)""")
cte("t_review", f"""
SELECT 'rev-'||id AS id, {pair_id("id||'#discount#0'", "right_id||'#discount#0'", "'discount'",
 "concat_ws(';', 'geography='||s_geo, CASE WHEN s_origin=r_origin THEN 'origin='||s_origin END, CASE WHEN s_year=r_year THEN 'year='||s_year END)")}
 AS candidate_id, CASE WHEN supp%2=0 THEN 'confirmed' ELSE 'dismissed' END AS status, 'expert-'||supp%5 AS actor_id,
 id AS left_finding_id, right_id AS right_finding_id, yr||'-12-01' AS created_at
FROM t_next WHERE status='disputed' AND right_id IS NOT NULL""")

cte("t_plan", """
SELECT n_name AS plan_id, n_nationkey, CASE WHEN n_nationkey%4<>0 THEN 1993+n_nationkey%5 END AS year_from,
 CASE WHEN n_nationkey%3<>0 THEN 1999 END AS year_to,
 CASE n_nationkey%5 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['asia','africa'] ELSE [lower(r_name)] END AS countries
FROM nation JOIN region ON n_regionkey=r_regionkey""")
cte("t_flt", """
SELECT n_name AS plan_id, 'discount' AS prop, 'between' AS op, NULL::DOUBLE AS v, 2.0 AS a, 6.0 AS b, '%' AS u FROM nation WHERE n_nationkey%3=0
UNION ALL SELECT n_name, 'discount', 'gte', 5, NULL, NULL, '%' FROM nation WHERE n_nationkey%3=1
UNION ALL SELECT n_name, 'unit_price', 'lt', 2000, NULL, NULL, 'mg/L' FROM nation WHERE n_nationkey%3=1""")
# Candidates of a plan with the outcome of each limit. Every operator of the filters above has its own line.
cte("t_hit", """
SELECT f.id, t.plan_id, t.prop, bool_or(CASE t.op
  WHEN 'between' THEN CASE WHEN o.value IS NOT NULL THEN o.value BETWEEN t.a AND t.b ELSE o.min_value<=t.b AND o.max_value>=t.a END
  WHEN 'gte' THEN coalesce(o.value, o.max_value)>=t.v WHEN 'lt' THEN coalesce(o.value, o.min_value)<t.v END) AS hit
FROM t_find f JOIN t_flt t ON t.plan_id=f.n_name JOIN t_obs o ON o.id=f.id AND o.property_name=t.prop AND o.unit=t.u
GROUP BY ALL""")
cte("t_cand", """
SELECT f.*, p.*, row_number() OVER (PARTITION BY plan_id ORDER BY confidence DESC, f.id) AS pos,
 f.id NOT IN (SELECT id FROM t_hit WHERE NOT hit) AS numeric_ok,
 (year_from IS NOT NULL OR year_to IS NOT NULL) AS wants_year, len(countries)>0 AS wants_geo,
 coalesce(s_year::INT<year_from, false) OR coalesce(s_year::INT>year_to, false) AS out_year,
 len(countries)>0 AND NOT list_has_any(countries, [lower(s_geo)])
  AND NOT list_bool_or(list_transform(countries, lambda c: contains(lower(s_geo), c) OR contains(c, lower(s_geo))
   OR list_bool_or(list_transform(string_split(lower(s_geo), ' '), lambda w: contains(w, c) OR contains(c, w))))) AS out_geo
FROM t_find f JOIN t_plan p ON f.n_name=p.plan_id""")
# Versions after two rounds of corrections.
cte("t_ver", """
SELECT id AS root, id, 1 AS version, CASE WHEN status='disputed' THEN id||'-v2' END AS superseded_by, data_class, statement, status FROM t_find
UNION ALL SELECT id, id||'-v2', 2, CASE WHEN data_class='public' THEN id||'-v2-v3' END, data_class, 'corrected: '||statement, status FROM t_find WHERE status='disputed'
UNION ALL SELECT id, id||'-v2-v3', 3, NULL, data_class, 'corrected: corrected: '||statement, status FROM t_find WHERE status='disputed' AND data_class='public'""")

_CLS = lambda k: pick(k, "public", "internal", "restricted")
cte("t_node", f"""
SELECT 'part-'||p_partkey AS id, p_name AS label, 'material' AS type, 1.0::DOUBLE AS confidence, {_CLS('p_partkey')} AS data_class FROM part
UNION ALL SELECT DISTINCT 'type-'||p_type, p_type, 'process', 1.0, 'public' FROM part
UNION ALL SELECT 'supplier-'||s_suppkey, s_name, 'equipment', 1.0, {_CLS('s_suppkey')} FROM supplier
UNION ALL SELECT 'nation-'||n_nationkey, n_name, 'location', 1.0, 'public' FROM nation
UNION ALL SELECT 'customer-'||c_custkey, c_name, 'expert', 0.9, 'public' FROM customer
UNION ALL SELECT 'order-'||o_orderkey, 'Order '||o_orderkey, 'publication', 1.0, 'public' FROM orders""")
cte("t_bought", """
SELECT o_custkey, p_type, count(*) AS n FROM lineitem JOIN part ON l_partkey=p_partkey JOIN orders ON l_orderkey=o_orderkey GROUP BY ALL""")
cte("t_edge", """
SELECT source||'|'||relation||'|'||target AS id, * FROM (
SELECT 'supplier-'||s_suppkey AS source, 'nation-'||s_nationkey AS target, 'LOCATED_IN' AS relation, 1.0::DOUBLE AS confidence, 'public' AS data_class FROM supplier
UNION ALL SELECT 'part-'||p_partkey, 'type-'||p_type, 'PROCESSED_BY', 1.0, 'public' FROM part
UNION ALL SELECT 'supplier-'||l_suppkey, 'type-'||p_type, 'USED_BY', least(count(*),200)/200.0::DOUBLE, 'public' FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY l_suppkey, p_type
UNION ALL SELECT 'customer-'||o_custkey, 'type-'||p_type, 'EXPERT_IN', least(n,20)/20.0::DOUBLE, 'public'
 FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, p_type) AS r FROM t_bought) WHERE r=1
UNION ALL SELECT DISTINCT 'supplier-'||l_suppkey, 'part-'||l_partkey, 'USED_IN', 0.5, CASE WHEN l_partkey%3=2 THEN 'restricted' ELSE 'public' END FROM lineitem)""")

cte("t_frag", """
SELECT 'doc-'||doc_id AS document_id, doc_id, source||'-'||doc_id AS title, i-1 AS pos, string_split(text, chr(10))[i] AS line,
 (length(array_to_string(list_slice(string_split(text, chr(10)),1,i-1), chr(10))) + CASE WHEN i>1 THEN 1 ELSE 0 END)::INTEGER AS start
FROM documents, unnest(generate_series(1, len(string_split(text, chr(10))))) AS t(i)""")


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


cte("t_chunk", f"""
SELECT * FROM (SELECT document_id, doc_id, title, pos AS fragment_index, o::INTEGER AS "offset", line,
 {strip("substr(body, o+1, 4000)")} AS text
FROM (SELECT *, {strip('line')} AS body FROM t_frag) f, unnest(generate_series(0, length(body)-1, 3700)) AS t(o)) WHERE length(text)>=40""")
cte("t_words", """
SELECT document_id, doc_id, pos, line, string_split(line,' ')[1] AS w1, string_split(line,' ')[2] AS w2, string_split(line,' ')[3] AS w3
FROM t_frag WHERE len(string_split(line,' '))>2""")
cte("t_cin", """
SELECT document_id, pos, w1 AS subject, ['USES','HAS_PROPERTY','LOCATED_IN','unknown thing'][pos%4+1] AS predicate, w2 AS object,
 line AS statement, (60+pos%40)/100.0::DOUBLE AS confidence,
 CASE pos%3 WHEN 0 THEN line WHEN 1 THEN lower(line) ELSE '~'||line END AS evidence_quote FROM t_words""")
cte("t_ent", """
SELECT document_id, w1 AS name, 'the '||w1 AS canonical_name, ['material','process','equipment'][min(pos)%3+1] AS type, w1||'s' AS alias
FROM t_words WHERE pos%2=0 GROUP BY ALL""")
cte("t_res", """
SELECT document_id, w2 AS mention, 'canon '||w2 AS canonical_name, (50+min(pos)%5*10)/100.0::DOUBLE AS confidence FROM t_words GROUP BY ALL""")
cte("t_acc", "SELECT lower(w3) AS alias, 'agreed '||lower(min(w3)) AS canonical FROM t_words WHERE length(w3)>6 GROUP BY ALL")
cte("t_prop", """
SELECT document_id, lower(mention) AS k, max(canonical_name) AS v FROM t_res WHERE confidence>=0.7 GROUP BY ALL""")
cte("t_canon", """
SELECT e.document_id, e.name, coalesce(a.canonical, p.v, e.canonical_name) AS canonical_name, e.type, e.alias
FROM t_ent e LEFT JOIN t_prop p ON p.document_id=e.document_id AND p.k=lower(e.name) LEFT JOIN t_acc a ON a.alias=lower(e.name)""")
cte("t_own", """
SELECT document_id, k, max(canonical_name) AS v FROM (SELECT document_id, canonical_name, unnest([lower(name), lower(canonical_name), lower(alias)]) AS k FROM t_canon) GROUP BY ALL""")
cte("t_supp", """
SELECT c.* FROM t_cin c JOIN documents d ON c.document_id='doc-'||d.doc_id
WHERE trim(evidence_quote)<>'' AND (contains(d.text, trim(evidence_quote)) OR contains(lower(d.text), lower(trim(evidence_quote))))""")
