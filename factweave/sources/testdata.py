"""Binding of the given star schema and text tables to the domain tables.

Every function reads the whole table. The same rules stand as SQL in ``plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Declared schemas: reading needs no inference job, and a wrong file fails early.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, "
    "o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {name: table(spark, sf_dir, name) for name in names}


def _pick(col: Column, *values: str) -> Column:
    """One of the values by an integer key."""
    out = F.when(F.pmod(col, F.lit(len(values))) == 0, F.lit(values[0]))
    for i, value in enumerate(values[1:], start=1):
        out = out.when(F.pmod(col, F.lit(len(values))) == i, F.lit(value))
    return out


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items grouped to one row per (brand, type, supplier, year) with the measured ranges."""
    return spark.sql(
        """
        SELECT g.*, s_name, n_name, r_name
        FROM (SELECT p_brand, p_type, l_suppkey AS supp, year(l_shipdate) AS yr, count(*) AS n,
                     count_if(l_returnflag = 'R') AS n_r, count_if(l_returnflag = 'N') AS n_n,
                     min(round(l_discount * 100)) AS d_lo, max(round(l_discount * 100)) AS d_hi,
                     min(round(l_extendedprice / l_quantity)) AS p_lo, max(round(l_extendedprice / l_quantity)) AS p_hi,
                     min(l_quantity) AS q_lo, max(l_quantity) AS q_hi
              FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
              GROUP BY p_brand, p_type, l_suppkey, year(l_shipdate)) g
        JOIN {supplier} ON supp = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey
        JOIN {region} ON n_regionkey = r_regionkey
        """,
        **views(spark, sf_dir, "lineitem", "part", "supplier", "nation", "region"),
    )


_NUMBER = "IF({0} = floor({0}), CAST(CAST({0} AS DECIMAL(38,0)) AS STRING), CAST({0} AS STRING))"
_OBSERVATION = (
    "named_struct('property_name', '{0}', 'operator', {1}, 'value', CAST({2} AS DOUBLE), 'min_value', CAST({3} AS DOUBLE), "
    "'max_value', CAST({4} AS DOUBLE), 'unit', {5}, 'normalized_value', CAST({2} AS DOUBLE), "
    "'normalized_min', CAST({3} AS DOUBLE), 'normalized_max', CAST({4} AS DOUBLE), 'normalized_unit', {5}, 'raw_text', {6})"
)
_LOCATOR = (
    "named_struct('document_id', {0}, 'source_title', {1}, 'source_url', CAST({2} AS STRING), 'retrieved_at', CAST(NULL AS STRING), "
    "'page', CAST({3} AS INT), 'sheet', CAST({4} AS STRING), 'cell_range', CAST({5} AS STRING), 'char_start', CAST(NULL AS INT), "
    "'char_end', CAST(NULL AS INT), 'quote', {6})"
)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding per shipment group with two or three observations and one or two located quotes."""
    texts = shipments(spark, sf_dir).selectExpr(
        "*", "concat(p_brand, ' ', p_type) AS label", "IF(supp % 2 = 0, 'mg/L', 'мг/л') AS p_unit",
        *[f"{_NUMBER.format(x)} AS {x}_t" for x in ("d_lo", "d_hi", "p_lo", "p_hi", "q_hi")],
    )
    spans = texts.selectExpr(
        "*", "IF(d_lo = d_hi, d_lo_t, concat(d_lo_t, '–', d_hi_t)) AS d_span", "IF(p_lo = p_hi, p_lo_t, concat(p_lo_t, '–', p_hi_t)) AS p_span",
        "CASE supp % 3 WHEN 0 THEN 'lte' WHEN 1 THEN 'gte' ELSE 'eq' END AS amount",
    )
    worded = spans.selectExpr(
        "*",
        "concat(label, ' shipped by ', s_name, ' in ', yr, ': discount ', d_span, ' %, unit price ', p_span, ' ', p_unit) AS statement",
    )
    discount = _OBSERVATION.format("discount", "'between'", "NULL", "d_lo", "d_hi", "'%'", "concat('discount ', d_span, ' %')")
    price = _OBSERVATION.format(
        "unit_price", "IF(n = 1, 'eq', 'between')", "IF(n = 1, p_lo, NULL)", "IF(n > 1, p_lo, NULL)", "IF(n > 1, p_hi, NULL)",
        "p_unit", "concat('price ', p_span)",
    )
    quantity = _OBSERVATION.format(
        "quantity", "amount", "IF(amount = 'gte', q_lo, q_hi)", "NULL", "NULL", "'т'",
        "concat(CASE amount WHEN 'lte' THEN 'at most ' WHEN 'gte' THEN 'at least ' ELSE 'не более ' END, q_hi_t, ' т')",
    )
    first = _LOCATOR.format(
        "concat('doc-supplier-', supp)", "s_name", "concat('https://example.org/s/', supp)", "1 + supp % 9", "NULL", "NULL",
        "IF(supp % 7 = 0, concat(label, ' shipped by ', s_name, ', discount ', d_span, ' %'), statement)",
    )
    second = _LOCATOR.format(
        "concat('doc-nation-', n_name)", "n_name", "NULL", "NULL", "'S1'", "'A1'", "concat('line items: ', n)"
    )
    return worded.selectExpr(
        "concat_ws('-', 'f', replace(p_brand, '#', ''), p_type, supp, yr) AS id",
        "statement",
        "CAST(50 + 4 * least(n, 10) AS DOUBLE) / 100 AS confidence",
        f"IF(n > 1, array({first}, {second}), array({first})) AS evidence",
        "CASE WHEN n_n * 2 >= n THEN 'consensus' WHEN n_r * 2 > n THEN 'disputed' ELSE 'hypothesis' END AS status",
        f"IF(n > 1, array({discount}, {price}, {quantity}), array({discount}, {price})) AS observations",
        "1 AS version",
        "CAST(NULL AS STRING) AS superseded_by",
        "IF(NOT (p_type = 'PROMO' AND supp % 10 = 0), label, NULL) AS subject",
        "'HAS_PROPERTY' AS predicate",
        "n_name AS object",
        "'measurement' AS fact_kind",
        "CAST(NULL AS STRING) AS context",
        "map_filter(map('year', IF(supp % 20 <> 0, CAST(yr AS STRING), NULL), 'geography', r_name, "
        "'origin', IF(supp % 50 = 49, 'demo', NULL)), (k, v) -> v IS NOT NULL) AS scope",
        "CASE supp % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' ELSE 'restricted' END AS data_class",
        "CAST(NULL AS STRING) AS reviewer_id", "CAST(NULL AS STRING) AS review_date", "CAST(NULL AS STRING) AS review_reason",
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as documents; the lines of a text are its fragments, numbered as pages."""
    c = F.col
    lines = F.split("text", "\n")
    # A line begins behind the one before and its line break; the last sum is the end of the text.
    starts = F.aggregate("lines", F.array(F.lit(0)), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + F.length(t) + 1)))
    placed = F.arrays_zip("lines", F.slice(starts, 1, F.size("lines")).alias("starts"))
    d = table(spark, sf_dir, "documents").withColumn("lines", lines)
    return d.select(
        F.concat(F.lit("doc-"), c("doc_id")).alias("document_id"),
        F.concat_ws("-", "source", "doc_id").alias("title"),
        "text",
        c("lang").alias("language"),
        F.when(c("doc_id") % 4 != 0, _pick(c("doc_id"), "Russia", "KZ", "Урал, Россия")).alias("geography"),
        F.when(c("doc_id") % 5 != 0, (1990 + c("doc_id") % 40).cast("int")).alias("year"),
        _pick(c("doc_id"), "public", "internal", "restricted").alias("data_class"),
        F.transform(
            placed,
            lambda z, i: F.struct(
                z["lines"].alias("text"), (i + 1).alias("page"), F.lit(None).cast("string").alias("sheet"),
                F.lit(None).cast("string").alias("cell_range"), z["starts"].alias("source_char_start"),
            ),
        ).alias("fragments"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    t = lambda name: table(spark, sf_dir, name)
    meta = lambda *kv: F.create_map(*kv)

    def shape(df, key, label, kind, confidence, data_class, metadata):
        return df.select(
            key.alias("id"), label.alias("label"), F.lit(kind).alias("type"), confidence.alias("confidence"),
            data_class.alias("data_class"), metadata.alias("metadata"),
        )

    one, public = F.lit(1.0), F.lit("public")
    cls = lambda k: _pick(c(k), "public", "internal", "restricted")
    parts = shape(t("part"), F.concat(F.lit("part-"), c("p_partkey")), c("p_name"), "material", one, cls("p_partkey"),
                  meta(F.lit("brand"), c("p_brand")))
    types = shape(t("part").select("p_type").distinct(), F.concat(F.lit("type-"), c("p_type")), c("p_type"), "process", one,
                  public, meta(F.lit("kind"), F.lit("type")))
    suppliers = shape(t("supplier"), F.concat(F.lit("supplier-"), c("s_suppkey")), c("s_name"), "equipment", one,
                      cls("s_suppkey"), meta(F.lit("nation"), c("s_nationkey").cast("string")))
    nations = shape(t("nation"), F.concat(F.lit("nation-"), c("n_nationkey")), c("n_name"), "location", one, public,
                    meta(F.lit("region"), c("n_regionkey").cast("string")))
    customers = shape(t("customer"), F.concat(F.lit("customer-"), c("c_custkey")), c("c_name"), "expert", F.lit(0.9),
                      public, meta(F.lit("segment"), c("c_mktsegment")))
    orders = shape(t("orders"), F.concat(F.lit("order-"), c("o_orderkey")), F.concat(F.lit("Order "), c("o_orderkey")),
                   "publication", one, public, meta(F.lit("year"), F.year("o_orderdate").cast("string")))
    return parts.unionByName(types).unionByName(suppliers).unionByName(nations).unionByName(customers).unionByName(orders)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    t = lambda name: table(spark, sf_dir, name)

    def shape(df, source, relation, target, confidence, data_class=F.lit("public")):
        return df.select(
            F.concat_ws("|", source, F.lit(relation), target).alias("id"), source.alias("source"), target.alias("target"),
            F.lit(relation).alias("relation"), confidence.alias("confidence"), data_class.alias("data_class"),
        )

    key = lambda prefix, col: F.concat(F.lit(prefix), c(col))
    one = F.lit(1.0)
    located = shape(t("supplier"), key("supplier-", "s_suppkey"), "LOCATED_IN", key("nation-", "s_nationkey"), one)
    processed = shape(t("part"), key("part-", "p_partkey"), "PROCESSED_BY", key("type-", "p_type"), one)
    item = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    typed = item.join(t("part").select("p_partkey", "p_type"), c("l_partkey") == c("p_partkey"))
    share = lambda n: (F.least(c("n"), F.lit(n)) / float(n))
    used = shape(typed.groupBy("l_suppkey", "p_type").agg(F.count("*").alias("n")),
                 key("supplier-", "l_suppkey"), "USED_BY", key("type-", "p_type"), share(200))
    bought = typed.join(t("orders").select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey"))
    # The type a customer buys most often; ties go to the smaller name.
    most = (
        bought.groupBy("o_custkey", "p_type").agg(F.count("*").alias("n"))
        .groupBy("o_custkey").agg(F.min(F.struct((-c("n")).alias("k"), c("p_type"))).alias("m"))
        .select("o_custkey", (-c("m.k")).alias("n"), c("m.p_type").alias("p_type"))
    )
    expert = shape(most, key("customer-", "o_custkey"), "EXPERT_IN", key("type-", "p_type"), share(20))
    # Parts delivered by a supplier, and a wrong-typed share of them (a material cannot be located in equipment).
    pairs = item.select("l_partkey", "l_suppkey").distinct()
    stock = shape(pairs, key("supplier-", "l_suppkey"), "USED_IN", key("part-", "l_partkey"), F.lit(0.5),
                  F.when(c("l_partkey") % 3 == 2, "restricted").otherwise("public"))
    return located.unionByName(processed).unionByName(used).unionByName(expert).unionByName(stock)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("v-"), F.col("vec_id")).alias("id"), "embedding", F.col("label").cast("string").alias("label"),
        _pick(F.col("vec_id"), "public", "internal", "restricted").alias("data_class"),
    )


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as questions."""
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("q-"), F.col("item_id")).alias("query_id"), "text")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as search findings: the first line is the statement, the whole text is the quote."""
    c = F.col
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d-"), c("doc_id")).alias("id"),
        F.substring_index("text", "\n", 1).alias("statement"),
        c("text").alias("quote"),
        F.concat_ws(" ", "source", "lang").alias("source_title"),
        F.substring_index(F.substring_index("text", " ", 2), "\n", 1).alias("subject"),
        ((c("doc_id") % 10) / 10.0).alias("confidence"),
        _pick(c("doc_id"), "public", "internal", "restricted").alias("data_class"),
        c("source").alias("community"),
        (c("doc_id") % 4).cast("int").alias("n_observations"),
        (c("doc_id") % 3).cast("int").alias("n_units"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as model calls."""
    c = F.col
    return table(spark, sf_dir, "events").select(
        c("event_id").alias("id"), c("ts"), F.concat(F.lit("u"), c("user_id")).alias("account_id"),
        F.concat(F.lit("t"), c("user_id") % 40).alias("thread_id"),
        c("event_type").alias("schema_name"), c("value").alias("latency_ms"),
        F.get_json_object("props", "$.k").cast("int").alias("tokens"),
        _pick(c("event_id"), "success", "success", "failure", "success", "cancelled", "success", "timeout").alias("outcome"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on neighbouring findings of one subject, region and year where the first is disputed.

    Some of the reviewed pairs are no conflict, as after a change of the corpus.
    """
    from pyspark.sql import Window

    from ..functions.ids import conflict_pair_id

    c = F.col
    f = findings(spark, sf_dir).filter(c("subject").isNotNull()).select(
        "id", "subject", "status", "scope", F.regexp_extract("id", r"-(\d+)-\d+$", 1).cast("bigint").alias("supp"),
        F.regexp_extract("id", r"-(\d+)$", 1).cast("int").alias("yr"),
    )
    w = Window.partitionBy("subject", F.try_element_at("scope", F.lit("geography")), "yr").orderBy("id")
    both = f.withColumn("right_id", F.lead("id").over(w)).withColumn("right_scope", F.lead("scope").over(w))
    both = both.filter((c("status") == "disputed") & c("right_id").isNotNull())
    keys = F.map_filter("scope", lambda k, v: F.map_contains_key(c("right_scope"), k))
    text = F.array_join(F.transform(F.array_sort(F.map_entries(keys)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    claim = lambda name: F.concat(c(name), F.lit("#discount#0"))
    return both.select(
        F.concat(F.lit("rev-"), c("id")).alias("id"),
        conflict_pair_id(claim("id"), claim("right_id"), F.lit("discount"), text).alias("candidate_id"),
        F.when(c("supp") % 2 == 0, "confirmed").otherwise("dismissed").alias("status"),
        F.concat(F.lit("expert-"), c("supp") % 5).alias("actor_id"),
        F.lit("discount").alias("property_name"),
        c("id").alias("left_finding_id"), c("right_id").alias("right_finding_id"),
        F.concat(c("yr").cast("string"), F.lit("-12-01")).alias("created_at"),
    )


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per nation with year, territory and number limits; the nation's findings are its candidates."""
    return spark.sql(
        """
        SELECT n_name AS plan_id, n_nationkey,
          IF(n_nationkey % 4 = 0, NULL, 1993 + n_nationkey % 5) AS year_from, IF(n_nationkey % 3 = 0, NULL, 1999) AS year_to,
          CASE n_nationkey % 5 WHEN 0 THEN CAST(array() AS ARRAY<STRING>) WHEN 1 THEN array('Asia', 'AFRICA')
            ELSE array(initcap(r_name)) END AS countries,
          transform(
            CASE n_nationkey % 3
              WHEN 0 THEN array(struct('discount', 'between', NULL, 2, 6, '%'))
              WHEN 1 THEN array(struct('discount', 'gte', 5, NULL, NULL, '%'), struct('unit_price', 'lt', 2000, NULL, NULL, 'mg/L'))
              ELSE array() END,
            f -> named_struct('property_name', f.col1, 'operator', f.col2, 'value', CAST(f.col3 AS DOUBLE),
              'min_value', CAST(f.col4 AS DOUBLE), 'max_value', CAST(f.col5 AS DOUBLE), 'unit', f.col6)) AS numeric_filters
        FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
        """,
        **views(spark, sf_dir, "nation", "region"),
    )


def corrections(df: DataFrame) -> DataFrame:
    """A correction for every disputed finding of a catalog, a competing second one where the class is restricted."""
    c = F.col
    base = df.filter(c("status") == "disputed").select(
        c("id").alias("finding_id"), F.concat(F.lit("corrected: "), c("statement")).alias("new_statement"),
        F.lit(0.95).alias("new_confidence"), F.lit("expert-1").alias("reviewer_id"), F.lit("2024-05-01").alias("review_date"),
        F.lit("checked").alias("review_reason"), F.explode(
            F.when(c("data_class") == "restricted", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
        ).alias("seq"),
    )
    return base


def versioned_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog after one round of corrections, and a second round on the corrected findings of the public class."""
    from ..operators.catalog import supersede

    first, _, _ = supersede(findings(spark, sf_dir), corrections(findings(spark, sf_dir)))
    again = first.filter((F.col("version") == 2) & (F.col("data_class") == "public"))
    second, _, _ = supersede(first, corrections(again))
    return second


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as audit rows."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "concat('u', user_id) AS actor_id", "event_type AS action", "concat('o', user_id % 17) AS object_id",
        "IF(event_type = 'error', 'denied', 'ok') AS outcome", "concat('c', user_id % 29) AS correlation_id",
        "map('k', get_json_object(props, '$.k')) AS metadata", "ts AS created_at",
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stored answers: used again when the value is large, expired when a signup."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS query_id", "concat('u', user_id) AS owner_id", "ts AS created_at",
        "IF(event_type = 'signup', ts, ts + INTERVAL 30 DAYS) AS expires_at",
        "IF(value > 20, ts + INTERVAL 3 DAYS, NULL) AS last_accessed_at",
        "IF(event_type = 'purchase', 'accepted', 'proposed') AS status",
    )


def extraction(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(claims, entities, resolutions, accepted) made from the lines of the documents.

    A third of the quotes is exact, a third differs in case, a third is in no text.
    """
    lines = table(spark, sf_dir, "documents").selectExpr(
        "concat('doc-', doc_id) AS document_id", "posexplode(split(text, '\\n')) AS (pos, line)"
    ).filter("size(split(line, ' ')) > 2").selectExpr(
        "document_id", "pos", "line", "split(line, ' ')[0] AS w1", "split(line, ' ')[1] AS w2", "split(line, ' ')[2] AS w3"
    )
    observation = SCHEMA_OBSERVATIONS
    claims = lines.selectExpr(
        "document_id", "pos", "w1 AS subject",
        "element_at(array('USES', 'HAS_PROPERTY', 'LOCATED_IN', 'unknown thing'), pos % 4 + 1) AS predicate", "w2 AS object",
        "line AS statement", "CAST(60 + pos % 40 AS DOUBLE) / 100 AS confidence",
        "CASE pos % 3 WHEN 0 THEN line WHEN 1 THEN lower(line) ELSE concat('~', line) END AS evidence_quote",
        "'fact' AS fact_kind", "CAST(NULL AS STRING) AS context", f"CAST(array() AS {observation}) AS observations",
    )
    entities = lines.filter("pos % 2 = 0").groupBy("document_id", F.col("w1").alias("name")).agg(F.min("pos").alias("p")).selectExpr(
        "document_id", "name", "concat('the ', name) AS canonical_name",
        "element_at(array('material', 'process', 'equipment'), p % 3 + 1) AS type", "array(concat(name, 's')) AS aliases",
    )
    resolutions = lines.groupBy("document_id", F.col("w2").alias("mention")).agg(F.min("pos").alias("p")).selectExpr(
        "document_id", "mention", "concat('canon ', mention) AS canonical_name", "'link' AS action",
        "CAST(50 + p % 5 * 10 AS DOUBLE) / 100 AS confidence",
    )
    accepted = lines.filter("length(w3) > 6").groupBy(F.lower("w3").alias("alias")).agg(
        F.concat(F.lit("agreed "), F.lower(F.min("w3"))).alias("canonical")
    )
    return claims, entities, resolutions, accepted


SCHEMA_OBSERVATIONS = (
    "ARRAY<STRUCT<property_name STRING, operator STRING, value DOUBLE, min_value DOUBLE, max_value DOUBLE, unit STRING, "
    "normalized_value DOUBLE, normalized_min DOUBLE, normalized_max DOUBLE, normalized_unit STRING, raw_text STRING>>"
)
