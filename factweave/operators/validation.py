"""Shape rules of observations, locators, plans, extractions and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import lookup
from ..schemas import ENTITY_TYPE_ALIASES, NODE_TYPES, RELATION_ROWS

PREDICATE = "^[A-Z][A-Z0-9_]*$"
DEFAULT_HOPS, MIN_HOPS, MAX_HOPS = 3, 1, 4
REPORTED = 8


def violations(**rules: Column) -> Column:
    """Names of the rules that do not hold, in the given order."""
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())


def observation_violations(o: Column) -> Column:
    between = o["operator"] == "between"
    bounds = F.array(o["min_value"], o["max_value"], o["normalized_min"], o["normalized_max"])
    known = F.size(F.filter(bounds, lambda v: v.isNotNull()))
    scalar = o["value"].isNotNull() | o["normalized_value"].isNotNull()
    return violations(
        between_with_value=between & scalar,
        between_without_bounds=between & (known < 4),
        low_above_high=between & ((o["min_value"] > o["max_value"]) | (o["normalized_min"] > o["normalized_max"])),
        point_with_bounds=~between & (known > 0),
        point_without_value=~between & (o["value"].isNull() | o["normalized_value"].isNull()),
        no_unit=(F.coalesce(o["unit"], F.lit("")) == "") | (F.coalesce(o["normalized_unit"], F.lit("")) == ""),
    )


def validate_observations(findings: DataFrame) -> DataFrame:
    rows = findings.select("id", F.posexplode("observations").alias("pos", "o"))
    return rows.select("id", "pos", observation_violations(F.col("o")).alias("violations"))


def evidence_violations(e: Column) -> Column:
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    return violations(
        end_without_start=e["char_end"].isNotNull() & e["char_start"].isNull(),
        end_not_after_start=e["char_end"] <= e["char_start"],
        no_address=e["page"].isNull() & ~filled(e["sheet"]) & ~filled(e["source_url"]),
        no_quote=~filled(F.trim(e["quote"])),
    )


def validate_evidence(findings: DataFrame) -> DataFrame:
    rows = findings.select("id", F.posexplode("evidence").alias("pos", "e"))
    return rows.select("id", "pos", evidence_violations(F.col("e")).alias("violations"))


def validate_plans(plans: DataFrame) -> DataFrame:
    """Repaired plans with their violations: 0, -1 and blank years are absent, 0 hops are three, hops stay in 1..4."""
    c = F.col
    year = lambda n: F.when(~c(n).cast("string").isin("0", "-1", ""), c(n).try_cast("int"))
    hops = F.coalesce(F.when(c("max_hops") != 0, c("max_hops")), F.lit(DEFAULT_HOPS))
    rows = plans.withColumns({
        "year_from": year("year_from"), "year_to": year("year_to"), "max_hops": F.least(F.greatest(hops, F.lit(MIN_HOPS)), F.lit(MAX_HOPS)),
    })
    bad_filter = F.exists("numeric_filters", lambda f: F.when(
        f["operator"].isin("between", "range"), f["min_value"].isNull() | f["max_value"].isNull()
    ).otherwise(f["value"].isNull()))
    outside = lambda n: ~c(n).between(1800, 2100)
    return rows.withColumn("violations", violations(
        year_from_range=outside("year_from"), year_to_range=outside("year_to"), year_order=c("year_from") > c("year_to"), filter_fields=bad_filter,
    ))


def canonical_predicate(col: Column) -> Column:
    """Upper-case words joined by underscores; left alone when no ASCII letter comes first."""
    token = F.btrim(F.upper(F.regexp_replace(F.trim(col), "[^A-Za-z0-9_]+", "_")), F.lit("_"))
    return F.when(token.rlike("^[A-Z]"), token).otherwise(col)


def normalize_entity_type(col: Column) -> Column:
    return F.coalesce(lookup(ENTITY_TYPE_ALIASES, F.lower(col)), col)


def validate_extraction(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """(document_id, path, value, rule) of every broken rule; :func:`report` shows the first ones."""
    c = F.col
    semantic = [r[0] for r in RELATION_ROWS if r[1] == "semantic"]
    names = entities.select("document_id", F.explode(F.transform(
        F.concat(F.array("name", "canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))), F.lower
    )).alias("key")).distinct().withColumn("_known", F.lit(True))
    rows = claims
    for end in ("subject", "object"):
        rows = rows.withColumn("key", F.lower(end)).join(
            names.withColumnRenamed("_known", f"_{end}"), ["document_id", "key"], "left"
        ).drop("key")
    fault = lambda bad, path, value, rule: F.when(F.coalesce(bad, F.lit(False)), F.struct(
        F.lit(path).alias("path"), value.cast("string").alias("value"), F.lit(rule).alias("rule")
    ))
    faults = F.array(
        fault(c("_subject").isNull(), "subject", c("subject"), "unknown"), fault(c("_object").isNull(), "object", c("object"), "unknown"),
        fault(~c("predicate").rlike(PREDICATE), "predicate", c("predicate"), "pattern"),
        fault(c("predicate").rlike(PREDICATE) & ~c("predicate").isin(*semantic), "predicate", c("predicate"), "vocabulary"),
        fault(F.trim(F.coalesce("evidence_quote", F.lit(""))) == "", "evidenceQuote", c("evidence_quote"), "empty"),
        fault(~c("confidence").between(0, 1), "confidence", c("confidence"), "range"),
    )
    found = rows.select("document_id", F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("f")).select("document_id", "f.*")
    kinds = entities.filter(~c("type").isin(*NODE_TYPES)).select(
        "document_id", F.lit("entityType").alias("path"), c("type").alias("value"), F.lit("vocabulary").alias("rule")
    )
    return found.unionByName(kinds)


def report(faults: DataFrame, limit: int = REPORTED) -> DataFrame:
    """First faults of each document in text order, and how many more there are."""
    from .catalog import top_k

    total = faults.groupBy("document_id").agg(F.count("*").alias("total"))
    shown = top_k(faults, ["document_id"], [F.col("path"), F.col("value"), F.col("rule")], limit)
    return shown.join(total, "document_id").withColumn("hidden", F.greatest(F.col("total") - limit, F.lit(0)))


def validate_edges(edges: DataFrame, nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Edges with the reason they break the registry, or null. An edge out of a claim node is asserted: its relation must be
    allowed as a predicate and the source is not checked. The registry has 34 rows and is broadcast."""
    c = F.col
    kind = lambda end: nodes.select(c("id").alias(end), c("type").alias(f"{end}_type"))
    rel = F.broadcast(relations.withColumnRenamed("name", "relation"))
    rows = edges.withColumn("relation", F.upper(F.trim("relation"))).join(kind("source"), "source", "left").join(kind("target"), "target", "left").join(rel, "relation", "left")
    asserted = c("source_type") == "claim"
    free = lambda types, t: (F.size(types) == 0) | F.array_contains(types, c(t))
    reason = (
        F.when(c("tier").isNull(), "unknown_relation").when(c("source_type").isNull() | c("target_type").isNull(), "unknown_node")
        .when(asserted & (c("tier") == "semantic") & ~c("claim_predicate"), "not_a_predicate")
        .when(~(asserted & (c("tier") == "semantic")) & ~free("source_types", "source_type"), "source_type")
        .when(~free("target_types", "target_type"), "target_type")
    )
    return rows.select("id", "source", "target", "relation", reason.alias("violation"))


def resolve_relations(requests: DataFrame) -> DataFrame:
    """Accepted and refused relation names of each request, in request order without repeats.

    An empty request means the semantic tier; a tier name stands for all its relations.
    """
    tier = {t: [r[0] for r in RELATION_ROWS if r[1] == t.lower()] for t in ("SEMANTIC", "PROVENANCE")}
    words = lambda names: F.array(*[F.lit(n) for n in names])
    known = words([r[0] for r in RELATION_ROWS])
    asked = F.filter(F.transform(F.coalesce("relation_types", F.array().cast("array<string>")), lambda n: F.upper(F.trim(n))), lambda n: n != "")
    expand = lambda n: F.when(n == "SEMANTIC", words(tier["SEMANTIC"])).when(n == "PROVENANCE", words(tier["PROVENANCE"])).when(
        F.array_contains(known, n), F.array(n)
    ).otherwise(F.array().cast("array<string>"))
    rows = requests.withColumn("_asked", asked)
    bare = F.coalesce(F.size("relation_types"), F.lit(0)) == 0
    return rows.withColumns({
        "accepted": F.when(bare, words(tier["SEMANTIC"])).otherwise(F.array_distinct(F.flatten(F.transform("_asked", expand)))),
        "rejected": F.filter("_asked", lambda n: ~F.array_contains(known, n) & ~n.isin("SEMANTIC", "PROVENANCE")),
    }).drop("_asked")
